"""Records of other tools in one flat form: items, attachments, roles and styles. Column builders, all inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import first_filled, is_iso_date, mapped, normalize_doi
from .text import strip, text_or_blank

# fixed values: fields of an item and the fields they are filled from, the first filled one counts
ITEM_FIELDS = {
    "publication_title": ("publicationTitle", "journal"), "date": ("date", "year"), "volume": ("volume",), "issue": ("issue",), "pages": ("pages",), "url": ("url",), "abstract_note": ("abstractNote", "abstract"), "language": ("language",),
}
# fixed values: roles of frames by kind, and by the reason for which a frame keeps its source
ROLE_OF_KIND = {
    "title": "TITLE", "author": "OTHER", "affiliation": "AFFILIATION", "heading": "H2", "abstract": "ABSTRACT", "body": "BODY", "caption": "CAPTION", "footnote": "FOOTNOTE", "page_header": "OTHER", "page_footer": "OTHER",
    "table_cell": "TABLE_TEXT", "figure_label": "CAPTION", "reference": "REFERENCE", "formula": "FORMULA", "identifier": "DOI_URL", "logo": "OTHER", "other": "OTHER",
}
ROLE_OF_REASON = {"FORMULA": "FORMULA", "REFERENCE_ENTRY": "REFERENCE", "FIGURE_INTERNAL": "FIGURE_INTERNAL", "STATISTIC": "STATISTIC", "IDENTIFIER": "DOI_URL"}


def item_record(metadata: Column) -> Column:
    """A struct of an item from loose metadata (map of text): every field from its first filled source, the DOI in one form.

    ``source_uri`` is the stated one, else the address, else the DOI's; '' if there is none of them. Without a title the item is null.
    """
    get = lambda k: F.element_at(metadata, F.lit(k))
    doi = normalize_doi(F.coalesce(F.nullif(strip(get("DOI")), F.lit("")), get("doi")))
    fields = [first_filled(*[get(s) for s in sources]).alias(name) for name, sources in ITEM_FIELDS.items()]
    uri = first_filled(get("source_uri"), get("url"), F.concat(F.lit("https://doi.org/"), doi))
    kind = F.coalesce(F.nullif(strip(get("itemType")), F.lit("")), F.lit("journalArticle"))
    return F.when(text_or_blank(get("title")) != "", F.struct(kind.alias("item_type"), strip(get("title")).alias("title"), *fields, F.coalesce(doi, F.lit("")).alias("doi"), uri.alias("source_uri")))


def attachment_record(item: Column) -> Column:
    """Identity of an attachment (a variant) as a flat struct: text as it is, '' for null, digest in lower case."""
    get = lambda k: F.coalesce(F.try_variant_get(item, f"$.{k}", "string"), F.lit(""))
    data = lambda k: get(f"data.{k}")
    return F.struct(
        get("key").alias("key"), data("title").alias("title"), data("itemType").alias("item_type"), data("parentItem").alias("parent"), data("linkMode").alias("link_mode"), data("filename").alias("filename"), F.lower(data("md5")).alias("md5")
    )


def is_parent_item(item_type: Column, parent: Column) -> Column:
    """A bibliographic item of its own: no parent, and no attachment, note or annotation."""
    return (text_or_blank(parent) == "") & ~F.coalesce(item_type, F.lit("")).isin("attachment", "note", "annotation")


def library_prefix(c: Column) -> Column:
    """``users/0`` or ``groups/<number>`` without outer blanks and slashes; null for anything else."""
    p = F.btrim(strip(c), F.lit("/"))
    return F.when(p.rlike(r"^(?:users/0|groups/[0-9]+)$"), p)


def frame_role(role: Column, kind: Column) -> Column:
    """The stated role, else the kind's."""
    return F.coalesce(F.nullif(role, F.lit("")), mapped(kind, ROLE_OF_KIND, "OTHER"))


def inferred_role(kind: Column, action: Column, reason: Column, text: Column) -> Column:
    """A role for frames that have none: by the reason for keeping the source, else abstracts by their first word, else by kind."""
    abstract = (kind == "body") & F.lower(text_or_blank(text)).startswith("abstract")
    return F.when(action == "RETAIN_SOURCE", mapped(reason, ROLE_OF_REASON, "OTHER")).when(abstract, "ABSTRACT").otherwise(mapped(kind, ROLE_OF_KIND, "OTHER"))


def style_name(role: Column, language: Column, names: Mapping[str, str]) -> Column:
    """Name of the paragraph style: body text and abstracts by language, other roles by ``names``, roles without a name as body text."""
    upper, tail = F.upper(role), F.when(F.lower(F.coalesce(language, F.lit("zh"))).startswith("zh"), "_ZH").otherwise("_EN")
    base = F.when(upper.isin("BODY", "ABSTRACT"), F.concat(upper, tail))
    return F.coalesce(base, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), upper), F.concat(F.lit("BODY"), tail))


def indent_points(em: Column, font_size: Column) -> Column:
    return F.round(em * font_size, 3)


def without(entries: Column, selectors: Mapping[str, Column]) -> Column:
    """An array of structs without the entries that meet all selectors; null selectors ask for nothing, and none at all removes nothing."""
    asked = F.lit(False)
    for v in selectors.values():
        asked = asked | v.isNotNull()

    def met(e: Column) -> Column:
        out = F.lit(True)
        for field, v in selectors.items():
            out = out & (v.isNull() | F.coalesce(e[field] == v, F.lit(False)))
        return out

    return F.filter(entries, lambda e: ~(asked & met(e)))


def is_reviewed(review: Column, finding: str, fields: Sequence[str] = ("reviewer", "reviewed_date", "method")) -> Column:
    """A complete review (struct): the fixed finding, all fields filled, a real date."""
    ok = F.coalesce(review["finding"] == finding, F.lit(False)) & is_iso_date(review["reviewed_date"])
    for f in fields:
        ok = ok & (text_or_blank(review[f]) != "")
    return F.coalesce(ok, F.lit(False))


def candidates_pass(failures: Column, uncertain: Column, reviewed: Column) -> Column:
    """Failures or uncertain matches need a review; nothing found needs none."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return ~(some(failures) | some(uncertain)) | reviewed
