"""Column builders that bring identifiers, numbers and text to comparable forms. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# fixed value: the CJK letters counted and spaced as ideographs
CJK = "㐀-䶿一-鿿豈-﫿"
# fixed values: super- and subscript characters and what they stand for
RAISED, RAISED_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"
LOWERED, LOWERED_PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-"


def chain(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``c`` rewritten by (pattern, replacement) rules, one after the other."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(replacement))
    return c


# -- identifiers ------------------------------------------------------------------------------------------------------


def normalize_doi(c: Column) -> Column:
    """Lower case, outer blanks and one resolver or ``doi:`` prefix removed; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def component(c: Column) -> Column:
    """One part of a composed identity: trimmed, lower case, '' for null."""
    return F.lower(F.coalesce(strip(c), F.lit("")))


def identity(*columns: Column) -> Column:
    """Composed identity as a struct usable as a grouping or join key."""
    return F.struct(*[component(c).alias(f"k{i}") for i, c in enumerate(columns)])


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank, trimmed; '' if none."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def is_iso_date(c: Column) -> Column:
    """A real date in the canonical form YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_iso_week(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-W(?:0[1-9]|[1-4]\d|5[0-3])$"), F.lit(False))


def iso_week(ts: Column) -> Column:
    """YYYY-Www of a date or timestamp."""
    d = ts.cast("date")
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


# fixed values: identifier formats
ID_PATTERNS = {"term": r"^TERM-\d{4,}$", "evidence": r"^TERMEV-\d{4,}$", "level": r"^TE[1-7]$"}


def is_id(c: Column, kind: str) -> Column:
    return F.coalesce(c.rlike(ID_PATTERNS[kind]), F.lit(False))


# -- lists in cells ---------------------------------------------------------------------------------------------------


def split_list(c: Column, separators: str = ";") -> Column:
    """Trimmed, non-blank parts of a cell."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{separators}]"), strip), lambda s: s != "")


def ordered_union(*columns: Column, separators: str = ";,") -> Column:
    """Distinct parts of several cells in first-seen order."""
    return F.array_distinct(F.flatten(F.array(*[split_list(c, separators) for c in columns])))


def merge_values(existing: Column, supplied: Column) -> Column:
    """Old and new list cells as one, nothing dropped, in first-seen order, joined by '; '."""
    return F.array_join(ordered_union(existing, supplied, separators=";"), "; ")


def append_note(existing: Column, note: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(strip(existing), F.lit("")), F.nullif(strip(note), F.lit("")))


# -- numbers ----------------------------------------------------------------------------------------------------------


def quantize(c: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.bround(c / F.lit(step)) * F.lit(step)


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


# fixed values: rewrites to the canonical form of a numeric token
CANON_BEFORE = [(r"((?:×|x|X|\*)\s*10)\s*(?!\^)([+\-−–]?\s*\d+)", "$1^$2"), ("[−–]", "-"), ("\uf0b3", "≥"), (r"[×*]", "x"), ("χ²|χ2", "chi2"), ("β", "beta"), ("²", "2"), (r"(?i)\br\s*\^\s*2\b", "r2")]
CANON_AFTER = [(r"(?U)\s+", ""), (r"(seconds?|secs?)$", "s"), (r"minutes?$|mins$", "min"), (r"hours?$|hrs$", "h"), (r"days$", "day"), (",", "")]


def canon_number(c: Column) -> Column:
    """Canonical form of a numeric token: signs, powers, statistics names, units and separators unified."""
    return chain(F.lower(chain(F.translate(c, RAISED, RAISED_PLAIN), CANON_BEFORE)), CANON_AFTER)


# -- citations --------------------------------------------------------------------------------------------------------


def citation_payload(c: Column) -> Column:
    """Comma-separated citation numbers with en-dash ranges, no blanks."""
    return F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "；;，、—-", ",,,,––")


def citation_groups(source: Column) -> Column:
    """Distinct citation groups glued to English words; a number after a lone t, f or v is a statistic."""
    found = F.regexp_extract_all(source, F.lit(r"(?:(?<![A-Za-z])(?=[TtFfVv])[TtFfVv]\d)|(?<=[A-Za-z)])(\d{1,3}(?:\s*[,;]\s*\d{1,3}|\s*[–—-]\s*\d{1,3})*)(?=[.,;:)\s]|$)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, citation_payload), lambda g: g != ""))


# -- text -------------------------------------------------------------------------------------------------------------


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def loose(c: Column) -> Column:
    """Without white space, zero-width characters and emphasis marks, lower case."""
    return F.lower(F.regexp_replace(c, "(?U)[\\s\u200b\ufeff*_#`]+", ""))


# fixed values: characters that typesetting exchanges
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]


def extraction_form(nfc: Column) -> Column:
    """What two extractions of the same printed text have in common: full-width ASCII, raised digits, ligatures, minus signs and soft hyphens unified, white space gone.

    The argument is composed text (see udfs.nfc).
    """
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    plain = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
    c = F.translate(nfc, wide + RAISED + LOWERED + "−", plain + RAISED_PLAIN + LOWERED_PLAIN + "-")
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return without_space(F.replace(c, F.lit("\u00ad"), F.lit("")))


# fixed values: Markdown marks that are not visible
MARKDOWN = [(r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^\s*(?:#{1,6}\s+|>\s*|[-*+]\s+|\d+\.\s+)", ""), (r"(?U)(?<!\w)[*_~`]+|[*_~`]+(?!\w)", "")]


def visible_text(markdown: Column) -> Column:
    return chain(markdown, MARKDOWN)


def visible_length(c: Column) -> Column:
    """Characters that are neither separators nor controls nor white space."""
    return F.length(F.regexp_replace(c, r"(?U)[\p{Z}\p{C}\s]", ""))


def cjk_length(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[㐀-䶿一-鿿]"))


def has_cjk(c: Column) -> Column:
    return c.rlike("[㐀-䶿一-鿿]")


def latin_words(c: Column, least: int = 3) -> Column:
    """Sorted distinct Latin words of at least ``least`` letters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"[A-Za-z][A-Za-z'’-]{{{least - 1},}}"), F.lit(0))))


# fixed value: four and more Latin words in a row
LATIN_RUN = r"\b[A-Za-z][A-Za-z'’-]*\b(?:\s+\b[A-Za-z][A-Za-z'’-]*\b){3,}"


def latin_runs(c: Column, allowed: Sequence[str], least: int = 4) -> Column:
    """Runs of Latin words with at least ``least`` words outside of ``allowed``."""
    words = lambda r: F.regexp_extract_all(F.lower(r), F.lit("[a-z][a-z'’-]*"), F.lit(0))
    known = F.array(*[F.lit(w.lower()) for w in allowed]) if allowed else F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all(c, F.lit(LATIN_RUN), F.lit(0)), lambda r: F.size(F.filter(words(r), lambda w: ~F.array_contains(known, w))) >= least)


def first_cjk_run(c: Column, width: int = 4) -> Column:
    """The first run of at least two ideographs, else the first one; cut to ``width``; '' if none."""
    runs = F.regexp_extract_all(c, F.lit("[㐀-鿿]+"), F.lit(0))
    return F.substring(F.coalesce(F.get(F.filter(runs, lambda r: F.length(r) >= 2), F.lit(0)), F.get(runs, F.lit(0)), F.lit("")), 1, width)


# fixed value: citations of supplementary material
SUPPLEMENT = r"(?i)\bSupplementary\s+(?:Table|Figure|Fig\.?)(?:s)?\s*(?:S?\d+(?:\s*[–,\-]\s*S?\d+)*)|\bSupplementary\s+(?:Methods|Results|Materials?)\b"


def supplement_references(c: Column) -> Column:
    """Sorted distinct citations of supplementary material, blanks collapsed."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(SUPPLEMENT), F.lit(0)), lambda s: strip(F.regexp_replace(s, r"\s+", " ")))))


def dehyphenated(c: Column) -> Column:
    """Words broken at a line end put together again."""
    return F.regexp_replace(c, r"(?<=[A-Za-z])-\s*\n\s*(?=[A-Za-z])", "")


def protected_tokens(c: Column) -> Column:
    """Whole words and whole numbers, so that .03 is not found in .032 nor a prefix in a word."""
    return F.regexp_extract_all(dehyphenated(c), F.lit(r"[A-Za-z]+|\d+(?:\.\d+)*|\.\d+"), F.lit(0))


def holds_sequence(observed: Column, wanted: Column) -> Column:
    """Is ``wanted`` a run of neighbours in ``observed``? An empty ``wanted`` always is."""
    last = F.size(observed) - F.size(wanted)
    at = F.when((last >= 0) & (F.size(wanted) > 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return (F.size(wanted) == 0) | F.exists(at, lambda i: F.slice(observed, i + 1, F.size(wanted)) == wanted)


def markdown_cell(c: Column) -> Column:
    """Text fit for a cell of a pipe table."""
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")


def mapped(c: Column, values: Mapping[str, str], default: str) -> Column:
    """``c`` through a small fixed mapping."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(default))


def marks_found(c: Column, pattern: str) -> Column:
    """Distinct matches of a pattern of forbidden marks; an empty array is a pass."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)))


def is_substantive(c: Column) -> Column:
    """A letter or ideograph, more text, and the end of a sentence."""
    return F.coalesce(c.rlike(r"[A-Za-z㐀-鿿].+[。.!?！？]"), F.lit(False))


def same_filename(observed: Column, expected: Column) -> Column:
    """Equal, or equal with every blank written as a plus sign."""
    return F.coalesce((observed == expected) | (observed == F.replace(expected, F.lit(" "), F.lit("+"))), F.lit(False))


def source_key(source_id: Column, page: Column) -> Column:
    """(trimmed source id, page) as a struct, null unless the id is filled and the page positive."""
    return F.when((strip(source_id) != "") & (page > 0), F.struct(strip(source_id).alias("source_id"), page.alias("page")))


def is_positive_int(v: Column) -> Column:
    """A variant that holds a whole number above 0: no boolean, no text, no fraction."""
    return F.coalesce((F.schema_of_variant(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") > 0), F.lit(False))


def is_number(v: Column) -> Column:
    """A variant that holds a finite number: no boolean, no text."""
    kind = F.schema_of_variant(v)
    return F.coalesce((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & is_finite(F.try_variant_get(v, "$", "double")), F.lit(False))


def creators(people: Column) -> Column:
    """Structured creators in one form: a single name (or an institution) as last name with field_mode 1, blank types as author.

    ``people`` is an array of structs (firstName, lastName, name, creatorType). Entries without any name are null.
    """
    text = lambda c: F.coalesce(strip(c), F.lit(""))

    def one(p: Column) -> Column:
        first, last, single = text(p["firstName"]), text(p["lastName"]), text(p["name"])
        kind = F.coalesce(F.nullif(text(p["creatorType"]), F.lit("")), F.lit("author"))
        alone = (single != "") & (first == "") & (last == "")
        return F.when(alone | (last != ""), F.struct(F.when(alone, F.lit("")).otherwise(first).alias("first_name"), F.when(alone, single).otherwise(last).alias("last_name"), F.when(alone, 1).otherwise(0).alias("field_mode"), kind.alias("creator_type")))

    return F.transform(people, one)


# -- style ------------------------------------------------------------------------------------------------------------


def font_emphasis(font: Column) -> Column:
    """(bold, italic) by the font's name, also in the short form of embedded subsets."""
    name = F.lower(F.coalesce(font, F.lit("")))
    return F.struct(name.rlike(r"bold|semibold|demi|\.b(?:$|\+)").alias("bold"), name.rlike(r"italic|oblique|\.i(?:$|\+)").alias("italic"))


def text_role(kind: Column, size: Column, body_size: Column, text: Column) -> Column:
    """Role of a block by kind, size against body text, and how it begins; the first rule that holds."""
    t = F.lower(F.coalesce(strip(text), F.lit("")))
    return (
        F.when(kind == "title", "TITLE").when((kind == "heading") & (size >= body_size * 1.55), "H1").when((kind == "heading") & (size >= body_size * 1.30), "H2").when(kind == "heading", "H3")
        .when(kind == "table_cell", "TABLE_TEXT").when(t.startswith("abstract"), "ABSTRACT").when(t.rlike(r"^(fig(?:ure)?\.?|table|supplementary\s+(?:fig|table))\s*\d"), "CAPTION")
        .when(t.rlike(r"^(?:https?://\S+|(?:doi\s*:?\s*)?10\.\d{4,9}/\S+)$"), "DOI_URL").when(kind.isin("header", "footer"), "OTHER").otherwise("BODY")
    )


def style_fingerprint(font: Column, size: Column, weight: Column, *rest: Column) -> Column:
    """Comparable style of a frame: names trimmed to defaults, measures rounded to 3 decimals."""
    return F.struct(F.coalesce(font, F.lit("")).alias("font_family"), F.round(F.coalesce(size, F.lit(0.0)), 3).alias("font_size_pt"), F.lower(F.coalesce(F.nullif(weight, F.lit("")), F.lit("regular"))).alias("weight"), *rest)


# -- boxes: arrays of left, bottom, right, top ------------------------------------------------------------------------


def is_box(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda v: is_finite(v)) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))), F.lit(False))


def _side(b: Column, i: int) -> Column:
    return F.get(b, F.lit(i))


def box_contains(outer: Column, inner: Column, tolerance: float = 0.25) -> Column:
    t = F.lit(tolerance)
    return (_side(inner, 0) >= _side(outer, 0) - t) & (_side(inner, 1) >= _side(outer, 1) - t) & (_side(inner, 2) <= _side(outer, 2) + t) & (_side(inner, 3) <= _side(outer, 3) + t)


def boxes_intersect(a: Column, b: Column) -> Column:
    """Touching edges do not intersect."""
    return (_side(a, 0) < _side(b, 2)) & (_side(b, 0) < _side(a, 2)) & (_side(a, 1) < _side(b, 3)) & (_side(b, 1) < _side(a, 3))


def boxes_match(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(tolerance)), lambda m: m), F.lit(False))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), _side(b, 2) - _side(b, 0)) * F.greatest(F.lit(0.0), _side(b, 3) - _side(b, 1))


def same_column(a: Column, b: Column, page_width: Column) -> Column:
    """Horizontal overlap of at least half of the narrower box, or centres within 8 % of the page's width."""
    overlap = F.least(_side(a, 2), _side(b, 2)) - F.greatest(_side(a, 0), _side(b, 0))
    narrower = F.least(_side(a, 2) - _side(a, 0), _side(b, 2) - _side(b, 0))
    return (overlap >= narrower * 0.5) | (F.abs((_side(a, 0) + _side(a, 2)) - (_side(b, 0) + _side(b, 2))) / 2 <= page_width * 0.08)
