"""Validator suites: what must hold between the tables of a package, as relations of offenders.

Each suite gives check rows (code, passed, n_failed, detail). All violations are found, not the first
one only; an empty table breaks nothing but coverage. Row rules of a table are read off in one pass;
rules between tables are equi-joins on their own keys. Null keys belong to nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.text import strip, text_or_blank
from . import coverage
from .checks import Check, offenders, suite
from .token_compare import numeric_residuals

# fixed values: vocabularies of the package tables
LANGUAGE_AUTHORITIES = ("PUBLISHER_XML_JATS_HTML", "SELECTABLE_PDF", "ALTERNATE_LEGAL_OFFICIAL_SOURCE", "OCR")
GEOMETRY_OF_ROLE = {"MAIN": "VERSION_OF_RECORD_PDF", "SI": "PUBLISHER_SUPPLEMENT_PDF"}
ROTATIONS = (0, 90, 180, 270)
ACTIONS = ("TRANSLATE", "RETAIN_SOURCE")
FRAME_KINDS = (
    "title", "author", "affiliation", "heading", "abstract", "body", "caption", "footnote", "page_header", "page_footer",
    "table_cell", "figure_label", "reference", "formula", "identifier", "logo", "other",
)
TRANSLATED_ROLES = ("TITLE", "ABSTRACT", "BODY", "H1", "H2", "H3", "CAPTION", "TABLE_TEXT", "TABLE_NOTE", "FOOTNOTE", "AFFILIATION", "OTHER")
KEPT_ROLES = ("FIGURE_INTERNAL", "REFERENCE", "DOI_URL", "FORMULA", "STATISTIC")
RETAIN_REASONS = ("AUTHOR_NAME", "REFERENCE_ENTRY", "FORMULA", "IDENTIFIER", "JOURNAL_LOGO", "TRADEMARK", "SOURCE_GAP", "FIGURE_INTERNAL", "STATISTIC")
EXPANDABLE_KINDS = ("abstract", "body", "caption", "footnote")
FIT_STATUSES = ("FIT", "OVERFLOW", "SOURCE_GAP", "RETAINED")
LEAST_SCALE, MOST_SCALE, MOST_BODY_SCALE = 0.95, 1.0, 1.10
BOX_TOLERANCE = 0.25
SECTIONS = ("INTRODUCTION", "METHODS", "RESULTS", "DISCUSSION", "INNOVATION", "LIMITATIONS", "REDESIGN", "TRANSFER")
CLAIM_CLASSES = ("CLM", "AN", "AUD", "HYPOTHESIS")
CORE_FIGURES = ("DESIGN", "METHOD", "CORE_RESULT", "MECHANISM", "ROBUSTNESS", "NULL")
OTHER_FIGURES = ("SUPPORTING", "NONESSENTIAL")
SIZE_RATIOS, LEADING_RATIOS = (0.95, 1.10), (1.15, 1.45)


def filled(c: str | Column) -> Column:
    return text_or_blank(F.col(c) if isinstance(c, str) else c) != ""


def _example(*keys: str) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])


def repeated(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Filled keys that more than one row has, once each."""
    held = df
    for k in keys:
        held = held.where(F.col(k).isNotNull())
    return held.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(code).alias("code"), _example(*keys).alias("example"))


def unknown(df: DataFrame, known: DataFrame, keys: Mapping[str, str], code: str, example: Sequence[str] = ()) -> DataFrame:
    """Rows whose keys (column -> column of ``known``) no row of ``known`` has; null keys are unknown."""
    k = known.select(*[F.col(b).alias(a) for a, b in keys.items()]).distinct()
    return df.join(k, list(keys), "left_anti").select(F.lit(code).alias("code"), _example(*(example or keys)).alias("example"))


def uncovered(expected: DataFrame, found: DataFrame, keys: Sequence[str], code: str, compare: Sequence[str] = ()) -> DataFrame:
    """Keys MISSING, EXTRA or with other values, once each."""
    d = coverage.coverage(expected, found, keys, compare)
    return d.select(F.lit(code).alias("code"), F.concat_ws(" ", "issue", _example(*keys)).alias("example"))


def gaps(df: DataFrame, number: str, code: str) -> DataFrame:
    """One offender if the distinct positive numbers are not 1 to their count."""
    per = df.where(F.col(number) > 0).agg(F.max(number).alias("hi"), F.countDistinct(number).alias("n"))
    return per.where("hi <> n").select(F.lit(code).alias("code"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("hi").cast("string")).alias("example"))


# -- inventory, frames, ledger ----------------------------------------------------------------------------------------


def inventory_suite(sources: DataFrame, pages: DataFrame, objects: DataFrame, cells: DataFrame) -> DataFrame:
    """Sources (source_id, role, page_count, pdf_path, language_authority, geometry_authority), their pages (source_id, source_page,
    output_page, boxes, rotation, frame_ids, object_ids), objects (object_id, kind, source_id, source_page, bbox_pt, label_frame_ids,
    rows, columns) and table cells (object_id, row, column, bbox_pt, frame_id)."""
    sid = F.col("source_id")
    rows = offenders(sources, [
        Check("SOURCE_ID", filled("source_id"), sid), Check("SOURCE_ROLE", F.col("role").isin(*GEOMETRY_OF_ROLE), sid), Check("PAGE_COUNT", F.col("page_count") > 0, sid), Check("PDF_PATH", filled("pdf_path"), sid),
        Check("LANGUAGE_AUTHORITY", F.col("language_authority").isin(*LANGUAGE_AUTHORITIES), sid), Check("GEOMETRY_AUTHORITY", F.col("geometry_authority") == N.mapped(F.col("role"), GEOMETRY_OF_ROLE, ""), sid),
    ])
    page, at = _example("source_id", "source_page"), ["source_id", "source_page"]
    of_pages = offenders(pages, [
        Check("PAGE_KEY", filled("source_id") & (F.col("source_page") > 0), page), Check("OUTPUT_PAGE", F.col("output_page") > 0, page),
        Check("PAGE_BOXES", (F.size("boxes") == 5) & F.forall("boxes", N.is_box), page), Check("PAGE_ROTATION", F.col("rotation").isin(*ROTATIONS), page),
        Check("PAGE_LISTS", F.forall("frame_ids", lambda i: text_or_blank(i) != "") & F.forall("object_ids", lambda i: text_or_blank(i) != ""), page),
    ])
    expected = sources.where("page_count > 0").select("source_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("source_page"))
    frames = pages.select(F.explode("frame_ids").alias("frame_id"))
    listed = pages.select(F.explode("object_ids").alias("object_id"))
    oid, cell = F.col("object_id"), _example("object_id", "row", "column")
    table = F.col("kind") == "table"
    of_objects = offenders(objects, [
        Check("OBJECT_ID", filled("object_id"), oid), Check("OBJECT_KIND", F.col("kind").isin("figure", "table"), oid), Check("OBJECT_BOX", N.is_box(F.col("bbox_pt")), oid),
        Check("TABLE_STRUCTURE", ~table | ((F.col("rows") > 0) & (F.col("columns") > 0)), oid),
    ])
    of_cells = offenders(cells, [Check("CELL_PLACE", (F.col("row") > 0) & (F.col("column") > 0), cell), Check("CELL_BOX", N.is_box(F.col("bbox_pt")), cell)])
    labels = objects.select("object_id", F.explode(F.coalesce("label_frame_ids", F.array().cast("array<string>"))).alias("frame_id"))
    return suite(
        ("SOURCE_ID", "SOURCE_REPEATED", "SOURCE_ROLE", "PAGE_COUNT", "PDF_PATH", "LANGUAGE_AUTHORITY", "GEOMETRY_AUTHORITY", "PAGE_KEY", "PAGE_REPEATED", "PAGE_COVERAGE", "OUTPUT_PAGE", "OUTPUT_REPEATED", "OUTPUT_SEQUENCE", "PAGE_BOXES",
         "PAGE_ROTATION", "PAGE_LISTS", "OBJECT_ID", "OBJECT_REPEATED", "OBJECT_KIND", "OBJECT_PAGE", "OBJECT_BOX", "OBJECT_LABELS", "OBJECT_COVERAGE", "TABLE_STRUCTURE", "TABLE_CELLS", "CELL_PLACE", "CELL_BOX", "CELL_FRAME"),
        rows, repeated(sources, ["source_id"], "SOURCE_REPEATED"), of_pages, repeated(pages, at, "PAGE_REPEATED"), uncovered(expected, pages, at, "PAGE_COVERAGE"), repeated(pages, ["output_page"], "OUTPUT_REPEATED"),
        gaps(pages, "output_page", "OUTPUT_SEQUENCE"),
        of_objects, repeated(objects, ["object_id"], "OBJECT_REPEATED"), unknown(objects, pages, dict(zip(at, at)), "OBJECT_PAGE", ["object_id"]), unknown(labels, frames, {"frame_id": "frame_id"}, "OBJECT_LABELS", ["object_id", "frame_id"]),
        uncovered(listed, objects.select("object_id"), ["object_id"], "OBJECT_COVERAGE"), unknown(objects.where(table), cells, {"object_id": "object_id"}, "TABLE_CELLS"), of_cells, unknown(cells, frames, {"frame_id": "frame_id"}, "CELL_FRAME", ["object_id", "frame_id"]),
    )


def frame_suite(frames: DataFrame, pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Text frames against the pages (source_id, source_page) and the frame ids that these list (``listed``: frame_id), with the rules between role, action and flags."""
    fid, role, action = F.col("frame_id"), F.col("frame_role"), F.col("translation_action")
    translate = action == "TRANSLATE"
    rows = offenders(frames, [
        Check("FRAME_ID", filled("frame_id"), fid), Check("FRAME_UNIT", filled("unit_id"), fid), Check("FRAME_KIND", F.col("frame_kind").isin(*FRAME_KINDS), fid), Check("FRAME_ROLE", role.isin(*TRANSLATED_ROLES, *KEPT_ROLES), fid),
        Check("ROLE_FLAG", ~role.isin(*KEPT_ROLES) | ~F.col("translatable"), fid), Check("FRAME_BOX", N.is_box(F.col("bbox_pt")), fid), Check("FRAME_ROTATION", F.col("rotation").isin(*ROTATIONS), fid),
        Check("READING_ORDER", F.col("reading_order") > 0, fid), Check("FRAME_FONT", filled("source_font"), fid), Check("FRAME_SIZE", N.is_finite(F.col("source_font_size_pt")) & (F.col("source_font_size_pt") > 0), fid),
        Check("FRAME_ACTION", action.isin(*ACTIONS), fid), Check("ACTION_FLAG", F.col("translatable") == translate, fid),
    ])
    at = ["source_id", "source_page"]
    return suite(
        ("FRAME_ID", "FRAME_REPEATED", "FRAME_UNIT", "FRAME_KIND", "FRAME_ROLE", "ROLE_FLAG", "FRAME_PAGE", "FRAME_BOX", "FRAME_ROTATION", "READING_ORDER", "FRAME_FONT", "FRAME_SIZE", "FRAME_ACTION", "ACTION_FLAG", "FRAME_COVERAGE"),
        rows, repeated(frames, ["frame_id"], "FRAME_REPEATED"), unknown(frames, pages, dict(zip(at, at)), "FRAME_PAGE", ["frame_id"]), uncovered(listed, frames.select("frame_id"), ["frame_id"], "FRAME_COVERAGE"),
    )


def ledger_suite(ledger: DataFrame, frames: DataFrame, issues: DataFrame) -> DataFrame:
    """Ledger units (unit_id, frame_id, source_id, source_page, source_text, translated_text, font_scale, fit_status, issue_ids) against frames and issues.

    Every frame to translate is in exactly one unit, on the frame's page; the scale allowed depends on the frame's kind.
    """
    uid = F.col("unit_id")
    f = frames.select("frame_id", F.col("source_id").alias("_s"), F.col("source_page").alias("_p"), F.col("frame_kind").alias("_k"), F.col("translation_action").alias("_a")).dropDuplicates(["frame_id"])
    met = ledger.join(f, "frame_id", "left")
    most = F.when(F.col("_k").isin(*EXPANDABLE_KINDS), MOST_BODY_SCALE).otherwise(MOST_SCALE)
    rows = offenders(met, [
        Check("UNIT_ID", filled("unit_id"), uid), Check("UNIT_FRAME", F.col("_a") == "TRANSLATE", uid), Check("UNIT_PLACE", F.col("_a").isNull() | ((F.col("source_id") == F.col("_s")) & (F.col("source_page") == F.col("_p"))), uid),
        Check("UNIT_TEXTS", filled("source_text") & filled("translated_text"), uid), Check("UNIT_SCALE", F.col("font_scale").between(F.lit(LEAST_SCALE), most), uid), Check("UNIT_FIT", F.col("fit_status").isin(*FIT_STATUSES), uid),
    ])
    translated = f.where("_a = 'TRANSLATE'").select("frame_id")
    cited = ledger.select("unit_id", F.explode(F.coalesce("issue_ids", F.array().cast("array<string>"))).alias("issue_id"))
    return suite(
        ("UNIT_ID", "UNIT_REPEATED", "UNIT_FRAME", "FRAME_IN_TWO_UNITS", "UNIT_PLACE", "UNIT_TEXTS", "UNIT_SCALE", "UNIT_FIT", "UNIT_ISSUE", "UNIT_COVERAGE"),
        rows, repeated(ledger, ["unit_id"], "UNIT_REPEATED"), repeated(ledger, ["frame_id"], "FRAME_IN_TWO_UNITS"), unknown(cited, issues, {"issue_id": "issue_id"}, "UNIT_ISSUE", ["unit_id", "issue_id"]),
        translated.join(ledger.select("frame_id").distinct(), "frame_id", "left_anti").select(F.lit("UNIT_COVERAGE").alias("code"), F.col("frame_id").alias("example")),
    )


def link_suite(units: DataFrame, pages: DataFrame, *, unit: str, listed: str) -> DataFrame:
    """Both ways between things (``unit``, source_id, source_page) and the pages that list them (column ``listed``): LISTED_ELSEWHERE, NOT_LISTED, LISTED_UNKNOWN, LISTED_TWICE."""
    at = ["source_id", "source_page"]
    said = pages.select(*at, F.explode(listed).alias(unit))
    there = units.select(unit, F.col("source_id").alias("_s"), F.col("source_page").alias("_p")).dropDuplicates([unit])
    met = said.join(there, unit, "left")
    wrong = met.where(F.col("_s").isNotNull() & ~((F.col("_s") == F.col("source_id")) & (F.col("_p") == F.col("source_page"))))
    example = lambda df, code: df.select(F.lit(code).alias("code"), F.col(unit).cast("string").alias("example"))
    return suite(
        ("LISTED_ELSEWHERE", "NOT_LISTED", "LISTED_UNKNOWN", "LISTED_TWICE"),
        example(wrong, "LISTED_ELSEWHERE"), unknown(units, said, {unit: unit}, "NOT_LISTED"), unknown(said, units, {unit: unit}, "LISTED_UNKNOWN"), repeated(said, [unit], "LISTED_TWICE"),
    )


def plan_suite(plan_pages: DataFrame, regions: DataFrame, frames: DataFrame, pages: DataFrame) -> DataFrame:
    """A layout plan (output_page, source_id, source_page, strategy, extension_page, rotation, render_checked) and its regions
    (output_page, frame_id, bbox_pt) against frames and source pages: one page each, every translated frame's box within the tolerance."""
    page = _example("output_page")
    at = ["source_id", "source_page"]
    rows = offenders(plan_pages, [
        Check("PLAN_PAGE", F.col("output_page") > 0, page), Check("PLAN_STRATEGY", F.col("strategy") == "exact-text-frame", page), Check("PLAN_EXTENSION", F.col("extension_page") == F.lit(False), page),
        Check("PLAN_ROTATION", F.col("rotation").isin(*ROTATIONS), page), Check("PLAN_CHECKED", F.col("render_checked"), page),
    ])
    wanted = frames.where("translation_action = 'TRANSLATE'").select("frame_id", F.col("bbox_pt").alias("_b")).dropDuplicates(["frame_id"])
    placed = regions.select("frame_id", F.col("bbox_pt").alias("_r")).dropDuplicates(["frame_id"])
    off = wanted.join(placed, "frame_id", "full_outer").where(~F.coalesce(N.boxes_match(F.col("_b"), F.col("_r"), BOX_TOLERANCE), F.lit(False)))
    return suite(
        ("PLAN_PAGE", "PLAN_REPEATED", "PLAN_SEQUENCE", "PLAN_STRATEGY", "PLAN_EXTENSION", "PLAN_ROTATION", "PLAN_CHECKED", "PLAN_ONE_TO_ONE", "PLAN_COVERAGE", "REGION_PAGE", "REGION_REPEATED", "REGION_BOX", "REGION_MATCH"),
        rows, repeated(plan_pages, ["output_page"], "PLAN_REPEATED"), gaps(plan_pages, "output_page", "PLAN_SEQUENCE"),
        repeated(plan_pages, at, "PLAN_ONE_TO_ONE"), uncovered(pages, plan_pages, at, "PLAN_COVERAGE"), unknown(regions, plan_pages, {"output_page": "output_page"}, "REGION_PAGE", ["frame_id"]),
        repeated(regions, ["frame_id"], "REGION_REPEATED"), offenders(regions, [Check("REGION_BOX", N.is_box(F.col("bbox_pt")), F.col("frame_id"))]), off.select(F.lit("REGION_MATCH").alias("code"), F.col("frame_id").alias("example")),
    )


def settings_suite(settings: DataFrame, fixed: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Settings (name, value) that must have fixed values, or just some value: one check each, failed where absent, null or other."""
    want = settings.sparkSession.createDataFrame([(n, fixed.get(n)) for n in dict.fromkeys([*fixed, *required])], "name string, want string")
    have = settings.groupBy("name").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    j = want.join(have, "name", "left")
    ok = (F.col("n") == 1) & filled("value") & (F.col("want").isNull() | (F.col("want") == F.col("value")))
    bad = j.where(~F.coalesce(ok, F.lit(False))).select(F.col("name").alias("code"), F.coalesce("value", F.lit("absent")).alias("example"))
    return suite([*dict.fromkeys([*fixed, *required])], bad)


# -- numbers, figures, conflicts, issues --------------------------------------------------------------------------------


def whitelist_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, offenders) of a whitelist (unit_id, kind, source_token, translated_token, reason, reviewer, reviewed_date): tokens in canonical form, units trimmed; no kind is PAIR."""
    kind = F.upper(F.coalesce(F.nullif(strip(F.col("kind")), F.lit("")), F.lit("PAIR")))
    ok = filled("unit_id") & filled("reason") & filled("reviewer") & N.is_iso_date(F.col("reviewed_date")) & kind.isin("PAIR", "MISSING", "ADDED")
    ok = ok & ((kind == "ADDED") | filled("source_token")) & ((kind == "MISSING") | filled("translated_token"))
    ok = F.coalesce(ok, F.lit(False))
    token = lambda c: N.canon_number(F.col(c))
    valid = rows.where(ok).select(strip(F.col("unit_id")).alias("unit_id"), kind.alias("kind"), token("source_token").alias("source_token"), token("translated_token").alias("translated_token"))
    return valid, rows.where(~ok).select(F.lit("WHITELIST").alias("code"), F.coalesce("unit_id", F.lit("")).alias("example"))


def numeric_suite(ledger: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Numbers of source_text that translated_text of a unit (unit_id, source_id, source_page) lacks or adds, after the whitelist and after units of one page are set off."""
    valid, broken = whitelist_rows(whitelist)
    left = numeric_residuals(ledger, page=["source_id", "source_page"], unit="unit_id", source="source_text", target="translated_text", allowed=valid)
    side = lambda c, code: left.where(F.col(c) > 0).select(F.lit(code).alias("code"), F.concat_ws(" ", "unit_id", "token").alias("example"))
    return suite(("NUMBER_MISSING", "NUMBER_ADDED", "WHITELIST"), side("missing", "NUMBER_MISSING"), side("added", "NUMBER_ADDED"), broken)


def figure_text_suite(rows: DataFrame, objects: DataFrame, frames: DataFrame, ledger: DataFrame) -> DataFrame:
    """Figure labels (frame_id, figure_id, bbox_pt, translated_text, reviewed, rendered, validated) against the labels that figures list, their frames' boxes and the ledger's text."""
    expected = objects.where("kind = 'figure'").select(F.explode("label_frame_ids").alias("frame_id"), F.col("object_id").alias("_figure"))
    f = frames.select("frame_id", F.col("frame_kind").alias("_k"), F.col("bbox_pt").alias("_b"), F.col("unit_id").alias("_u")).dropDuplicates(["frame_id"])
    l = ledger.select(F.col("unit_id").alias("_u"), F.col("translated_text").alias("_t")).dropDuplicates(["_u"])
    met = rows.join(f, "frame_id", "left").join(expected, "frame_id", "left").join(l, "_u", "left")
    fid = F.col("frame_id")
    return suite(
        ("LABEL_REPEATED", "LABEL_FRAME", "LABEL_FIGURE", "LABEL_BOX", "LABEL_TEXT", "LABEL_REVIEW", "LABEL_COVERAGE"),
        repeated(rows, ["frame_id"], "LABEL_REPEATED"),
        offenders(met, [
            Check("LABEL_FRAME", F.col("_k") == "figure_label", fid), Check("LABEL_FIGURE", F.col("_figure") == F.col("figure_id"), fid), Check("LABEL_BOX", F.col("_b") == F.col("bbox_pt"), fid),
            Check("LABEL_TEXT", filled("translated_text") & (F.col("_t") == F.col("translated_text")), fid), Check("LABEL_REVIEW", F.col("reviewed") & F.col("rendered") & F.col("validated"), fid),
        ]),
        uncovered(expected.select("frame_id"), rows.select("frame_id"), ["frame_id"], "LABEL_COVERAGE"),
    )


def conflict_suite(conflicts: DataFrame, ledger: DataFrame, *, conflict_id: str = r"^CONFLICT-\d{3,}$") -> DataFrame:
    """Conflicts between sources (conflict_id, source_values, unit_ids, preserved_separately) must stay: two values or more in the source, and in what the units say of them."""
    canon = lambda c: F.size(F.array_distinct(F.transform(c, N.canon_number)))
    cid = F.col("conflict_id")
    rows = offenders(conflicts, [
        Check("CONFLICT_ID", cid.rlike(conflict_id), cid), Check("CONFLICT_VALUES", canon(F.col("source_values")) >= 2, cid), Check("CONFLICT_UNITS", F.size("unit_ids") >= 2, cid), Check("CONFLICT_KEPT", F.col("preserved_separately"), cid),
    ])
    cited = conflicts.select("conflict_id", F.explode("unit_ids").alias("unit_id"))
    said = cited.join(ledger.select("unit_id", "translated_text"), "unit_id").groupBy("conflict_id").agg(F.countDistinct(N.canon_number(F.coalesce("translated_text", F.lit("")))).alias("n")).where("n < 2")
    return suite(
        ("CONFLICT_ID", "CONFLICT_VALUES", "CONFLICT_UNITS", "CONFLICT_KEPT", "CONFLICT_UNKNOWN", "CONFLICT_SAID"),
        rows, unknown(cited, ledger, {"unit_id": "unit_id"}, "CONFLICT_UNKNOWN", ["conflict_id", "unit_id"]), said.select(F.lit("CONFLICT_SAID").alias("code"), cid.alias("example")),
    )


def issue_suite(issues: DataFrame) -> DataFrame:
    """Issues (issue_id, status, completion_impact): open ones with an impact block."""
    i = F.col("issue_id")
    return suite(
        ("ISSUE_ID", "ISSUE_REPEATED", "ISSUE_STATUS", "ISSUE_IMPACT", "ISSUE_OPEN"), repeated(issues, ["issue_id"], "ISSUE_REPEATED"),
        offenders(issues, [
            Check("ISSUE_ID", filled("issue_id"), i), Check("ISSUE_STATUS", F.col("status").isin("OPEN", "RESOLVED"), i), Check("ISSUE_IMPACT", F.col("completion_impact").isin("NONE", "PROVISIONAL", "BLOCKED"), i),
            Check("ISSUE_OPEN", ~F.coalesce((F.col("status") == "OPEN") & F.col("completion_impact").isin("PROVISIONAL", "BLOCKED"), F.lit(False)), i),
        ]),
    )


# -- style --------------------------------------------------------------------------------------------------------------


def style_records_suite(records: DataFrame, styles: DataFrame) -> DataFrame:
    """Records (frame_id, role, language, font_size_pt, style_name, alignment, first_line_indent_pt, exact_mirror, overflow, clipping, has_exception) against
    ``styles`` (role, language, style_name, alignment, indent_em): names, alignment and indents (within the tolerance) as the style says; in an exact mirror only Chinese body text must follow."""
    zh = F.lower(F.col("language")).startswith("zh")
    s = styles.select(F.col("role"), F.col("language").alias("_l"), F.col("style_name").alias("_n"), F.col("alignment").alias("_a"), F.col("indent_em").alias("_i"))
    r = records.withColumn("role", F.upper(F.col("role"))).withColumn("_l", F.when(F.coalesce(zh, F.lit(True)), "zh").otherwise("en")).join(s, ["role", "_l"], "left")
    free = F.coalesce(F.col("has_exception"), F.lit(False))
    bound = ~F.coalesce(F.col("exact_mirror"), F.lit(False)) | ((F.col("role") == "BODY") & (F.col("_l") == "zh"))
    fid = F.col("frame_id")
    indent = F.abs(F.coalesce("first_line_indent_pt", F.lit(0.0)) - F.col("_i") * F.col("font_size_pt"))
    rows = offenders(r, [
        Check("STYLE_NAME", (F.col("font_size_pt") > 0) & (free | (F.col("style_name") == F.col("_n"))), fid), Check("STYLE_ALIGNMENT", ~bound | free | (F.col("alignment") == F.col("_a")), fid),
        Check("STYLE_INDENT", ~bound | free | (indent <= BOX_TOLERANCE), fid), Check("STYLE_FIT", ~(F.coalesce(F.col("overflow"), F.lit(False)) | F.coalesce(F.col("clipping"), F.lit(False))), fid),
    ])
    return suite(("STYLE_NAME", "STYLE_ALIGNMENT", "STYLE_INDENT", "STYLE_FIT"), rows)


def style_map_suite(style_map: DataFrame, frames: DataFrame) -> DataFrame:
    """A style map (role, median_size, size_low, size_high, leading_low, leading_high) against the roles that frames use; headings stay larger than body text."""
    used = frames.select("frame_role").distinct()
    role = F.col("role")
    inside = lambda low, high, most: (F.col(low) >= most[0]) & (F.col(high) <= most[1]) & (F.col(low) <= F.col(high))
    sizes = style_map.agg(F.max(F.when(role.isin("TITLE", "H1", "H2", "H3", "HEADING"), F.col("median_size"))).alias("h"), F.max(F.when(role == "BODY", F.col("median_size"))).alias("b"))
    return suite(
        ("ROLE_UNMAPPED", "SIZE_RANGE", "LEADING_RANGE", "HEADING_SIZE"), unknown(used, style_map, {"frame_role": "role"}, "ROLE_UNMAPPED"),
        offenders(style_map.join(used, role == F.col("frame_role"), "left_semi"), [Check("SIZE_RANGE", inside("size_low", "size_high", SIZE_RATIOS), role), Check("LEADING_RANGE", inside("leading_low", "leading_high", LEADING_RATIOS), role)]),
        sizes.where("h <= b").select(F.lit("HEADING_SIZE").alias("code"), F.col("h").cast("string").alias("example")),
    )


def rendered_style_suite(frames: DataFrame, rendered: DataFrame, style_map: DataFrame, *, same: Sequence[str] = ("weight",)) -> DataFrame:
    """Rendered styles (frame_id, font_size_pt, leading_pt, columns of ``same``) of translated frames: size and leading within the role's range (to 0.001), the columns of ``same`` kept. Also the audit of a glyph table, once it is reduced to a row a frame."""
    r = rendered.select("frame_id", F.col("font_size_pt").alias("_size"), F.col("leading_pt").alias("_leading"), *[F.col(c).alias(f"_r_{c}") for c in same], F.lit(True).alias("_there"))
    d = frames.where("translation_action = 'TRANSLATE'").join(r, "frame_id", "left").join(style_map.select(F.col("role").alias("frame_role"), "size_low", "size_high", "leading_low", "leading_high"), "frame_role", "left")
    size, leading, e, fid = F.col("_size") / F.col("source_font_size_pt"), F.col("_leading") / F.col("_size"), 1e-3, F.col("frame_id")
    there = F.col("_there").isNull()
    return suite(
        ("STYLE_RENDERED", "STYLE_SIZE", "STYLE_LEADING", "STYLE_KEPT"),
        offenders(d, [
            Check("STYLE_RENDERED", F.col("_there"), fid), Check("STYLE_SIZE", there | size.between(F.col("size_low") - e, F.col("size_high") + e), fid), Check("STYLE_LEADING", there | leading.between(F.col("leading_low") - e, F.col("leading_high") + e), fid),
            Check("STYLE_KEPT", there | F.forall(F.array(*[F.col(c).cast("string").eqNullSafe(F.col(f"_r_{c}").cast("string")) for c in same]), lambda x: x), fid),
        ]),
    )


# -- evidence of a reading ------------------------------------------------------------------------------------------------


def narrative_suite(sections: DataFrame, claims: DataFrame, required: DataFrame) -> DataFrame:
    """Sections (name, prose, source_anchors), claims (claim_id, claim_class, prose, source_anchor) and the claims that must be closed (claim_id): every section and class is there, with substantive prose and anchors."""
    spark, c, n = sections.sparkSession, F.col("claim_id"), F.col("name")
    named = lambda values, column: spark.createDataFrame([(v,) for v in values], f"{column} string")
    return suite(
        ("SECTION_MISSING", "SECTION_PROSE", "SECTION_ANCHOR", "CLAIM_CLASS", "CLAIM_CLOSED", "CLAIM_REQUIRED"),
        unknown(named(SECTIONS, "name"), sections, {"name": "name"}, "SECTION_MISSING"),
        offenders(sections.where(n.isin(*SECTIONS)), [Check("SECTION_PROSE", N.is_substantive(F.col("prose")), n), Check("SECTION_ANCHOR", F.size("source_anchors") > 0, n)]),
        unknown(named(CLAIM_CLASSES, "claim_class"), claims.select(F.upper("claim_class").alias("claim_class")), {"claim_class": "claim_class"}, "CLAIM_CLASS"),
        offenders(claims, [Check("CLAIM_CLOSED", filled("claim_id") & N.is_substantive(F.col("prose")) & filled("source_anchor"), c)]), unknown(required.where(filled("claim_id")), claims, {"claim_id": "claim_id"}, "CLAIM_REQUIRED"),
    )


def figure_suite(figures: DataFrame, sources: DataFrame) -> DataFrame:
    """Figures (figure_id, category, source_anchor, embedded, image_path, translated_caption, interpretation) against the source's figures (figure_id): core ones are embedded, captioned and interpreted."""
    core, i = F.col("category").isin(*CORE_FIGURES), F.col("figure_id")
    return suite(
        ("FIGURE_CATEGORY", "FIGURE_ANCHOR", "FIGURE_EMBEDDED", "FIGURE_IMAGE", "FIGURE_CAPTION", "FIGURE_READ", "FIGURE_OMITTED"),
        offenders(figures, [
            Check("FIGURE_CATEGORY", F.col("category").isin(*CORE_FIGURES, *OTHER_FIGURES), i), Check("FIGURE_ANCHOR", filled("source_anchor"), i), Check("FIGURE_EMBEDDED", ~core | F.col("embedded"), i),
            Check("FIGURE_IMAGE", ~core | filled("image_path"), i), Check("FIGURE_CAPTION", ~core | filled("translated_caption"), i), Check("FIGURE_READ", ~core | N.is_substantive(F.col("interpretation")), i),
        ]),
        unknown(sources, figures, {"figure_id": "figure_id"}, "FIGURE_OMITTED"),
    )


def mapping_suite(mapping: DataFrame, required: DataFrame, *, source_id: str = "^SRC-", locator: str = r"(?i)p\.|page|fig|table|section|supp") -> DataFrame:
    """A source mapping (source_id, source_locator, notebook_section, claim_id, coverage_type) and the claims (claim_id) that it must cover."""
    fields = ("source_id", "source_locator", "notebook_section", "claim_id", "coverage_type")
    full = F.forall(F.array(*[text_or_blank(F.col(f)) for f in fields]), lambda v: v != "")
    return suite(
        ("MAPPING_FILLED", "MAPPING_LOCATOR", "MAPPING_COVERAGE"), unknown(required, mapping, {"claim_id": "claim_id"}, "MAPPING_COVERAGE"),
        offenders(mapping, [Check("MAPPING_FILLED", full, F.col("claim_id")), Check("MAPPING_LOCATOR", F.col("source_id").rlike(source_id) & F.col("source_locator").rlike(locator), F.col("claim_id"))]),
    )


def review_suite(comment: DataFrame, claims: DataFrame, judgments: DataFrame, gates: DataFrame, *, shortest: int, longest: int, marks: str) -> DataFrame:
    """A public review: comments (review_id, text), their claims (review_id, paragraph_index, claim_id, text, source_class), the judgments of
    claims (claim_id, status, reason, text_sha256) and gates (gate, status, evidence, claim_ids).

    Length in visible characters, 3 to 5 paragraphs, no internal marks; paragraph i has the claims mapped to it, word for word; claims and
    judgments are the same set, bound by the hash of the text; gates pass with evidence and known claims.
    """
    rid, cid = F.col("review_id"), F.col("claim_id")
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")
    c = comment.withColumn("_parts", parts).withColumn("_n", N.visible_length(N.visible_text(F.coalesce("text", F.lit("")))))
    rows = offenders(c, [Check("REVIEW_LENGTH", F.col("_n").between(shortest, longest), rid), Check("REVIEW_PARAGRAPHS", F.size("_parts").between(3, 5), rid), Check("REVIEW_MARKS", F.size(N.marks_found(F.col("text"), marks)) == 0, rid)])
    paragraphs = c.select("review_id", F.posexplode("_parts").alias("_i", "_paragraph")).withColumn("paragraph_index", F.col("_i") + 1)
    met = claims.join(paragraphs, ["review_id", "paragraph_index"], "left")
    bound = claims.select("claim_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")).join(judgments, "claim_id", "full_outer")
    return suite(
        ("REVIEW_LENGTH", "REVIEW_PARAGRAPHS", "REVIEW_MARKS", "PARAGRAPH_CLAIMED", "CLAIM_REPEATED", "CLAIM_TEXT", "CLAIM_SOURCE", "CLAIM_JUDGED", "GATE_PASSED", "GATE_CLAIMS"),
        rows, unknown(paragraphs, claims, {"review_id": "review_id", "paragraph_index": "paragraph_index"}, "PARAGRAPH_CLAIMED"), repeated(claims, ["claim_id"], "CLAIM_REPEATED"),
        offenders(met, [Check("CLAIM_TEXT", filled("text") & F.contains("_paragraph", "text"), cid), Check("CLAIM_SOURCE", F.col("source_class") == "MAIN", cid)]),
        offenders(bound, [Check("CLAIM_JUDGED", (F.col("_sha") == F.col("text_sha256")) & (F.col("status") == "PASS") & filled("reason"), cid)]),
        offenders(gates, [Check("GATE_PASSED", (F.col("status") == "PASS") & filled("evidence") & (F.size("claim_ids") > 0), F.col("gate"))]),
        unknown(gates.select("gate", F.explode("claim_ids").alias("claim_id")), claims, {"claim_id": "claim_id"}, "GATE_CLAIMS", ["gate", "claim_id"]),
    )


def same_text_suite(wanted: DataFrame, found: DataFrame, *, key: str, text: str, code: str) -> DataFrame:
    """Texts that must be equal whatever their white space (a canonical abstract, a reviewer's name); absent ones differ."""
    d = wanted.select(key, N.without_space(F.col(text)).alias("_w")).join(found.select(key, N.without_space(F.col(text)).alias("_f")), key, "left")
    return suite((code,), offenders(d, [Check(code, F.col("_w") == F.col("_f"), F.col(key))]))


# -- files ----------------------------------------------------------------------------------------------------------------


def binding_suite(records: DataFrame, files: DataFrame, identities: DataFrame) -> DataFrame:
    """Bound files (source_id, source_type, availability, path, sha256, size) against what is there (path, sha256, size), and identities
    (name, actual, expected): hashes and sizes agree and are known, exactly one MAIN, identity parts filled and equal."""
    wanted = records.where(F.col("source_type").isin("MAIN", "SI") & (F.col("availability") == "AVAILABLE"))
    have = files.select("path", F.col("sha256").alias("_h"), F.col("size").alias("_n"), F.lit(True).alias("_there"))
    met = wanted.join(have, "path", "left")
    sid = F.col("source_id")
    mains = wanted.agg(F.count_if(F.col("source_type") == "MAIN").alias("n")).where("n <> 1")
    return suite(
        ("FILE_PRESENT", "FILE_SAME", "ONE_MAIN", "IDENTITY"), mains.select(F.lit("ONE_MAIN").alias("code"), F.col("n").cast("string").alias("example")),
        offenders(met, [Check("FILE_PRESENT", F.col("_there"), sid), Check("FILE_SAME", F.col("_there").isNull() | ((F.col("_h") == F.col("sha256")) & (F.col("_n") == F.col("size"))), sid)]),
        offenders(identities, [Check("IDENTITY", filled("expected") & (F.col("actual") == F.col("expected")), F.col("name"))]),
    )


def relationship_suite(members: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of a package (package, target, external) that lead to no member (package, name), and required parts that are missing."""
    inside = relations.where(~F.coalesce(F.col("external"), F.lit(False)))
    return suite(("RELATION_TARGET", "MEMBER_REPEATED"), unknown(inside, members, {"package": "package", "target": "name"}, "RELATION_TARGET"), repeated(members, ["package", "name"], "MEMBER_REPEATED"))


def visual_suite(pages: DataFrame, images: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Reviewed pages (document, page, reviewed, flags) against rendered images (document, name) in the order of their names: as many, in sequence, no flag raised."""
    numbered = images.select("document", F.row_number().over(Window.partitionBy("document").orderBy("name")).alias("page"))
    at = ["document", "page"]
    clear = F.forall(F.array(*[F.coalesce(~F.col(f), F.lit(False)) for f in flags]), lambda x: x)
    return suite(
        ("PAGE_REVIEWED", "PAGE_FLAGS", "PAGE_IMAGES", "PAGE_REPEATED"), uncovered(numbered, pages, at, "PAGE_IMAGES"), repeated(pages, at, "PAGE_REPEATED"),
        offenders(pages, [Check("PAGE_REVIEWED", F.col("reviewed"), _example(*at)), Check("PAGE_FLAGS", clear, _example(*at))]),
    )


def metadata_suite(parts: DataFrame, properties: DataFrame, *, author: str = "", forbidden: str, empty: Sequence[str] = ("lastModifiedBy", "keywords", "description", "subject")) -> DataFrame:
    """Parts (document, name, text) and core properties (document, name, value) of documents made public: no comments, the author as expected, other properties empty, no forbidden mark in a property part."""
    doc = F.col("document")
    core = parts.where("name = 'docProps/core.xml'").select("document")
    held = properties.groupBy("document").agg(*[F.max(F.when(F.col("name") == n, strip(F.col("value")))).alias(f"_{n}") for n in ("creator", *empty)])
    known = parts.select("document").distinct().join(held, "document", "left")
    prop = F.col("name").rlike(r"^docProps/.*\.xml$")
    return suite(
        ("CORE_MISSING", "COMMENTS", "AUTHOR", "PROPERTIES", "FORBIDDEN"), unknown(parts.select("document").distinct(), core, {"document": "document"}, "CORE_MISSING"),
        offenders(parts, [Check("COMMENTS", ~F.lower("name").startswith("word/comments"), doc), Check("FORBIDDEN", ~prop | (F.size(N.marks_found(F.col("text"), forbidden)) == 0), doc)]),
        offenders(known, [Check("AUTHOR", F.coalesce("_creator", F.lit("")) == F.lit(author), doc), Check("PROPERTIES", F.concat(*[F.coalesce(f"_{n}", F.lit("")) for n in empty]) == "", doc)]),
    )
