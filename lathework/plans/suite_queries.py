"""Validator suites on the test tables, with their SQL.

The package tables are projections of the frame inventory: pages are the pages of frames still there, so that sources
whose pages lost all their frames break coverage; the listing of frames and the ledger are the uses of terms in papers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, ordered, suites
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "text_frame_inventory")


def _live(frames: DataFrame) -> DataFrame:
    return frames.where("removed_at IS NULL AND source_id IS NOT NULL AND source_page IS NOT NULL")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "paper_terminology").where("trim(coalesce(frame_id, '')) <> ''").select(F.upper(F.trim("frame_id")).alias("frame_id"))


def frame_suite(spark: SparkSession, sf: str) -> DataFrame:
    frames = _frames(spark, sf)
    return suites.frame_suite(frames, _live(frames).select("source_id", "source_page").distinct(), _listed(spark, sf).distinct())


def _inventory(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    count = F.count("*")
    sources = frames.groupBy("source_id").agg(
        F.when(count >= 20, "MAIN").otherwise("SI").alias("role"), F.max("source_page").alias("page_count"), F.min("source_font").alias("pdf_path"),
        F.when(F.max("source_font_size_pt") > 10, "SELECTABLE_PDF").otherwise(F.min("weight")).alias("language_authority"), F.when(count % 2 == 0, "VERSION_OF_RECORD_PDF").otherwise("PUBLISHER_SUPPLEMENT_PDF").alias("geometry_authority"),
    )
    inset = F.col("frame_kind").isin("caption", "table_cell")
    pages = _live(frames).groupBy("source_id", "source_page").agg(
        F.min("row_id").alias("output_page"), F.array_repeat(F.max_by("bbox_pt", "row_id"), 5).alias("boxes"), F.max("rotation").alias("rotation"), F.collect_set("frame_id").alias("frame_ids"), F.collect_set(F.when(inset, F.col("unit_id"))).alias("object_ids")
    )
    objects = frames.where(inset).select(
        F.col("unit_id").alias("object_id"), F.when(F.col("frame_kind") == "table_cell", "table").otherwise("figure").alias("kind"), "source_id", "source_page", "bbox_pt", F.array("frame_id").alias("label_frame_ids"), F.col("reading_order").alias("rows"), F.col("source_page").alias("columns")
    )
    cells = frames.where("frame_kind = 'table_cell' AND weight <> 'bold'").select(F.col("unit_id").alias("object_id"), F.col("reading_order").alias("row"), F.col("source_page").alias("column"), "bbox_pt", "frame_id")
    return sources, pages, objects, cells


def inventory_suite(spark: SparkSession, sf: str) -> DataFrame:
    return suites.inventory_suite(*_inventory(_frames(spark, sf)))


def link_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Units against the pages that list them: the listing is that of the rows loaded last."""
    frames = _frames(spark, sf)
    last = frames.groupBy("unit_id").agg(F.max_by(F.struct("source_id", "source_page", "removed_at"), "row_id").alias("l")).select("unit_id", "l.*").where("removed_at IS NULL")
    pages = last.groupBy("source_id", "source_page").agg(F.collect_list("unit_id").alias("unit_ids"))
    return suites.link_suite(frames.select("unit_id", "source_id", "source_page"), pages, unit="unit_id", listed="unit_ids")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "paper_terminology").where("trim(coalesce(frame_id, '')) <> ''")
    return uses.groupBy(F.upper(F.trim("frame_id")).alias("frame_id")).agg(F.min_by(F.struct("row_id", "english_term", "preferred_chinese", "n_uses", "term_id", "artifact"), "row_id").alias("u")).select(
        F.col("u.row_id").cast("string").alias("unit_id"), "frame_id", F.substring("frame_id", 4, 12).alias("source_id"), F.substring("frame_id", 18, 3).try_cast("int").alias("source_page"), F.col("u.english_term").alias("source_text"), F.col("u.preferred_chinese").alias("translated_text"),
        (0.9 + F.col("u.n_uses") * 0.05).alias("font_scale"), F.when(F.col("u.artifact") == "A", "FIT").otherwise(F.col("u.artifact")).alias("fit_status"), F.array(F.upper(F.trim("u.term_id"))).alias("issue_ids"),
    )


def ledger_suite(spark: SparkSession, sf: str) -> DataFrame:
    issues = table(spark, sf, "terminology_registry").select(F.upper(F.trim("term_id")).alias("issue_id"))
    return suites.ledger_suite(_ledger(spark, sf), _frames(spark, sf).where("removed_at IS NULL"), issues)


def plan_suite(spark: SparkSession, sf: str) -> DataFrame:
    """The plan is what was loaded first, the frames what is there now."""
    frames = _frames(spark, sf)
    first = frames.where("source_page IS NOT NULL").groupBy("source_id", "source_page").agg(F.min("row_id").alias("output_page"), F.max("rotation").alias("rotation"), F.bool_and("translatable").alias("render_checked"), F.min_by("frame_kind", "row_id").alias("k"))
    plan = first.select("output_page", "source_id", "source_page", F.when(F.col("k") == "paragraph", "exact-text-frame").otherwise(F.col("k")).alias("strategy"), (F.col("k") == "heading").alias("extension_page"), "rotation", "render_checked")
    regions = frames.where("translatable").join(plan.select("source_id", "source_page", "output_page"), ["source_id", "source_page"]).select("output_page", "frame_id", "bbox_pt")
    live = _live(frames)
    return suites.plan_suite(plan, regions, live, live.select("source_id", "source_page").distinct())


def style_suite(spark: SparkSession, sf: str) -> DataFrame:
    """The style map that the frames themselves give, and frames rendered in the size of the frame before them."""
    frames = _frames(spark, sf)
    sizes = frames.where("source_font_size_pt > 0 AND frame_role IS NOT NULL AND frame_role <> 'DOI_URL'")
    wide = sizes.groupBy("frame_role").agg(F.min("source_font_size_pt").alias("lo"), F.max("source_font_size_pt").alias("hi"))
    med = ordered.upper_median_per_group(sizes, ["frame_role"], "source_font_size_pt").join(wide, "frame_role")
    style_map = med.select(F.col("frame_role").alias("role"), F.col("upper_median").alias("median_size"), F.lit(0.95).alias("size_low"), F.lit(1.1).alias("size_high"), (F.col("lo") / 6.5).alias("leading_low"), F.lit(1.45).alias("leading_high"))
    rendered = frames.where("rotation = 0 AND reading_order > 1").select("frame_id", "source_font_size_pt", "weight", "reading_order").dropDuplicates(["frame_id"]).select(
        "frame_id", (F.col("source_font_size_pt") * (0.92 + F.pmod("reading_order", F.lit(9)) * 0.025)).alias("font_size_pt"), (F.col("source_font_size_pt") * 1.3).alias("leading_pt"), F.when(F.col("reading_order") == 3, "bold").otherwise(F.col("weight")).alias("weight")
    )
    one = frames.dropDuplicates(["frame_id"])
    return checks.united(suites.style_map_suite(style_map, frames), suites.rendered_style_suite(one, rendered, style_map))


def _numeric(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each frame's text against the text of the frame after it on the page; the numbers of captions need not be kept."""
    frames = _frames(spark, sf).where("source_id IS NOT NULL AND source_page IS NOT NULL AND source_text IS NOT NULL")
    w = ordered.Window.partitionBy("source_id", "source_page").orderBy("row_id")
    ledger = frames.select(F.col("row_id").cast("string").alias("unit_id"), "row_id", "source_id", "source_page", "frame_role", "source_text", F.coalesce(F.lead("source_text").over(w), F.lit("")).alias("translated_text"))
    token = F.regexp_extract("source_text", "([0-9]+)$", 1)
    allowed = ledger.where("frame_role = 'CAPTION'").select("unit_id", F.lit("missing").alias("kind"), token.alias("source_token"), F.lit(None).cast("string").alias("translated_token"), F.lit("caption").alias("reason"), F.lit("reader").alias("reviewer"), F.lit("2024-02-29").alias("reviewed_date"))
    wrong = allowed.withColumn("reviewed_date", F.lit("2023-02-29"))
    return ledger, allowed.unionByName(wrong)


def numeric_suite(spark: SparkSession, sf: str) -> DataFrame:
    return suites.numeric_suite(*_numeric(spark, sf)).select("code", "passed", "n_failed")


def package_gate(spark: SparkSession, sf: str) -> DataFrame:
    """All suites of the exact package as one report."""
    return checks.report(checks.united(inventory_suite(spark, sf), frame_suite(spark, sf), ledger_suite(spark, sf), plan_suite(spark, sf)), validator="package").select("validator", "passed", "n_checks", "n_failed", "first_failure")


for _f in (frame_suite, inventory_suite, link_suite, ledger_suite, plan_suite, style_suite, numeric_suite, package_gate):
    QUERIES[_f.__name__] = _f


def _filled(c: str) -> str:
    return f"coalesce(trim({c}), '') <> ''"


_BOX = "coalesce(len({0}) = 4 AND {0}[3] > {0}[1] AND {0}[4] > {0}[2], false)"
_FRAMES = "f AS (SELECT * FROM text_frame_inventory), live AS (SELECT * FROM f WHERE removed_at IS NULL AND source_id IS NOT NULL AND source_page IS NOT NULL)"


def _suite(ctes: str, offenders: dict[str, str], *, final: bool = True) -> str:
    """SQL of a suite: for each code a query of its offenders (column e)."""
    union = " UNION ALL ".join(f"SELECT '{c}' AS code, CAST(e AS VARCHAR) AS e FROM ({q})" for c, q in offenders.items())
    codes = ", ".join(f"('{c}')" for c in offenders)
    rows = f"codes(code) AS (VALUES {codes}), o AS ({union}), rows AS (SELECT codes.code, count(o.code) = 0 AS passed, count(o.code) AS n_failed, CASE WHEN count(o.code) = 0 THEN '' ELSE min(coalesce(e, '')) END AS detail FROM codes LEFT JOIN o USING (code) GROUP BY codes.code)"
    return f"WITH {ctes}, {rows}" + (" SELECT * FROM rows" if final else "")


def _rows(relation: str, example: str, rules: dict[str, str]) -> dict[str, str]:
    return {c: f"SELECT {example} AS e FROM {relation} WHERE NOT coalesce({r}, false)" for c, r in rules.items()}


def _twice(relation: str, *keys: str) -> str:
    e = " || '/' || ".join(keys)
    return f"SELECT {e} AS e FROM {relation} WHERE {' AND '.join(k + ' IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


def _differ(a: str, b: str, *keys: str) -> str:
    on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys)
    e = lambda t: "concat_ws('/', " + ", ".join(f"coalesce(CAST({t}.{k} AS VARCHAR), '?')" for k in keys) + ")"
    return f"SELECT 'MISSING ' || {e('x')} AS e FROM (SELECT DISTINCT {', '.join(keys)} FROM {a}) x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE {on}) UNION ALL SELECT 'EXTRA ' || {e('y')} FROM (SELECT DISTINCT {', '.join(keys)} FROM {b}) y WHERE NOT EXISTS (SELECT 1 FROM {a} x WHERE {on})"


_KEPT, _MADE = str(suites.KEPT_ROLES), str(suites.TRANSLATED_ROLES)
_LISTED = "listed AS (SELECT DISTINCT upper(trim(frame_id)) AS frame_id FROM paper_terminology WHERE trim(frame_id) <> '')"
_FRAME = {
    **_rows("f", "frame_id", {
        "FRAME_ID": _filled("frame_id"), "FRAME_UNIT": _filled("unit_id"), "FRAME_KIND": f"frame_kind IN {suites.FRAME_KINDS}", "FRAME_ROLE": f"frame_role IN {_KEPT} OR frame_role IN {_MADE}", "ROLE_FLAG": f"frame_role NOT IN {_KEPT} OR NOT translatable",
        "FRAME_BOX": _BOX.format("bbox_pt"), "FRAME_ROTATION": "rotation IN (0, 90, 180, 270)", "READING_ORDER": "reading_order > 0", "FRAME_FONT": _filled("source_font"), "FRAME_SIZE": "source_font_size_pt > 0",
        "FRAME_ACTION": "translation_action IN ('TRANSLATE', 'RETAIN_SOURCE')", "ACTION_FLAG": "translatable = (translation_action = 'TRANSLATE')",
    }),
    "FRAME_REPEATED": _twice("f", "frame_id"), "FRAME_PAGE": "SELECT coalesce(frame_id, '?') AS e FROM f WHERE NOT EXISTS (SELECT 1 FROM live p WHERE p.source_id = f.source_id AND p.source_page = f.source_page)", "FRAME_COVERAGE": _differ("listed", "f", "frame_id"),
}
SQL["frame_suite"] = _suite(f"{_FRAMES}, {_LISTED}", _FRAME)

_INVENTORY_CTES = _FRAMES + """,
sources AS (SELECT source_id, CASE WHEN count(*) >= 20 THEN 'MAIN' ELSE 'SI' END AS role, max(source_page) AS page_count, min(source_font) AS pdf_path, CASE WHEN max(source_font_size_pt) > 10 THEN 'SELECTABLE_PDF' ELSE min(weight) END AS language_authority,
  CASE WHEN count(*) % 2 = 0 THEN 'VERSION_OF_RECORD_PDF' ELSE 'PUBLISHER_SUPPLEMENT_PDF' END AS geometry_authority FROM f GROUP BY source_id),
pages AS (SELECT source_id, source_page, min(row_id) AS output_page, arg_max(bbox_pt, row_id) AS box, max(rotation) AS rotation FROM live GROUP BY ALL),
wanted AS (SELECT source_id, unnest(range(1, page_count + 1)) AS source_page FROM sources),
inset AS (SELECT *, CASE frame_kind WHEN 'table_cell' THEN 'table' ELSE 'figure' END AS kind FROM f WHERE frame_kind IN ('caption', 'table_cell')), cells AS (SELECT * FROM f WHERE frame_kind = 'table_cell' AND weight <> 'bold')"""
_PAGE = "concat_ws('/', coalesce(source_id, '?'), coalesce(CAST(source_page AS VARCHAR), '?'))"
_CELL = "concat_ws('/', coalesce(unit_id, '?'), coalesce(CAST(reading_order AS VARCHAR), '?'), coalesce(CAST(source_page AS VARCHAR), '?'))"
_KNOWN_FRAME = "EXISTS (SELECT 1 FROM live l WHERE l.frame_id = {0}.frame_id)"
_INVENTORY = {
    **_rows("sources", "source_id", {
        "SOURCE_ID": _filled("source_id"), "SOURCE_ROLE": "role IN ('MAIN', 'SI')", "PAGE_COUNT": "page_count > 0", "PDF_PATH": _filled("pdf_path"), "LANGUAGE_AUTHORITY": f"language_authority IN {suites.LANGUAGE_AUTHORITIES}",
        "GEOMETRY_AUTHORITY": "geometry_authority = CASE role WHEN 'MAIN' THEN 'VERSION_OF_RECORD_PDF' ELSE 'PUBLISHER_SUPPLEMENT_PDF' END",
    }),
    **_rows("pages", _PAGE, {"PAGE_KEY": _filled("source_id") + " AND source_page > 0", "OUTPUT_PAGE": "output_page > 0", "PAGE_BOXES": _BOX.format("box"), "PAGE_ROTATION": "rotation IN (0, 90, 180, 270)"}),
    "PAGE_LISTS": f"SELECT DISTINCT {_PAGE} AS e FROM live WHERE trim(frame_id) = '' OR (trim(unit_id) = '' AND frame_kind IN ('caption', 'table_cell'))", "SOURCE_REPEATED": _twice("sources", "source_id"), "PAGE_REPEATED": _twice("pages", "source_id", "source_page"),
    "PAGE_COVERAGE": _differ("wanted", "pages", "source_id", "source_page"), "OUTPUT_REPEATED": _twice("pages", "output_page"), "OUTPUT_SEQUENCE": "SELECT count(DISTINCT output_page) || ' of ' || max(output_page) AS e FROM pages HAVING count(DISTINCT output_page) <> max(output_page)",
    **_rows("inset", "unit_id", {"OBJECT_ID": _filled("unit_id"), "OBJECT_KIND": "kind IN ('table', 'figure')", "OBJECT_BOX": _BOX.format("bbox_pt"), "TABLE_STRUCTURE": "kind <> 'table' OR (reading_order > 0 AND source_page > 0)"}),
    "OBJECT_REPEATED": _twice("inset", "unit_id"), "OBJECT_PAGE": "SELECT coalesce(unit_id, '?') AS e FROM inset i WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.source_id = i.source_id AND p.source_page = i.source_page)",
    "OBJECT_LABELS": "SELECT concat_ws('/', coalesce(unit_id, '?'), coalesce(frame_id, '?')) AS e FROM inset WHERE NOT " + _KNOWN_FRAME.format("inset"),
    "OBJECT_COVERAGE": _differ("(SELECT * FROM live WHERE frame_kind IN ('caption', 'table_cell') AND unit_id IS NOT NULL)", "inset", "unit_id"),
    "TABLE_CELLS": "SELECT coalesce(unit_id, '?') AS e FROM inset WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.unit_id = inset.unit_id)",
    **_rows("cells", _CELL, {"CELL_PLACE": "reading_order > 0 AND source_page > 0", "CELL_BOX": _BOX.format("bbox_pt")}),
    "CELL_FRAME": "SELECT concat_ws('/', coalesce(unit_id, '?'), coalesce(frame_id, '?')) AS e FROM cells WHERE NOT " + _KNOWN_FRAME.format("cells"),
}
SQL["inventory_suite"] = _suite(_INVENTORY_CTES, _INVENTORY)

SQL["link_suite"] = _suite(
    """last AS (SELECT * FROM (SELECT unit_id, arg_max({'s': source_id, 'p': source_page, 'r': removed_at}, row_id) AS l FROM text_frame_inventory GROUP BY unit_id) WHERE l.r IS NULL),
    said AS (SELECT unit_id, l.s AS source_id, l.p AS source_page FROM last WHERE unit_id IS NOT NULL), units AS (SELECT unit_id, any_value(source_id) AS source_id, any_value(source_page) AS source_page FROM text_frame_inventory GROUP BY unit_id)""",
    {
        "LISTED_ELSEWHERE": "SELECT unit_id AS e FROM said JOIN units u USING (unit_id) WHERE u.source_id IS NOT NULL AND NOT (u.source_id = said.source_id AND u.source_page = said.source_page)",
        "NOT_LISTED": "SELECT coalesce(unit_id, '?') AS e FROM text_frame_inventory t WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.unit_id = t.unit_id)", "LISTED_UNKNOWN": "SELECT unit_id AS e FROM said WHERE unit_id NOT IN (SELECT unit_id FROM units WHERE unit_id IS NOT NULL)", "LISTED_TWICE": _twice("said", "unit_id"),
    },
)

_LEDGER_CTES = """
uses AS (SELECT upper(trim(frame_id)) AS frame_id, arg_min({'i': row_id, 'e': english_term, 'c': preferred_chinese, 'n': n_uses, 't': term_id, 'a': artifact}, row_id) AS u FROM paper_terminology WHERE trim(frame_id) <> '' GROUP BY 1),
ledger AS (SELECT CAST(u.i AS VARCHAR) AS unit_id, frame_id, substr(frame_id, 4, 12) AS source_id, try_cast(substr(frame_id, 18, 3) AS INTEGER) AS source_page, u.e AS source_text, u.c AS translated_text, 0.9 + u.n * 0.05 AS font_scale, CASE u.a WHEN 'A' THEN 'FIT' ELSE u.a END AS fit_status, upper(trim(u.t)) AS issue FROM uses),
here AS (SELECT frame_id, any_value(source_id) AS s, any_value(source_page) AS p, any_value(frame_kind) AS k, any_value(translation_action) AS a FROM text_frame_inventory WHERE removed_at IS NULL GROUP BY frame_id),
met AS (SELECT ledger.*, s, p, k, a FROM ledger LEFT JOIN here USING (frame_id)), terms AS (SELECT DISTINCT upper(trim(term_id)) AS t FROM terminology_registry)"""
_LEDGER = {
    **_rows("met", "unit_id", {
        "UNIT_ID": _filled("unit_id"), "UNIT_FRAME": "a = 'TRANSLATE'", "UNIT_PLACE": "a IS NULL OR (source_id = s AND source_page = p)", "UNIT_TEXTS": _filled("source_text") + " AND " + _filled("translated_text"),
        "UNIT_SCALE": f"CAST(font_scale AS DOUBLE) BETWEEN 0.95 AND CASE WHEN k IN {suites.EXPANDABLE_KINDS} THEN 1.1 ELSE 1.0 END", "UNIT_FIT": f"fit_status IN {suites.FIT_STATUSES}",
    }),
    "UNIT_REPEATED": _twice("ledger", "unit_id"), "FRAME_IN_TWO_UNITS": _twice("ledger", "frame_id"), "UNIT_ISSUE": "SELECT concat_ws('/', unit_id, coalesce(issue, '?')) AS e FROM ledger WHERE NOT EXISTS (SELECT 1 FROM terms WHERE t = issue)",
    "UNIT_COVERAGE": "SELECT frame_id AS e FROM here WHERE a = 'TRANSLATE' AND frame_id NOT IN (SELECT frame_id FROM ledger)",
}
SQL["ledger_suite"] = _suite(_LEDGER_CTES, _LEDGER)

_PLAN_CTES = _FRAMES + """,
plan AS (SELECT source_id, source_page, min(row_id) AS output_page, max(rotation) AS rotation, bool_and(translatable) AS checked, arg_min(frame_kind, row_id) AS k FROM f WHERE source_page IS NOT NULL GROUP BY ALL),
regions AS (SELECT output_page, frame_id, bbox_pt FROM f JOIN plan USING (source_id, source_page) WHERE translatable), wanted AS (SELECT frame_id, any_value(bbox_pt) AS b FROM live WHERE translation_action = 'TRANSLATE' GROUP BY frame_id), placed AS (SELECT frame_id, any_value(bbox_pt) AS r FROM regions GROUP BY frame_id)"""
_NEAR = " AND ".join(f"abs(b[{i}] - r[{i}]) <= 0.25" for i in range(1, 5))
_PLAN = {
    **_rows("plan", "output_page", {"PLAN_PAGE": "output_page > 0", "PLAN_STRATEGY": "k = 'paragraph'", "PLAN_EXTENSION": "k <> 'heading'", "PLAN_ROTATION": "rotation IN (0, 90, 180, 270)", "PLAN_CHECKED": "checked"}),
    "PLAN_REPEATED": _twice("plan", "output_page"), "PLAN_SEQUENCE": "SELECT count(DISTINCT output_page) || ' of ' || max(output_page) AS e FROM plan HAVING count(DISTINCT output_page) <> max(output_page)", "PLAN_ONE_TO_ONE": _twice("plan", "source_id", "source_page"),
    "PLAN_COVERAGE": _differ("live", "plan", "source_id", "source_page"), "REGION_PAGE": "SELECT frame_id AS e FROM regions WHERE output_page NOT IN (SELECT output_page FROM plan)", "REGION_REPEATED": _twice("regions", "frame_id"), **_rows("regions", "frame_id", {"REGION_BOX": _BOX.format("bbox_pt")}),
    "REGION_MATCH": f"SELECT coalesce(wanted.frame_id, placed.frame_id) AS e FROM wanted FULL JOIN placed USING (frame_id) WHERE NOT coalesce({_NEAR}, false)",
}
SQL["plan_suite"] = _suite(_PLAN_CTES, _PLAN)

SQL["package_gate"] = (
    "WITH " + ", ".join(f"r{i} AS ({SQL[n]})" for i, n in enumerate(("inventory_suite", "frame_suite", "ledger_suite", "plan_suite"))) + ", rows AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(4))
    + ") SELECT 'package' AS validator, bool_and(passed) AS passed, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed, coalesce(min(CASE WHEN NOT passed THEN code END), '') AS first_failure FROM rows"
)

SQL["style_suite"] = _suite(
    """f AS (SELECT * FROM text_frame_inventory), sized AS (SELECT * FROM f WHERE source_font_size_pt > 0 AND frame_role IS NOT NULL AND frame_role <> 'DOI_URL'),
    map AS (SELECT frame_role AS role, list_sort(list(source_font_size_pt))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_size, min(source_font_size_pt) / 6.5 AS leading_low FROM sized GROUP BY 1), used AS (SELECT DISTINCT frame_role FROM f),
    one AS (SELECT frame_id, any_value(frame_role) AS frame_role, any_value(source_font_size_pt) AS s, any_value(weight) AS w, any_value(translation_action) AS a FROM f GROUP BY frame_id),
    rendered AS (SELECT frame_id, any_value(source_font_size_pt) * (0.92 + (any_value(reading_order) % 9) * 0.025) AS size, any_value(source_font_size_pt) * 1.3 AS ld, CASE WHEN any_value(reading_order) = 3 THEN 'bold' ELSE any_value(weight) END AS rw FROM f WHERE rotation = 0 AND reading_order > 1 GROUP BY frame_id),
    d AS (SELECT one.*, r.frame_id AS there, size, ld, rw, leading_low FROM one LEFT JOIN rendered r USING (frame_id) LEFT JOIN map ON map.role = one.frame_role WHERE a = 'TRANSLATE')""",
    {
        "ROLE_UNMAPPED": "SELECT coalesce(frame_role, '?') AS e FROM used WHERE NOT EXISTS (SELECT 1 FROM map WHERE role = frame_role)", **_rows("map", "role", {"SIZE_RANGE": "true", "LEADING_RANGE": "leading_low >= 1.15 AND leading_low <= 1.45"}),
        "HEADING_SIZE": "SELECT max(median_size) FILTER (WHERE role IN ('TITLE', 'H1', 'H2', 'H3', 'HEADING')) AS e FROM map HAVING e <= max(median_size) FILTER (WHERE role = 'BODY')",
        **_rows("d", "frame_id", {"STYLE_RENDERED": "there IS NOT NULL", "STYLE_SIZE": "there IS NULL OR size / s BETWEEN 0.949 AND 1.101", "STYLE_LEADING": "there IS NULL OR ld / size BETWEEN leading_low - 0.001 AND 1.451", "STYLE_KEPT": "there IS NULL OR w IS NOT DISTINCT FROM rw"}),
    },
)

# numbers stand at the end of the texts only
SQL["numeric_suite"] = r"""
WITH u AS (SELECT row_id, source_id, source_page, frame_role, regexp_extract_all(source_text, '[0-9]+') AS s, coalesce(lead(regexp_extract_all(source_text, '[0-9]+')) OVER (PARTITION BY source_id, source_page ORDER BY row_id), []) AS t
  FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_page IS NOT NULL AND source_text IS NOT NULL),
b AS (SELECT source_id, source_page, row_id, frame_role, unnest(s) AS token, 1 AS d FROM u UNION ALL SELECT source_id, source_page, row_id, frame_role, unnest(t), -1 FROM u),
n AS (SELECT source_id, source_page, row_id, frame_role, token, sum(d) AS d FROM b GROUP BY ALL HAVING sum(d) <> 0),
w AS (SELECT * FROM n WHERE NOT (d > 0 AND frame_role = 'CAPTION')),
m AS (SELECT source_id, source_page, row_id, token, unnest(range(CAST(greatest(d, 0) AS BIGINT))) AS i FROM w), a AS (SELECT source_id, source_page, row_id, token, unnest(range(CAST(greatest(-d, 0) AS BIGINT))) AS i FROM w),
mr AS (SELECT *, row_number() OVER (PARTITION BY source_id, source_page, token ORDER BY row_id, i) AS rn FROM m), ar AS (SELECT *, row_number() OVER (PARTITION BY source_id, source_page, token ORDER BY row_id, i) AS rn FROM a),
mc AS (SELECT count(DISTINCT (row_id, token)) AS n FROM mr LEFT JOIN (SELECT source_id, source_page, token, count(*) AS k FROM a GROUP BY ALL) USING (source_id, source_page, token) WHERE rn > coalesce(k, 0)),
ac AS (SELECT count(DISTINCT (row_id, token)) AS n FROM ar LEFT JOIN (SELECT source_id, source_page, token, count(*) AS k FROM m GROUP BY ALL) USING (source_id, source_page, token) WHERE rn > coalesce(k, 0)),
x AS (SELECT count(*) AS n FROM u WHERE frame_role = 'CAPTION'), y AS (SELECT count(*) AS n FROM u WHERE frame_role = 'CAPTION' AND len(s) = 0)
SELECT 'NUMBER_MISSING' AS code, n = 0 AS passed, n AS n_failed FROM mc UNION ALL SELECT 'NUMBER_ADDED', n = 0, n FROM ac UNION ALL SELECT 'WHITELIST', x.n + y.n = 0, x.n + y.n FROM x, y"""
