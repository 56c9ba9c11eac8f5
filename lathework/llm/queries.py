"""The pN_ queries of the problems on text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import lookalike, mixing, multiset_dedup, spans, sql, tiling

PLAIN_FIELDS = ("english_term", "preferred_chinese")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in PLAIN_FIELDS])
    return lookalike.plain_forms(table(spark, sf, "terminology_registry").select("row_id", F.explode(cells).alias("e")).select("row_id", "e.*"))


def p6_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Plain English terms and a disguised copy of each: letters of two other scripts, an invisible character, another blank. Out come the plain ones again."""
    terms = table(spark, sf, "terminology_registry").where(F.col("english_term").rlike("^[A-Za-z0-9-]+( [A-Za-z0-9-]+)*$")).select("row_id", F.col("english_term").alias("cell"))
    disguised = F.concat(F.substring("cell", 1, 1), F.lit("\u200b"), F.translate(F.expr("substring(cell, 2)"), "eo ", "\u0435\u03bf\u00a0"))
    cells = terms.select("row_id", F.lit("plain").alias("field_name"), "cell").unionByName(terms.select("row_id", F.lit("disguised").alias("field_name"), disguised.alias("cell")))
    return lookalike.plain_forms(cells)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return multiset_dedup.copies(table(spark, sf, "term_submissions"), row_id="submission_id", record="record")


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record, with the number of its copies."""
    more = p7_found(spark, sf)
    counts = more.groupBy("keep_id").agg(F.count("*").alias("n"))
    kept = table(spark, sf, "term_submissions").select(F.col("submission_id").alias("keep_id"), "record").join(more.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    return kept.join(counts, "keep_id", "left").select("keep_id", "record", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))


def _leaks(spark: SparkSession, sf: str, **how: float) -> DataFrame:
    return tiling.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), **how)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose tiles cover half of the item or more."""
    return _leaks(spark, sf, min_coverage=0.5).select("doc_id", "item_id", "covered", "item_words").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("covered").alias("most_covered"), F.max("item_words").alias("item_words"))


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[1]


def p9_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source: are the share and the repeats kept, and is every selected record once in the selection and of its source?"""
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "source_targets")
    chosen, report = mixing.mix(docs, targets)
    of = docs.select("doc_id", mixing.source_key(F.col("source")).alias("own"))
    used = chosen.join(of, "doc_id", "left").groupBy("source").agg(F.max("times_used").alias("most"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("own") != F.col("source")).alias("foreign"))
    named = targets.select(mixing.source_key(F.col("source")).alias("source"), "max_repeats").distinct()
    able, size = report.agg(F.sum(F.when(F.col("n_docs") > 0, F.col("target_share"))), F.sum("n_tokens")).first()
    largest = chosen.agg(F.max("n_tokens")).first()[0] or 0
    within = max(0.02, largest / max(1, size or 0))  # records are whole
    r = report.join(used, "source", "left").join(named, "source").withColumn("able", F.lit(able))
    wanted = F.when(F.col("n_docs") > 0, F.col("target_share") / F.col("able")).otherwise(0.0)
    return r.select(
        "source", (F.col("n_docs") > 0).alias("selected"), (F.abs(F.col("actual_share") - wanted) <= within).alias("share_kept"),
        F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("n") == F.col("ids")) & (F.col("foreign") == 0), F.lit(True)).alias("records_kept"),
    )


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents"))


def p10_share(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


QUERIES = {
    "p6_found": p6_found, "p6_planted": p6_planted, "p7_found": p7_found, "p7_kept": p7_kept, "p8_found": p8_found, "p8_coverage": p8_coverage, "p8_items": p8_items,
    "p9_selection": p9_selection, "p9_shares": p9_shares, "p9_bounds": p9_bounds,
    "p10_found": p10_found, "p10_share": p10_share,
}
SQL: dict[str, str] = dict(sql.SQL)
