"""The pN_ queries of the general problems on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, nested_records, orphans, packed_cells, schema_drift
from ..session import table

SNAPSHOT_ATTRIBUTES = ("status", "first_verified", "last_verified", "preferred_chinese")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    steps = schema_drift.migration_steps(table(spark, sf, "registry_files"))
    return steps.select("file_id", "change", "old_field", "new_field").distinct()


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "registry_files")
    return schema_drift.unified_records(files, schema_drift.drift(files))


def p1_versions(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.fingerprints(schema_drift.file_schemas(table(spark, sf, "registry_files")))


def p1_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = schema_drift.drift(table(spark, sf, "registry_files"))
    return schema_drift.migration_rules(d, schema_drift.lineages(d))


PACKED_FIELDS = {"evidence_ids": "ids", "alternative_chinese": "text"}


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packed_cells.packed_cells(table(spark, sf, "terminology_registry"), row_id="row_id", fields=PACKED_FIELDS)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_cells.split_values(_packed(spark, sf))


def p2_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return packed_cells.learn_dictionary(_packed(spark, sf).where("cell IS NOT NULL"))


def p2_decided(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells the dictionary decides: they would be split otherwise without it."""
    return packed_cells.decided_cells(_packed(spark, sf)).groupBy("field_name").agg(F.count("*").alias("n_cells"), F.count_if("decided").alias("n_decided"))


CHAIN = ["paragraph", "claim", "anchor"]


def _source_map_nodes(spark: SparkSession, sf: str, upto: int = 3, fields: tuple[str, ...] | None = None) -> DataFrame:
    return nested_records.linked_nodes(table(spark, sf, "c_source_map"), key="map_id", body="body", types=nested_records.SOURCE_MAP, chain=CHAIN[:upto], fields=fields)


def _field(node: Column, name: str) -> Column:
    return F.coalesce(F.element_at(node, name), F.lit(""))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _source_map_nodes(spark, sf, fields=("paragraph_index", "source_class", "section")).where("is_leaf")
    at = lambda t, c: F.when(F.col("node_type") == t, F.col(c)).otherwise(F.col(f"{t}.{c}"))
    is_anchor, is_claim = F.col("node_type") == "anchor", F.col("node_type") != "paragraph"
    no = lambda when, c: F.when(when, c).otherwise(0).cast("bigint")
    return rows.select(
        F.col("key_id").alias("map_id"), at("paragraph", "no").cast("bigint").alias("paragraph_no"), _field(at("paragraph", "fields"), "paragraph_index").alias("paragraph_index"),
        no(is_claim, at("claim", "ordinal")).alias("claim_no"), F.when(is_claim, _field(at("claim", "fields"), "source_class")).otherwise("").alias("source_class"),
        no(is_anchor, F.col("ordinal")).alias("anchor_no"), F.when(is_anchor, F.coalesce("value", _field(F.col("fields"), "section"))).otherwise("").alias("anchor"),
    ).distinct()


def _p3_table(node_type: str, upto: int):  # noqa: ANN202
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = nested_records.distinct_nodes(_source_map_nodes(spark, sf, upto).where(F.col("node_type") == node_type))
        outer = [F.col(f"{t}.no").cast("bigint").alias(f"{t}_no") for t in CHAIN[: upto - 1]]
        outer += [((F.col(f"{t}.pre") < F.col("pre")) & (F.col(f"{t}.post") > F.col("post"))).alias(f"in_{t}") for t in CHAIN[: upto - 1]]
        text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
        return rows.select(F.col("key_id").alias("map_id"), *outer, F.col("no").cast("bigint").alias("no"), text.alias("fields"), "value").distinct()

    return query


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    log = history.attribute_log(
        table(spark, sf, "registry_snapshots"), scope="workspace_id", date="snapshot_date", entity="term_id",
        attributes=SNAPSHOT_ATTRIBUTES, loaded_at="loaded_at", row_id="row_id",
    )
    return log


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn("valid_to", F.coalesce(F.col("valid_to").cast("string"), F.lit("")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    v = history.combine_intervals(_snapshots(spark, sf), SNAPSHOT_ATTRIBUTES)
    return _dates(v.select(F.col("entity").alias("term_id"), "valid_from", "valid_to")).distinct()


def p4_attribute_log(spark: SparkSession, sf: str) -> DataFrame:
    return _dates(_snapshots(spark, sf).withColumnsRenamed({"scope": "workspace_id", "entity": "term_id"}))


def p4_versions(spark: SparkSession, sf: str) -> DataFrame:
    return _dates(history.combine_intervals(_snapshots(spark, sf), SNAPSHOT_ATTRIBUTES).withColumnsRenamed({"scope": "workspace_id", "entity": "term_id"}))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    registry, papers = table(spark, sf, "terminology_registry"), table(spark, sf, "paper_terminology")
    refs = orphans.references(registry, table="terminology_registry", field="evidence_id", row_id="row_id", at="loaded_at")
    for field in ("term_id", "frame_id"):
        refs = refs.unionByName(orphans.references(papers, table="paper_terminology", field=field, row_id="row_id", at="used_at"))
    kind = F.coalesce("event_type", F.lit("ADD"))
    log = table(spark, sf, "terminology_evidence").where(kind.isin("ADD", "DEPRECATE")).select(
        "seq", "recorded_at", (kind == "ADD").alias("adds"), F.when(kind == "ADD", F.col("evidence_id")).otherwise(F.coalesce("target_evidence_id", "evidence_id")).alias("evidence_id")
    )
    periods = (
        orphans.periods_from_events(log, field="evidence_id", key="evidence_id", adds="adds", at="recorded_at", order="seq")
        .unionByName(orphans.periods_from_rows(registry, field="term_id", key="term_id", start="loaded_at", stop="removed_at"))
        .unionByName(orphans.periods_from_rows(table(spark, sf, "text_frame_inventory"), field="frame_id", key="frame_id", start="loaded_at", stop="removed_at"))
    )
    return refs, periods, registry.count() + 2 * papers.count()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans(*_references(spark, sf))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, sf))


QUERIES = {
    "p1_found": p1_found, "p1_records": p1_records, "p1_versions": p1_versions, "p1_rules": p1_rules,
    "p2_found": p2_found, "p2_dictionary": p2_dictionary, "p2_decided": p2_decided,
    "p3_found": p3_found, "p3_paragraphs": _p3_table("paragraph", 1), "p3_claims": _p3_table("claim", 2), "p3_anchors": _p3_table("anchor", 3),
    "p4_found": p4_found, "p4_attribute_log": p4_attribute_log, "p4_versions": p4_versions,
    "p5_found": p5_found, "p5_report": p5_report,
}
