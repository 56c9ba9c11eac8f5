"""Records that are the same but for white space, letter case, punctuation or field order.

Each normalized (field name, value) pair is hashed and the hashes are added up, so that the order
of fields is nothing; records with equal sums are compared field by field with the record that
their group keeps. No record is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SALT = 64
HEAVY_SHARE = 1000  # a group is heavy with more than 1/HEAVY_SHARE of all records: there are fewer of them than that


def squeezed(c: Column) -> Column:
    """Letters and digits only, case ignored."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def normalized_pairs(record: Column) -> Column:
    """The set of a JSON record's non-empty fields as an array of (name, value), both squeezed; null if unreadable."""
    pairs = F.transform(F.map_entries(F.from_json(record, "map<string,string>")), lambda e: F.struct(squeezed(e["key"]).alias("name"), F.coalesce(squeezed(e["value"]), F.lit("")).alias("value")))
    return F.array_distinct(F.filter(pairs, lambda p: p["value"] != ""))


def multiset_hash(pairs: Column) -> list[Column]:
    """128 bits that do not depend on the order of the pairs, and the number of pairs, as columns.

    Two independent 64-bit hashes per pair, added up by 32-bit halves so that no sum overflows.
    """

    def total(seed: int, half: str) -> Column:
        h = lambda p: F.xxhash64(F.lit(seed), p["name"], p["value"])
        part = (lambda p: F.shiftrightunsigned(h(p), 32)) if half == "hi" else (lambda p: h(p).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, p: a + part(p))

    # never null: else every join on them would filter by them first, and compute all of it once more
    sums = [F.coalesce(total(seed, half), F.lit(0).cast("bigint")).alias(f"h{seed}{half}") for seed in (17, 71) for half in ("hi", "lo")]
    return [*sums, F.coalesce(F.size(pairs), F.lit(0)).alias("n")]


FINGERPRINT = ["h17hi", "h17lo", "h71hi", "h71lo", "n"]


def same_pairs(a: Column, b: Column) -> Column:
    """Equality of two sets of pairs, field by field."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda p: F.array_contains(b, p))


MAX_BROADCAST_BYTES = 32 << 20  # of kept records of heavy groups


def fingerprinted(df: DataFrame, *, row_id: str, record: str) -> DataFrame:
    """(id, pairs, FINGERPRINT) of the readable records, each parsed once."""
    # null pairs are dropped by a generator: a filter on them would parse every record twice
    readable = F.explode(F.filter(F.array(normalized_pairs(F.col(record))), lambda p: p.isNotNull()))
    pairs = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), readable.alias("pairs"))
    return pairs.select("id", "pairs", *multiset_hash(F.col("pairs")))


def copies(df: DataFrame, *, row_id: str, record: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(keep_id, copy_id): each record that repeats another one, with the least id of its equals.

    Null and unreadable records equal nothing; records without any non-empty field equal each
    other. A repeated row id is one record. Records are parsed once and written as pairs. Heavy groups
    (a bounded number) meet their kept record by a broadcast if these records together are within
    ``max_broadcast_bytes``, all others by a shuffle. Records that share a fingerprint without being
    equal are grouped again among themselves by their full content.
    """
    rows = materialize(fingerprinted(df, row_id=row_id, record=record), "records")
    groups = materialize(rows.groupBy(*FINGERPRINT).agg(F.min("id").alias("keep_id"), F.count("*").alias("size")).where("size > 1"), "groups")
    is_heavy = F.col("size") > max(1, rows.count() // HEAVY_SHARE)
    heavy, light = groups.where(is_heavy).select(*FINGERPRINT, "keep_id"), groups.where(~is_heavy).select(*FINGERPRINT, "keep_id")
    kept = rows.join(F.broadcast(heavy.select("keep_id")), F.col("id") == F.col("keep_id")).groupBy("keep_id").agg(F.any_value("pairs").alias("kept"))
    kept = materialize(kept, "kept-records")
    size = kept.agg(F.coalesce(F.sum(F.octet_length(F.to_json("kept"))), F.lit(0))).first()[0]
    in_heavy = rows.join(F.broadcast(heavy), FINGERPRINT).where("id <> keep_id")
    if size <= max_broadcast_bytes:
        in_heavy = in_heavy.join(F.broadcast(kept), "keep_id")
    else:  # a heavy group is spread over as many keys as its rows need
        salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
        in_heavy = in_heavy.withColumn("salt", salt).join(kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["keep_id", "salt"])
    members = rows.join(F.broadcast(heavy.select(*FINGERPRINT)), FINGERPRINT, "left_anti").join(light, FINGERPRINT)
    first = F.min_by("pairs", F.when(F.col("id") == F.col("keep_id"), F.lit(0)).otherwise(1)).over(Window.partitionBy("keep_id"))
    in_light = members.withColumn("kept", first).where("id <> keep_id")
    met = in_heavy.select("keep_id", "id", "pairs", "kept").unionByName(in_light.select("keep_id", "id", "pairs", "kept"))
    met = met.withColumn("equal", same_pairs(F.col("pairs"), F.col("kept")))
    equal = met.where("equal").select("keep_id", F.col("id").alias("copy_id"))
    others = met.where("NOT equal").withColumn("content", F.concat_ws("\x1f", F.array_sort(F.transform("pairs", lambda p: F.concat_ws("\x1e", p["name"], p["value"])))))
    keepers = others.groupBy("content").agg(F.min("id").alias("keep"))
    rest = others.select("content", "id").join(keepers, "content").where("id <> keep").select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id"))
    return equal.unionByName(rest).distinct()
