"""Observations of many places reduced to statuses: latest known values, precedence, pending lists, plans against what exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import markdown_cell

# fixed values: statuses from the one that wins to the one that yields
PRECEDENCE = ("CONFLICT", "MISSING", "PRESENT_UNVERIFIED", "VERIFIED", "UNKNOWN")


def rank_of(status: Column, precedence: Sequence[str] = PRECEDENCE) -> Column:
    out = F.lit(len(precedence))
    for i, s in reversed(list(enumerate(precedence))):
        out = F.when(status == s, i).otherwise(out)
    return out


def reduced(df: DataFrame, group: Sequence[str], status: str, precedence: Sequence[str] = PRECEDENCE) -> DataFrame:
    """(group, status): the status of a group is its member of highest precedence; VERIFIED only if all are."""
    per = df.groupBy(*group).agg(F.min_by(status, rank_of(F.col(status), precedence)).alias("status"), F.bool_and(F.col(status) == "VERIFIED").alias("_all"))
    return per.withColumn("status", F.when((F.col("status") == "VERIFIED") & ~F.col("_all"), "UNKNOWN").otherwise(F.col("status"))).drop("_all")


def latest_known(observations: DataFrame, *, key: Sequence[str], order: str, status: str, unknown: str = "UNKNOWN") -> DataFrame:
    """One row per key: the latest observation, with ``last_known``: the latest one that was not unknown (never the unknown itself)."""
    per = observations.groupBy(*key).agg(
        F.max_by(F.struct(*[c for c in observations.columns if c not in key]), order).alias("_last"), F.max_by(status, F.when(F.col(status) != unknown, F.col(order))).alias("last_known")
    )
    return per.select(*key, "_last.*", "last_known")


def overview(latest: DataFrame, *, row: str, column: str, value: str, columns: Sequence[str], done: Sequence[str] = ("VERIFIED", "NOT_APPLICABLE"), default: str = "UNKNOWN") -> DataFrame:
    """One line per row with a status per column and ``pending``: how many columns are not done. Sorted by nothing: order at the sink."""
    wide = latest.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    wide = wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(default)).alias(c) for c in columns])
    pending = sum((F.when(F.col(f"`{c}`").isin(*done), 0).otherwise(1) for c in columns), F.lit(0))
    return wide.withColumn("pending", pending.cast("bigint"))


def pending_list(wide: DataFrame, *, row: str, columns: Sequence[str], done: Sequence[str] = ("VERIFIED", "NOT_APPLICABLE")) -> DataFrame:
    """(row, place, status) of everything not done: the overview unpivoted."""
    return wide.unpivot([row], list(columns), "place", "status").where(~F.col("status").isin(*done))


def markdown_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): the rows as a pipe table's body lines."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |")).alias("line"))


def classify_presence(candidates: DataFrame, *, key: str, right_place: Column, complete: Column) -> DataFrame:
    """(key, n, status): none MISSING, several CONFLICT, in the wrong place CONFLICT, incomplete MISSING, else PRESENT_UNVERIFIED.

    ``candidates`` has one row per candidate and one with a null ``candidate`` for keys without any.
    """
    per = candidates.groupBy(key).agg(F.count("candidate").alias("n"), F.bool_and(right_place).alias("_place"), F.bool_and(complete).alias("_whole"))
    status = F.when(F.col("n") == 0, "MISSING").when(F.col("n") > 1, "CONFLICT").when(~F.col("_place"), "CONFLICT").when(~F.col("_whole"), "MISSING").otherwise("PRESENT_UNVERIFIED")
    return per.select(key, "n", status.alias("status"))


def same_bytes(left: Column, right: Column) -> Column:
    """Equal text whatever the line ends; null where either is."""
    return F.replace(left, F.lit("\r\n"), F.lit("\n")) == F.replace(right, F.lit("\r\n"), F.lit("\n"))


def plan_files(wanted: DataFrame, existing: DataFrame, *, path: str, digest: str, force: Column | None = None) -> DataFrame:
    """``wanted`` with ``action``: NEW, IDENTICAL, or where contents differ CONFLICT (PRESERVED where ``force`` is false)."""
    e = existing.select(path, F.col(digest).alias("_have"), F.lit(True).alias("_there")).dropDuplicates([path])
    j = wanted.join(e, path, "left")
    differs = F.lit("CONFLICT") if force is None else F.when(force, "CONFLICT").otherwise("PRESERVED")
    return j.withColumn("action", F.when(F.col("_there").isNull(), "NEW").when(F.col("_have").eqNullSafe(F.col(digest)), "IDENTICAL").otherwise(differs)).drop("_have", "_there")


def plan_attachments(wanted: DataFrame, children: DataFrame, *, title: str, digest: str) -> DataFrame:
    """``wanted`` with ``action`` against same-titled children: NEW, ALREADY_VERIFIED (one, same digest), REUSE_PARTIAL (one, without digest), else CONFLICT."""
    c = children.groupBy(title).agg(F.count("*").alias("_n"), F.min(digest).alias("_d"))
    j = wanted.join(c, title, "left")
    action = F.when(F.col("_n").isNull(), "NEW").when(F.col("_n") > 1, "CONFLICT").when(F.col("_d").isNull(), "REUSE_PARTIAL").when(F.col("_d") == F.col(digest), "ALREADY_VERIFIED").otherwise("CONFLICT")
    return j.withColumn("action", action).drop("_n", "_d")


def three_valued(checks: Sequence[Column]) -> Column:
    """VERIFIED if all hold, CONFLICT if one fails, UNKNOWN if one is not known and none fails."""
    fails = F.lit(False)
    unknown = F.lit(False)
    for c in checks:
        fails = fails | F.coalesce(~c, F.lit(False))
        unknown = unknown | c.isNull()
    return F.when(fails, "CONFLICT").when(unknown, "UNKNOWN").otherwise("VERIFIED")
