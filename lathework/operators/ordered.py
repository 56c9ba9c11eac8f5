"""Operators whose result depends on order: chains of states, running ranges, stable numbers, runs and gaps, ordered containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_breaks(df: DataFrame, *, key: str, order: str, old: str, new: str) -> DataFrame:
    """Rows whose old state is not the state the key had last, or that change nothing. A key's first row may start from anything."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("last_state", F.lag(new).over(w))
    return d.where((F.col("last_state").isNotNull() & ~F.col("last_state").eqNullSafe(F.col(old))) | F.col(old).eqNullSafe(F.col(new)))


def carry_forward(df: DataFrame, *, key: Sequence[str], order: str, value: str, known: Column, name: str = "last_known") -> DataFrame:
    """``df`` with the value of the latest row, up to and including this one, for which ``known`` holds."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(F.when(known, F.col(value)), ignorenulls=True).over(w))


def running_ranges(df: DataFrame, *, group: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """``df`` with first_no and last_no: contiguous ranges of ``length`` from 1, in order. Lengths of zero get an empty range (last_no < first_no)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("last_no", F.sum(F.coalesce(length, F.lit(0))).over(w).cast("bigint"))
    return d.withColumn("first_no", F.col("last_no") - F.coalesce(length, F.lit(0)) + 1)


def ranges_contiguous(df: DataFrame, *, group: Sequence[str], order: Sequence[str], first: str, last: str) -> DataFrame:
    """(group, total, passed): do the ranges start at 1 and follow each other without gap or overlap?"""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.withColumn("_ok", F.col(first) == F.coalesce(F.lag(last).over(w) + 1, F.lit(1)))
    return d.groupBy(*group).agg(F.max(last).alias("total"), F.bool_and("_ok").alias("passed"))


def stable_numbers(items: DataFrame, previous: DataFrame, *, kind: str, item: str, number: str, order: Sequence[str]) -> DataFrame:
    """Items with their number: known items keep theirs, new ones go on from the kind's greatest in ``order``."""
    j = items.join(previous.select(kind, item, F.col(number).alias("_old")), [kind, item], "left")
    top = previous.groupBy(kind).agg(F.max(number).alias("_top"))
    w = Window.partitionBy(kind, F.col("_old").isNull()).orderBy(*order, item)
    j = j.join(top, kind, "left").withColumn("_rn", F.row_number().over(w))
    return j.withColumn(number, F.coalesce("_old", F.coalesce("_top", F.lit(0)) + F.col("_rn")).cast("bigint")).drop("_old", "_top", "_rn")


def renumbered(df: DataFrame, *, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def increasing_share(df: DataFrame, *, group: Sequence[str], order: Sequence[str], value: str, least: int = 1, most: int = 3) -> DataFrame:
    """(group, n, steps, numbered): do values count up? At least 3 of them, and at least max(2, n div 2) steps within least..most."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.withColumn("_step", F.lead(value).over(w) - F.col(value))
    per = d.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("_step").between(least, most)).alias("steps"))
    return per.withColumn("numbered", (F.col("n") >= 3) & (F.col("steps") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))))


def runs(df: DataFrame, *, group: Sequence[str], order: str, breaks: Column) -> DataFrame:
    """``df`` with ``run``: the number of breaks up to this row (gaps and islands). ``breaks`` may use lag() over the same order through named columns."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("run", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(w).cast("bigint"))


def sessions(df: DataFrame, *, group: Sequence[str], at: str, gap_seconds: int) -> DataFrame:
    """``df`` with ``session``: a new one after every pause longer than the gap."""
    w = Window.partitionBy(*group).orderBy(at)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return runs(df.withColumn("_pause", pause), group=group, order=at, breaks=F.col("_pause") > gap_seconds * 1_000_000).drop("_pause").withColumnRenamed("run", "session")


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted array: of two middle ones the greater. Null for an empty array."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_median_per_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, upper_median) without gathering a group: rank within the group and keep the row at n div 2."""
    d = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_to", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    at = F.floor(F.col("n") / 2) + 1
    return d.where((F.col("_to") >= at) & (F.col("_to") - F.col("_c") < at)).select(*group, "n", F.col(value).alias("upper_median"))


def mode_per_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, mode): the most frequent value, ties to the least one."""
    d = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    return d.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias("mode"))


def gap_medians(df: DataFrame, *, group: Sequence[str], value: str, least: float) -> DataFrame:
    """(group, n, upper_median) of the gaps above ``least`` between neighbouring distinct values."""
    d = df.select(*group, value).distinct()
    d = d.withColumn("gap", F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(value))).where(F.col("gap") > least)
    return upper_median_per_group(d, group, "gap")


def leading_issues(lines: DataFrame, expected: DataFrame, *, frame: str, at: str, leading: str) -> DataFrame:
    """(frame, observed): frames whose line distance is not the expected one, within 0.75 points; ``observed`` is null where no distance is plausible.

    Places are taken to half points, gaps of a point and less are one line, plausible gaps are 0.75 to 1.6 times the expected;
    of these the upper median counts. Frames of one line or without expectation are left out.
    """
    d = lines.where(F.col(at).isNotNull()).select(frame, (F.bround(F.col(at) * 2) / 2).alias("_at")).distinct()
    gaps = d.withColumn("_gap", F.col("_at") - F.lag("_at").over(Window.partitionBy(frame).orderBy("_at"))).where("_gap > 1").join(expected.select(frame, F.col(leading).alias("_want")), frame)
    plausible = upper_median_per_group(gaps.where("_gap BETWEEN _want * 0.75 AND _want * 1.6"), [frame], "_gap").select(frame, F.col("upper_median").alias("observed"))
    met = gaps.groupBy(frame).agg(F.any_value("_want").alias("_want")).join(plausible, frame, "left")
    return met.where(F.coalesce(F.abs(F.col("observed") - F.col("_want")) > 0.75, F.lit(True))).select(frame, "observed")


def holds_in_order(parts: Column, text: Column) -> Column:
    """Do all parts occur in the text one after the other? A cursor moves past each part found. Empty and null parts are passed over."""
    wanted = F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != "")
    after = lambda a, p: F.position(p, text, a)
    at = F.aggregate(wanted, F.lit(1), lambda a, p: F.when((a > 0) & (after(a, p) > 0), after(a, p) + F.length(p)).otherwise(0))
    return F.coalesce(at > 0, F.lit(False))


def headings_in_order(headings: Sequence[str], text: Column) -> Column:
    """Are all headings there, first occurrences in the given order?"""
    places = F.array(*[F.position(F.lit(h), text) for h in headings])
    return F.forall(places, lambda p: p > 0) & (F.array_sort(places) == places)


def carry_section(df: DataFrame, *, group: Sequence[str], order: Sequence[str], heading: str, name: str = "section") -> DataFrame:
    """``df`` with the last heading seen so far in the group ('' before the first)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("")))


def funnel_breaks(df: DataFrame, *, group: Sequence[str], order: str, n: str) -> DataFrame:
    """Stages of a funnel that count more than the stage before them, with ``before``. Stages without a count are passed over, never filled in."""
    w = Window.partitionBy(*group).orderBy(order)
    d = df.where(F.col(n).isNotNull()).withColumn("before", F.lag(n).over(w))
    return d.where(F.col(n) > F.col("before"))
