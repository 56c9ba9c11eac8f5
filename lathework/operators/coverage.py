"""What should be there against what is: differences of sets, bags, sequences and linked tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(expected: DataFrame, found: DataFrame, keys: Sequence[str], compare: Sequence[str] = ()) -> DataFrame:
    """(keys, issue, differing): keys MISSING from ``found``, EXTRA in it, or there with other values (MISMATCH).

    Repeated keys count once; null keys equal each other; null values equal each other. ``differing`` lists the columns of a mismatch.
    """
    e = expected.select(*keys, *compare).dropDuplicates(list(keys)).select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(compare)], F.lit(True).alias("_in_e"))
    f = found.select(*keys, *compare).dropDuplicates(list(keys)).select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_y{i}") for i, c in enumerate(compare)], F.lit(True).alias("_in_f"))
    cond = F.lit(True)
    for i, _ in enumerate(keys):
        cond = cond & F.col(f"_e{i}").eqNullSafe(F.col(f"_f{i}"))
    j = e.join(f, cond, "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"_x{i}").eqNullSafe(F.col(f"_y{i}")), F.lit(c)) for i, c in enumerate(compare)]), lambda c: c.isNotNull()) if compare else F.array().cast("array<string>")
    issue = F.when(F.col("_in_f").isNull(), "MISSING").when(F.col("_in_e").isNull(), "EXTRA").when(F.size("_d") > 0, "MISMATCH")
    j = j.withColumn("_d", differing).withColumn("issue", issue).where("issue IS NOT NULL")
    return j.select(*[F.coalesce(f"_e{i}", f"_f{i}").alias(k) for i, k in enumerate(keys)], "issue", F.when(F.col("issue") == "MISMATCH", F.array_join("_d", ",")).otherwise("").alias("differing"))


def missing_numbers(df: DataFrame, group: Sequence[str], number: str, *, first: int = 1) -> DataFrame:
    """(group, number): numbers from ``first`` to the group's greatest that no row has. Only the gaps are written out, never a whole group."""
    d = df.where(F.col(number) >= first).select(*group, F.col(number).cast("bigint").alias(number)).distinct()
    d = d.withColumn("_from", F.coalesce(F.lag(number).over(Window.partitionBy(*group).orderBy(number)) + 1, F.lit(first).cast("bigint")))
    return d.where(F.col(number) > F.col("_from")).select(*group, F.explode(F.sequence("_from", F.col(number) - 1)).alias(number))


def is_sequence(df: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """(group, n, passed): are the numbers exactly 1..n, each once?"""
    per = df.groupBy(*group).agg(F.count("*").alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.countDistinct(number).alias("d"))
    return per.select(*group, "n", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("passed"))


def broken_links(children: DataFrame, parents: DataFrame, *, child: str, parent: str) -> DataFrame:
    """(side, key): references of children without parent, and parents without child."""
    no_parent = children.where(F.col(child).isNotNull()).join(parents, children[child] == parents[parent], "left_anti").select(F.lit("no_parent").alias("side"), F.col(child).alias("key"))
    no_child = parents.join(children, children[child] == parents[parent], "left_anti").select(F.lit("no_child").alias("side"), F.col(parent).alias("key"))
    return no_parent.unionByName(no_child).distinct()


def bag_difference(df: DataFrame, group: Sequence[str], token: str, side: str) -> DataFrame:
    """(group, token, missing, added): signed multiset difference; ``side`` is true for the source and false for the target."""
    signed = df.groupBy(*group, token).agg(F.sum(F.when(F.col(side), 1).otherwise(-1)).alias("d")).where("d <> 0")
    return signed.select(*group, token, F.greatest(F.col("d"), F.lit(0)).cast("bigint").alias("missing"), F.greatest(-F.col("d"), F.lit(0)).cast("bigint").alias("added"))


def cancel_within(diff: DataFrame, *, page: Sequence[str], unit: str, token: str) -> DataFrame:
    """What is left of (page, unit, token, missing, added) after a token missing in one unit of a page is set off against the same token added in another.

    Earlier units are set off first: each side's counts run up in the order of units, and what lies below the other side's total is gone.
    """
    w = Window.partitionBy(*page, token)
    upto = w.orderBy(unit).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def left(own: str, other: str) -> Column:
        until = F.sum(own).over(upto)
        return F.greatest(F.lit(0), F.least(F.col(own), until - F.sum(other).over(w))).cast("bigint")

    out = diff.withColumn("_m", left("missing", "added")).withColumn("_a", left("added", "missing"))
    return out.select(*page, unit, token, F.col("_m").alias("missing"), F.col("_a").alias("added")).where("missing > 0 OR added > 0")


def without_allowed(diff: DataFrame, allowed: DataFrame, *, unit: str, token: str) -> DataFrame:
    """``diff`` (unit, token, missing, added) without what a whitelist accepts.

    ``allowed`` has (unit, kind, source_token, translated_token) with kind MISSING, ADDED or PAIR. One-sided entries clear a
    token's whole side. A pair clears as many of both sides as can be paired; pairs are reusable.
    """
    one = allowed.groupBy(unit, F.when(F.col("kind") == "MISSING", F.col("source_token")).otherwise(F.col("translated_token")).alias(token)).agg(
        F.bool_or(F.col("kind") == "MISSING").alias("_ok_m"), F.bool_or(F.col("kind") == "ADDED").alias("_ok_a"), F.bool_and(F.col("kind") == "PAIR").alias("_pair")
    ).where("NOT _pair").drop("_pair")
    d = diff.join(one, [unit, token], "left")
    d = d.withColumn("missing", F.when(F.col("_ok_m"), 0).otherwise(F.col("missing"))).withColumn("added", F.when(F.col("_ok_a"), 0).otherwise(F.col("added"))).drop("_ok_m", "_ok_a")
    pairs = allowed.where("kind = 'PAIR'").select(unit, "source_token", "translated_token").distinct()
    m = d.where("missing > 0").select(unit, F.col(token).alias("source_token"), F.col("missing").alias("_m"))
    a = d.where("added > 0").select(unit, F.col(token).alias("translated_token"), F.col("added").alias("_a"))
    met = pairs.join(m, [unit, "source_token"]).join(a, [unit, "translated_token"]).withColumn("_n", F.least("_m", "_a"))
    used = met.select(unit, F.col("source_token").alias(token), F.col("_n").alias("_um"), F.lit(0).alias("_ua")).unionByName(met.select(unit, F.col("translated_token").alias(token), F.lit(0).alias("_um"), F.col("_n").alias("_ua")))
    used = used.groupBy(unit, token).agg(F.sum("_um").alias("_um"), F.sum("_ua").alias("_ua"))
    d = d.join(used, [unit, token], "left")
    d = d.withColumn("missing", F.greatest(F.lit(0), F.col("missing") - F.coalesce("_um", F.lit(0)))).withColumn("added", F.greatest(F.lit(0), F.col("added") - F.coalesce("_ua", F.lit(0))))
    return d.drop("_um", "_ua").where("missing > 0 OR added > 0")


def unmatched_copies(reference: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``reference`` beyond the copies that ``source`` has of the same key, all columns kept."""
    have = source.groupBy(*keys).agg(F.count("*").alias("_have"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return reference.withColumn("_rn", F.row_number().over(w)).join(have, list(keys), "left").where(F.col("_rn") > F.coalesce("_have", F.lit(0))).drop("_rn", "_have")


def id_report(df: DataFrame, column: str) -> DataFrame:
    """One row (n_rows, n_blank, n_distinct, n_duplicated): how well a column identifies."""
    per = df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    blank = F.col("k").isNull() | (F.trim(F.col("k").cast("string")) == "")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(count("n").alias("n_rows"), count(F.when(blank, F.col("n"))).alias("n_blank"), count(F.when(~blank, 1)).alias("n_distinct"), count(F.when(~blank & (F.col("n") > 1), 1)).alias("n_duplicated"))


def compare_landed(spec: DataFrame, landed: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """Spec rows against landed rows by key: (key, failed) with the names of the failed checks, ``absent`` where nothing landed.

    The checks see the columns of ``landed`` prefixed with ``r_``; a check that is null fails.
    """
    r = landed.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in landed.columns if c != key], F.lit(True).alias("_there"))
    j = spec.join(r, key, "left")
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return j.select(key, F.when(F.col("_there").isNull(), F.array(F.lit("absent"))).otherwise(failed).alias("failed"))
