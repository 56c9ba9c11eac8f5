"""Declared invariants as rows (code, passed, detail), and the report they make up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """An invariant over all rows of a table: ``holds`` must be true for each (null fails). ``example`` names the offender shown."""

    code: str
    holds: Column
    example: Column | None = None


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: (code, passed, n_failed, detail). All checks are read off in a single pass; an empty table passes all."""
    aggregates = []
    for i, c in enumerate(checks):
        bad = ~F.coalesce(c.holds, F.lit(False))
        aggregates.append(F.count_if(bad).alias(f"n{i}"))
        aggregates.append((F.min(F.when(bad, c.example.cast("string"))) if c.example is not None else F.max(F.lit(""))).alias(f"d{i}"))
    one = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c.code).alias("code"), (F.col(f"n{i}") == 0).alias("passed"), F.col(f"n{i}").alias("n_failed"), F.coalesce(f"d{i}", F.lit("")).alias("detail")) for i, c in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def empty_is_passed(code: str, offenders: DataFrame, example: Column) -> DataFrame:
    """A check that passes if a relation of offenders is empty."""
    return offenders.agg(F.count("*").alias("n"), F.min(example.cast("string")).alias("d")).select(F.lit(code).alias("code"), (F.col("n") == 0).alias("passed"), F.col("n").alias("n_failed"), F.coalesce("d", F.lit("")).alias("detail"))


def offenders(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(code, example) of every row that breaks a check, all read off in a single pass."""
    bad = [F.when(~F.coalesce(c.holds, F.lit(False)), F.struct(F.lit(c.code).alias("code"), (c.example if c.example is not None else F.lit("")).cast("string").alias("example"))) for c in checks]
    return df.select(F.explode(F.array_compact(F.array(*bad))).alias("o")).select("o.*")


def suite(codes: Sequence[str], *relations: DataFrame) -> DataFrame:
    """(code, passed, n_failed, detail) for each code, from relations of offenders (code, example): passed where there is none; detail is the least example."""
    union = relations[0]
    for r in relations[1:]:
        union = union.unionByName(r)
    found = union.groupBy("code").agg(F.count("*").alias("n"), F.min(F.coalesce("example", F.lit(""))).alias("d"))
    named = union.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    return named.join(found, "code", "left").select("code", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n_failed"), F.coalesce("d", F.lit("")).alias("detail"))


def united(*suites: DataFrame) -> DataFrame:
    """The rows of several suites as those of one gate."""
    out = suites[0]
    for s in suites[1:]:
        out = out.unionByName(s)
    return out


def report(checks: DataFrame, *, validator: str) -> DataFrame:
    """One row (validator, passed, n_checks, n_failed, first_failure, checks): passed if every check is. No checks: passed."""
    c = checks.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"),
        F.coalesce(F.min(F.when(~F.col("passed"), F.col("code"))), F.lit("")).alias("first_failure"), F.to_json(F.array_sort(F.collect_list(F.struct("code", "passed", "detail")))).alias("checks"),
    )
    return c.select(F.lit(validator).alias("validator"), "*")


def suite_summary(outcomes: DataFrame, *, suite: str, outcome: str, allow_skips: bool = False) -> DataFrame:
    """(suite, run, passed, failures, errors, skipped, ok) of outcome rows (ok, failure, error, skip)."""
    n = lambda v: F.count_if(F.col(outcome) == v)
    s = outcomes.groupBy(suite).agg(F.count("*").alias("run"), n("ok").alias("passed"), n("failure").alias("failures"), n("error").alias("errors"), n("skip").alias("skipped"))
    return s.withColumn("ok", (F.col("failures") + F.col("errors") == 0) & (F.lit(allow_skips) | (F.col("skipped") == 0)))
