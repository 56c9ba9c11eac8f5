"""Declared rules as tables: routing by sets, weighted ranking behind a gate, preferred versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route(profiles: DataFrame, rules: DataFrame, *, key: str, values: str) -> DataFrame:
    """(key, outcomes): for each profile (array column ``values``) the outcomes of all rules it meets, each once, in rule order.

    ``rules`` is (ordinal, any_of array, outcome). Values meet rules by an equi-join on single values; the first rule that gives an outcome places it.
    """
    want = rules.select("ordinal", "outcome", F.explode("any_of").alias("value"))
    have = profiles.select(key, F.explode(F.array_distinct(values)).alias("value"))
    hits = have.join(want, "value").groupBy(key, "outcome").agg(F.min("ordinal").alias("ordinal"))
    per = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "outcome"))), lambda s: s["outcome"]).alias("outcomes"))
    return profiles.select(key).join(per, key, "left").withColumn("outcomes", F.coalesce("outcomes", F.array().cast("array<string>")))


def unknown_values(profiles: DataFrame, vocabulary: Sequence[str], *, key: str, values: str) -> DataFrame:
    """(key, unknown): values outside of the vocabulary."""
    return profiles.select(key, F.array_except(values, F.array(*[F.lit(v) for v in vocabulary])).alias("unknown")).where(F.size("unknown") > 0)


def weighted_score(weights: Mapping[str, float], best: float):  # noqa: ANN201
    """Weighted sum of rated components (0..best) as a share of 100; null ratings count as 0."""
    total = sum(weights.values())
    return F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)) / (best * total) * 100, 4)


def ranked(df: DataFrame, *, group: Sequence[str], gate: Mapping[str, int], gate_column: str, barred: Sequence[str], score: str, tie: str, keep: int) -> DataFrame:
    """The best ``keep`` rows of a group: gate first, then score, ties by ``tie``; barred gates never rank."""
    order = F.lit(len(gate))
    for value, place in gate.items():
        order = F.when(F.col(gate_column) == value, place).otherwise(order)
    w = Window.partitionBy(*group).orderBy(order, F.col(score).desc_nulls_last(), tie)
    return df.where(~F.col(gate_column).isin(*barred)).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep)


def preferred_version(df: DataFrame, *, key: str, kind: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the kind that comes first in ``order``, ties to the latest ``version``."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind)), F.lit(0))
    rank = F.when(place == 0, len(order) + 1).otherwise(place)
    best = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(-rank, F.col("version")))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def recency(year: Column, now: Column) -> Column:
    """Role of a work by its age in years: CURRENT to 2, RECENT_SUPPORT to 5, else FOUNDATIONAL; null for an unknown year."""
    age = now - year
    return F.when(age <= 2, "CURRENT").when(age <= 5, "RECENT_SUPPORT").when(age.isNotNull(), "FOUNDATIONAL")


def closure(outcomes: DataFrame, *, key: str, outcome: str, planned: str) -> DataFrame:
    """(key, n, closure) of hypotheses from the outcomes (SUPPORTED, NOT_SUPPORTED, other) of their tests: all of one kind decide, mixed ones are partial, none decided is not determined, and what was not planned is a finding."""
    yes, no = F.count_if(F.col(outcome) == "SUPPORTED"), F.count_if(F.col(outcome) == "NOT_SUPPORTED")
    per = outcomes.groupBy(key).agg(F.count("*").alias("n"), yes.alias("_yes"), no.alias("_no"), F.bool_or(F.coalesce(F.col(planned), F.lit(False))).alias("_planned"))
    said = F.when(~F.col("_planned"), "Unplanned Finding").when(F.col("_yes") + F.col("_no") == 0, "Cannot Determine").when(F.col("_yes") == F.col("n"), "Fully Supported").when(F.col("_yes") == 0, "Not Supported").otherwise("Partially Supported")
    return per.select(key, "n", said.alias("closure"))


def propagated(changed: DataFrame, edges: DataFrame, *, key: str, stage: str, depth: int = 3) -> DataFrame:
    """(key, stage, steps): stages to update again: the changed ones (0 steps) and, along ``edges`` (from_stage, to_stage), what depends on them within ``depth`` steps; the least number counts."""
    reached = changed.select(key, stage).distinct().withColumn("steps", F.lit(0))
    out = reached
    for i in range(1, depth + 1):
        reached = reached.join(edges.select(F.col("from_stage").alias(stage), "to_stage").distinct(), stage).select(key, F.col("to_stage").alias(stage)).distinct().withColumn("steps", F.lit(i))
        out = out.unionByName(reached)
    return out.groupBy(key, stage).agg(F.min("steps").alias("steps"))


def first_open(stages: DataFrame, *, key: str, stage: str, ordinal: str, done: Column) -> DataFrame:
    """(key, stage): where work goes on, the first stage that is not done; null where all are."""
    return stages.groupBy(key).agg(F.min_by(stage, F.when(~F.coalesce(done, F.lit(False)), F.col(ordinal))).alias(stage))
