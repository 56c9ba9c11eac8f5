"""References that point at nothing, at something deleted, or at something that came later.

References are pre-aggregated per key and month, which removes any skew before the first shuffle. The
groups of heavy keys (a bounded number of keys) are broadcast and checked where the targets are read;
the keys that remain meet the targets in a shuffle anti-join, and what has a target is judged against
its periods. Both verdicts are united. Where a group's time range allows, it is judged as a whole; only
rows of groups that are not clean meet a join again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_key, month_of
from ..session import materialize

HEAVY_SHARE = 1000  # a key is heavy with more than 1/HEAVY_SHARE of all references, so there are fewer heavy keys than that
MAX_BROADCAST_ROWS = 1_000_000  # of groups and periods of heavy keys


def references(df: DataFrame, *, table: str, field: str, row_id: str, at: str) -> DataFrame:
    """(ref_table, ref_field, row_id, key, at, ref_month); null and blank references are none."""
    return df.select(
        F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row_id).alias("row_id"),
        id_key(F.col(field)).alias("key"), F.col(at).alias("at"), month_of(F.col(at)).alias("ref_month"),
    ).where("key IS NOT NULL AND at IS NOT NULL")


def periods_from_events(df: DataFrame, *, field: str, key: str, adds: str, at: str, order: str) -> DataFrame:
    """Alive periods of targets in an add/remove log: (ref_field, key, start, stop).

    ``adds`` is a boolean column. Events count in the order of ``at`` (ties: ``order``). Repeats of
    the same kind of event are dropped per key and month first, so that a hot key is already short
    when its whole sequence is put in order.
    """
    e = df.select(id_key(F.col(key)).alias("key"), F.col(adds).alias("adds"), F.col(at).alias("at"), F.col(order).alias("o")).where("key IS NOT NULL AND at IS NOT NULL")
    e = e.withColumn("month", month_of(F.col("at")))
    for part in (["key", "month"], ["key"]):
        w = Window.partitionBy(*part).orderBy("at", "o")
        e = e.withColumn("before", F.lag("adds").over(w)).where("before IS NULL OR before <> adds")
    w = Window.partitionBy("key").orderBy("at", "o")
    e = e.withColumn("stop", F.lead("at").over(w)).where("adds")
    return e.select(F.lit(field).alias("ref_field"), "key", F.col("at").alias("start"), "stop")


def periods_from_rows(df: DataFrame, *, field: str, key: str, start: str, stop: str) -> DataFrame:
    """Periods of targets kept as rows with a start and an optional end; those that overlap are merged within the month they begin in, so that a hot key is short."""
    r = df.select(id_key(F.col(key)).alias("key"), F.col(start).alias("start"), F.col(stop).alias("stop")).where("key IS NOT NULL AND start IS NOT NULL")
    r = r.groupBy("key", "stop").agg(F.min("start").alias("start")).withColumn("month", month_of(F.col("start")))
    w = Window.partitionBy("key", "month").orderBy("start")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    r = r.withColumn("end", F.coalesce("stop", far)).withColumn("opens", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start"), F.lit(True)))
    r = r.withColumn("run", F.sum(F.col("opens").cast("int")).over(upto))
    m = r.groupBy("key", "month", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return m.select(F.lit(field).alias("ref_field"), "key", "start", F.when(F.col("end") < far, F.col("end")).alias("stop"))


_KEY = ["ref_field", "key"]
_GROUP = ["ref_table", *_KEY, "ref_month"]


def _near() -> Column:
    """The period touches the group's time range."""
    return (F.col("start") <= F.col("hi")) & (F.col("stop").isNull() | (F.col("stop") > F.col("lo")))


def _verdicts(met: DataFrame) -> DataFrame:
    """Verdicts of groups from the rows (group, lo, hi, start, stop) of their join with periods: OK, LATE or DELETED where it holds for all references of the group, else MIXED."""
    g = met.groupBy(*_GROUP, "n", "lo", "hi").agg(
        F.min("start").alias("first_at"), F.bool_or((F.col("start") <= F.col("lo")) & (F.col("stop").isNull() | (F.col("stop") > F.col("hi")))).alias("covers"), F.bool_or(_near()).alias("near")
    )
    verdict = F.when(F.col("hi") < F.col("first_at"), "LATE").when(F.col("lo") < F.col("first_at"), "MIXED").when(F.col("covers"), "OK").when(~F.col("near"), "DELETED").otherwise("MIXED")
    return g.withColumn("verdict", verdict).select(*_GROUP, "n", "lo", "hi", "verdict", "first_at")


def _missing(groups: DataFrame) -> DataFrame:
    return groups.select(*_GROUP, "n", "lo", "hi", F.lit("MISSING").alias("verdict"), F.lit(None).cast("timestamp_ntz").alias("first_at"))


def judged_groups(refs: DataFrame, periods: DataFrame, total: int, *, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Groups of references that are not clean (ref_table, ref_field, key, ref_month, n, heavy, verdict, first_at, periods), and the heavy keys, as written tables.

    verdict: MISSING, LATE or DELETED where it holds for all references of the group, else MIXED, with the
    periods that touch the group's time range. The groups of heavy keys are broadcast to the periods if
    there are at most ``max_broadcast_rows`` of them, else they meet by a shuffle, too.
    """
    periods = materialize(periods, "periods")
    groups = materialize(refs.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")), "reference-groups")
    keys = materialize(groups.groupBy(*_KEY).agg(F.sum("n").alias("n")), "reference-keys")
    most = max(1, total // HEAVY_SHARE)
    heavy_keys = keys.where(F.col("n") > most).select(*_KEY)
    heavy = groups.join(F.broadcast(heavy_keys), _KEY, "left_semi")
    light = groups.join(F.broadcast(heavy_keys), _KEY, "left_anti")
    few = heavy.count() <= max_broadcast_rows
    checked = materialize(_verdicts(periods.join(F.broadcast(heavy) if few else heavy, _KEY)), "heavy-groups")
    of_heavy = checked.unionByName(_missing(heavy.join(checked.select(*_GROUP), _GROUP, "left_anti"))).withColumn("heavy", F.lit(True))
    missing_keys = materialize(keys.where(F.col("n") <= most).join(periods.select(*_KEY), _KEY, "left_anti").select(*_KEY), "missing-keys")
    of_light = _missing(light.join(missing_keys, _KEY, "left_semi")).unionByName(_verdicts(light.join(periods, _KEY))).withColumn("heavy", F.lit(False))
    bad = materialize(of_heavy.unionByName(of_light).where("verdict <> 'OK'"), "orphan-groups")
    # only mixed groups are judged row by row, so only these need their periods
    mixed = bad.where("verdict = 'MIXED'").select(*_GROUP, "lo", "hi").join(periods, _KEY).where(_near()).groupBy(*_GROUP).agg(F.collect_list(F.struct("start", "stop")).alias("periods"))
    whole = bad.join(mixed, _GROUP, "left").withColumn("periods", F.coalesce("periods", F.array().cast("array<struct<start:timestamp_ntz,stop:timestamp_ntz>>")))
    return materialize(whole.drop("lo", "hi"), "judged-groups"), heavy_keys


def _rows_of(refs: DataFrame, bad: DataFrame, heavy_keys: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Orphan rows of the groups ``bad``: heavy keys by broadcast (if their groups and periods are few enough), all others by shuffle."""
    few = bad.where("heavy").agg(F.coalesce(F.sum(1 + F.size("periods")), F.lit(0))).first()[0] <= max_broadcast_rows
    named = bad.select(*_GROUP, "verdict", "first_at", "periods", "heavy")
    hot = named.where("heavy")
    # clean rows of heavy keys never reach the shuffle
    light = refs.join(F.broadcast(heavy_keys), _KEY, "left_anti").join(named.where("NOT heavy"), _GROUP)
    met = light.unionByName(refs.join(F.broadcast(heavy_keys), _KEY, "left_semi").join(F.broadcast(hot) if few else hot, _GROUP))
    alive = F.exists("periods", lambda p: (p["start"] <= F.col("at")) & (p["stop"].isNull() | (p["stop"] > F.col("at"))))
    reason = F.when(F.col("verdict") != "MIXED", F.col("verdict")).when(F.col("at") < F.col("first_at"), "LATE").when(~alive, "DELETED")
    return met.withColumn("reason", reason).where("reason IS NOT NULL").select("ref_table", "ref_field", "row_id", "reason", "ref_month")


def orphans(refs: DataFrame, periods: DataFrame, total: int, *, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every orphan reference: (ref_table, ref_field, row_id, reason, ref_month).

    MISSING: the target never exists. LATE: it first exists after the reference. DELETED: it is gone
    at the reference time (inclusive). Empty inputs give an empty result; a repeated reference row
    counts once per row id. ``total`` is the number of references, for the heavy-key threshold.
    """
    bad, heavy_keys = judged_groups(refs, periods, total, max_broadcast_rows=max_broadcast_rows)
    return _rows_of(refs, bad, heavy_keys, max_broadcast_rows)


def orphan_counts(refs: DataFrame, periods: DataFrame, total: int, *, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(ref_table, ref_field, ref_month, reason, n_orphans): counts of groups judged as a whole, and of the rows of mixed groups, united."""
    bad, heavy_keys = judged_groups(refs, periods, total, max_broadcast_rows=max_broadcast_rows)
    whole = bad.where("verdict <> 'MIXED'").groupBy("ref_table", "ref_field", "ref_month", F.col("verdict").alias("reason")).agg(F.sum("n").alias("n"))
    single = _rows_of(refs, bad.where("verdict = 'MIXED'"), heavy_keys, max_broadcast_rows).groupBy("ref_table", "ref_field", "ref_month", "reason").agg(F.count("*").alias("n"))
    return whole.unionByName(single).groupBy("ref_table", "ref_field", "ref_month", "reason").agg(F.sum("n").alias("n_orphans"))
