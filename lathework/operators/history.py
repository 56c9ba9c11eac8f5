"""Full history of slowly changing attributes from periodic snapshots.

Every attribute gets its own change log with its own validity intervals. The entity's versions are
the intervals combined: time is split at the union of all attributes' boundary dates, each segment
takes the value every attribute had there, and neighbouring segments with equal values coalesce.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text_or_blank
from ..session import materialize

SALT = 32
MAX_CALENDAR_ROWS = 500_000  # of a calendar that is broadcast: about 30 bytes each


def latest_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str | Column], *, loaded_at: str, row_id: str) -> DataFrame:
    """One row per key: the one loaded last (ties: the larger row id). Aggregates before the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(loaded_at, row_id)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def snapshot_calendar(df: DataFrame, *, scope: str, date: str) -> DataFrame:
    """(scope, date, seq, next_date): the snapshots a scope really has, numbered from 1."""
    w = Window.partitionBy(scope).orderBy(date)
    return (
        df.select(scope, date).where(F.col(scope).isNotNull() & F.col(date).isNotNull()).distinct()
        .withColumn("seq", F.row_number().over(w))
        .withColumn("next_date", F.lead(date).over(w))
    )


def attribute_log(df: DataFrame, *, scope: str, date: str, entity: str, attributes: Sequence[str], loaded_at: str, row_id: str, max_calendar_rows: int = MAX_CALENDAR_ROWS) -> DataFrame:
    """Per-attribute change log with intervals: (scope, entity, attribute, value, valid_from, valid_to).

    A row opens where the attribute takes a value that the snapshot just before did not show (the
    entity was absent, or the value was another); valid_to is the next change of this attribute, or
    the first later snapshot without the entity, or null. Null and blank values are one and the
    same. Rows without scope, date or entity make no version, though rows without entity still
    date a snapshot. An empty table gives an empty log. The calendar of all scopes is broadcast if it
    has at most ``max_calendar_rows`` rows. All that follows the rows' one exchange by entity stays in
    the partitions it makes.
    """
    values = [text_or_blank(F.col(a)).alias(f"_a{i}") for i, a in enumerate(attributes)]
    names = [f"_a{i}" for i in range(len(attributes))]
    known = df.select(
        F.col(scope).alias("_scope"), F.col(date).alias("_date"), F.nullif(strip(F.col(entity)), F.lit("")).alias("_entity"),
        F.col(loaded_at).alias("_loaded"), F.col(row_id).alias("_row"), *values,
    )
    calendar = materialize(snapshot_calendar(known, scope="_scope", date="_date"), "calendar")
    rows = latest_rows(known.where("_scope IS NOT NULL AND _date IS NOT NULL AND _entity IS NOT NULL"), ["_scope", "_date", "_entity"], names, loaded_at="_loaded", row_id="_row")
    if calendar.count() <= max_calendar_rows:
        rows = rows.join(F.broadcast(calendar), ["_scope", "_date"])
    else:
        # a scope may hold a third of all rows, so its dates are spread over SALT sub-keys; the calendar is repeated for each
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_entity"), F.lit(SALT)).cast("int"))
        rows = rows.join(calendar.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["_scope", "_date", "_salt"]).drop("_salt")

    w = Window.partitionBy("_scope", "_entity").orderBy("seq")
    before, after = F.lag("seq").over(w), F.lead("seq").over(w)
    rows = rows.withColumn("_opens", before.isNull() | (before != F.col("seq") - 1)).withColumn("_ends", after.isNull() | (after != F.col("seq") + 1))
    for n in names:
        rows = rows.withColumn(f"{n}_new", F.col("_opens") | (F.col(n) != F.lag(n).over(w)))
    changes = [
        F.when(F.col(f"{n}_new"), F.struct(F.lit(i).alias("attr"), F.col(n).alias("value"), F.col("_date").alias("at"), F.lit(False).alias("gone")))
        for i, n in enumerate(names)
    ]
    ends = [F.when(F.col("_ends"), F.struct(F.lit(i).alias("attr"), F.lit(None).cast("string").alias("value"), F.col("next_date").alias("at"), F.lit(True).alias("gone"))) for i in range(len(names))]
    log = rows.select("_scope", "_entity", F.explode(F.filter(F.array(*changes, *ends), lambda e: e.isNotNull())).alias("e")).select("_scope", "_entity", "e.*")
    per = Window.partitionBy("_scope", "_entity", "attr").orderBy(F.col("at").asc_nulls_last(), "gone")
    log = log.withColumn("valid_to", F.lead("at").over(per)).where("NOT gone")
    labels = F.array(*[F.lit(a) for a in attributes])
    return log.select(F.col("_scope").alias("scope"), F.col("_entity").alias("entity"), F.element_at(labels, F.col("attr") + 1).alias("attribute"), "value", F.col("at").alias("valid_from"), "valid_to")


def combine_intervals(log: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Versions from the attribute log: (scope, entity, *attributes, valid_from, valid_to)."""
    # both ends of an interval come from one row, so that the log is worked out once
    opens = F.struct(F.col("valid_from").alias("at"), "value")
    closes = F.struct(F.col("valid_to").alias("at"), F.lit(None).cast("string").alias("value"))
    ends = log.select("scope", "entity", "attribute", F.explode(F.array(opens, closes)).alias("e")).select("scope", "entity", "attribute", "e.*").where("at IS NOT NULL")
    cut = ends.groupBy("scope", "entity", "at").agg(
        *[F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(f"_v{i}") for i, a in enumerate(attributes)],
        *[F.max(F.when(F.col("attribute") == a, F.col("value").isNull())).alias(f"_s{i}") for i, a in enumerate(attributes)],
    )
    w = Window.partitionBy("scope", "entity").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at a boundary an attribute is set (value), stopped (flag without value) or untouched (neither): carry the last of the two forward
    for i, _ in enumerate(attributes):
        event = F.when(F.col(f"_v{i}").isNotNull() | F.col(f"_s{i}"), F.struct(F.col(f"_v{i}").alias("v")))
        cut = cut.withColumn(f"_c{i}", F.last(event, ignorenulls=True).over(upto)["v"])
    cut = cut.withColumn("_to", F.lead("at").over(w))
    current = F.struct(*[F.col(f"_c{i}") for i in range(len(attributes))])
    cut = cut.withColumn("_now", current).withColumn("_same", F.coalesce(F.lag("_now").over(w).eqNullSafe(F.col("_now")), F.lit(False)))
    run = cut.withColumn("_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(upto))
    run = run.groupBy("scope", "entity", "_run").agg(F.min("at").alias("valid_from"), F.max(F.struct("at", "_to"))["_to"].alias("valid_to"), F.first("_now").alias("_now"))
    some = F.lit(False)
    for i, _ in enumerate(attributes):
        some = some | F.col(f"_now._c{i}").isNotNull()
    return run.where(some).select("scope", "entity", *[F.col(f"_now._c{i}").alias(a) for i, a in enumerate(attributes)], "valid_from", "valid_to")


def versions(df: DataFrame, *, scope: str, date: str, entity: str, attributes: Sequence[str], loaded_at: str, row_id: str, max_calendar_rows: int = MAX_CALENDAR_ROWS) -> DataFrame:
    return combine_intervals(attribute_log(df, scope=scope, date=date, entity=entity, attributes=attributes, loaded_at=loaded_at, row_id=row_id, max_calendar_rows=max_calendar_rows), attributes)
