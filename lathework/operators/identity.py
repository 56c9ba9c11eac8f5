"""Which rows are the same thing: pairwise identity over alternative keys, duplicate guards, canonical groups, current documents."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import component, identity, normalize_doi


def identity_links(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], *, left_id: str, right_id: str) -> DataFrame:
    """(left_id, links, representative): for each left row how many right rows are equal in any of the ``keys`` (left column, right column), and the least id of them.

    Null keys match nothing. No pairs are formed: right rows are counted per key and per combination of keys, and the counts
    of a left row's keys are added and subtracted (a row met under two keys counts once). Rows without links are left out.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    l = left.select(F.col(left_id).alias("left_id"), *[F.col(a).alias(n) for (a, _), n in zip(keys, names)])
    r = right.select(F.col(right_id).alias("_id"), *[F.col(b).alias(n) for (_, b), n in zip(keys, names)])
    links, least = F.lit(0).cast("bigint"), []
    for size in range(1, len(names) + 1):
        for subset in combinations(names, size):
            tag = "".join(subset)
            held = r
            for n in subset:
                held = held.where(F.col(n).isNotNull())
            l = l.join(held.groupBy(*subset).agg(F.count("*").alias(f"n{tag}"), F.min("_id").alias(f"m{tag}")), list(subset), "left")
            links = links + F.coalesce(f"n{tag}", F.lit(0)) * (1 if size % 2 else -1)
            least += [F.col(f"m{tag}")] if size == 1 else []
    return l.select("left_id", links.alias("links"), (F.least(*least) if len(least) > 1 else least[0]).alias("representative")).where("links > 0")


def find_records(df: DataFrame, field: str, value: str) -> DataFrame:
    """Rows with the given DOI (any spelling of it), or else with the given identifier, case and outer blanks ignored."""
    form = normalize_doi if field.lower() == "doi" else component
    return df.where(F.coalesce(form(F.col(field)) == form(F.lit(value)), F.lit(False)))


def matching_rows(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Rows of ``left`` that some row of ``right`` duplicates under any of the composed keys: a union of semi-joins, each row once."""
    tagged = left.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in left.columns else left
    hits = None
    for a, b in keys:
        other = right.select(*[F.col(y).alias(f"_k{i}") for i, y in enumerate(b)]).distinct()
        cond = [tagged[x] == other[f"_k{i}"] for i, x in enumerate(a)]
        one = tagged.join(other, cond, "left_semi")
        hits = one if hits is None else hits.unionByName(one)
    return hits.dropDuplicates(["_row"]).drop("_row")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows an append guarded by ``keys`` accepts: the first per key in ``order``. Null keys are one key. An aggregation, combined before the shuffle."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select("_first.*")


def duplicate_identities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(k0.., n): composed identities (trimmed, case ignored) that more than one row has."""
    return df.groupBy(identity(*[F.col(c) for c in columns]).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k.*", "n")


def canonical_groups(df: DataFrame, *, alias: str, key: str, fallback: str, order: str) -> DataFrame:
    """``df`` with ``identity``: the key that the alias maps to, else the row's own key, else the fallback.

    An alias (a second identifier such as a DOI) maps to the key of the last row in ``order`` that has both. A blank alias maps nothing.
    """
    known = df.where(F.col(alias).isNotNull() & (F.col(alias) != "") & F.col(key).isNotNull())
    mapping = known.groupBy(alias).agg(F.max_by(key, order).alias("_mapped"))
    return df.join(mapping, alias, "left").withColumn("identity", F.coalesce("_mapped", key, fallback)).drop("_mapped")


def current_rows(df: DataFrame, *, key: str, flag: str, preferred: str, order: str) -> DataFrame:
    """One row per key with ``ambiguous``: the only flagged row, else the only preferred one, else the last preferred (ambiguous), else the last.

    ``flag`` and ``preferred`` are boolean columns; ``order`` decides what is last.
    """
    flagged, favoured = F.coalesce(F.col(flag), F.lit(False)), F.coalesce(F.col(preferred), F.lit(False))
    last = lambda when: F.max_by(F.struct(*df.columns), F.when(when, F.col(order)))
    per = df.groupBy(F.col(key).alias("_key")).agg(
        F.count_if(flagged).alias("_flags"), F.count_if(favoured).alias("_prefs"), last(flagged).alias("_f"), last(favoured).alias("_p"), last(F.lit(True)).alias("_l")
    )
    row = F.when(F.col("_flags") == 1, F.col("_f")).when(F.col("_prefs") > 0, F.col("_p")).otherwise(F.col("_l"))
    return per.select(row.alias("_row"), ((F.col("_flags") != 1) & (F.col("_prefs") > 1)).alias("ambiguous")).select("_row.*", "ambiguous")
