"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Blocks of tokens are the seats. Sources get them by the highest quotients weight / (2k + 1), never
beyond what their records, each used at most max_repeats times, can fill. A block is small enough
that the smallest source has many. A source's tokens are apportioned to its shards the same way,
and each shard fills its quota with its records in a seeded order.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import materialize, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK_TOKENS = 1024
# the blocks that the smallest quota has at least, as far as it has the tokens
LEAST_BLOCKS = 1000
SHARD_TOKENS = 1 << 22
MAX_SOURCES = 100_000
MAX_GROUPS = 20_000  # groups of shards whose quotas are worked out on the driver, besides one a source


def source_key(c: Column) -> Column:
    """One spelling of a source: case, outer blanks and hyphen for underscore ignored; null for blank."""
    return F.nullif(F.replace(F.lower(strip(c)), F.lit("-"), F.lit("_")), F.lit(""))


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source. The vocabulary file is read here once and sent to the workers."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows.where("doc_id IS NOT NULL AND source IS NOT NULL")).mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2k + 1), no one above its cap; ties go to the earlier one.

    Same result as handing out seat by seat, found by bisecting for the quotient of the last seat,
    so that the number of seats does not matter. Weights of zero or less get nothing. If the caps
    leave too little room, all are filled.
    """
    caps = [seats] * len(weights) if caps is None else [max(0, c) for c in caps]
    caps = [c if w > 0 else 0 for c, w in zip(caps, weights)]
    seats = min(seats, sum(caps))
    if seats <= 0:
        return [0] * len(weights)

    def given(quotient: float) -> list[int]:
        """Seats whose quotient is above the given one."""
        return [min(c, max(0, math.ceil((w / quotient - 1) / 2))) if c else 0 for w, c in zip(weights, caps)]

    high, low = max(w for w, c in zip(weights, caps) if c), min(w / (2 * c + 1) for w, c in zip(weights, caps) if c) / 2
    for _ in range(200):
        middle = math.sqrt(high * low) if low > 0 else high / 2
        if middle in (high, low):
            break
        if sum(given(middle)) > seats:
            low = middle
        else:
            high = middle
    # the closed form may be off by one where quotients are equal in floating point: the last seats go one by one
    out = [max(0, g - 2) for g in given(high)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, out)) if g < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def plan(totals: dict[str, int], targets: Sequence[tuple[str, float, int]], *, block_tokens: int, total_tokens: int | None) -> list[tuple[str, float, int, int]]:
    """(source, share, max_repeats, tokens) for each target source.

    Without ``total_tokens`` the mix is the largest in which every source that has records reaches
    its share within its repeats. Sources without records get nothing, and no one gets their share.
    With it, what a source lacks for its share goes to the others. Blocks have ``block_tokens`` at
    most, and fewer where a quota would otherwise have less than LEAST_BLOCKS of them: so no source
    is rounded to nothing.
    """
    able = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and totals.get(s, 0) > 0]
    whole = sum(w for _, w, _ in able)
    if total_tokens is None:
        total_tokens = int(min((totals[s] * r / w for s, w, r in able), default=0) * whole)
    block = max(1, min([block_tokens, *[int(min(totals[s] * r, total_tokens * w / whole)) // LEAST_BLOCKS for s, w, r in able]]))
    caps = {s: totals[s] * r // block for s, _, r in able}
    seats = sainte_lague([w for _, w, _ in able], total_tokens // block, [caps[s] for s, _, _ in able])
    given = dict(zip((s for s, _, _ in able), seats))
    return [(s, w, r, given.get(s, 0) * block) for s, w, r in targets]


def shard_quotas(sizes: Sequence[int], repeats: int, tokens: int, *, block_tokens: int) -> list[int]:
    """Tokens of each shard, ``tokens`` together: apportioned in blocks, to the token where a shard is exhausted or the last block is not whole."""
    seats = sainte_lague(sizes, -(-tokens // block_tokens), [n * repeats // block_tokens + 1 for n in sizes])
    out = [min(seat * block_tokens, n * repeats) for seat, n in zip(seats, sizes)]
    left = tokens - sum(out)
    for i, n in enumerate(sizes):
        step = max(-out[i], min(left, n * repeats - out[i]))
        out[i] += step
        left -= step
    return out


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 7, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, max_groups: int = MAX_GROUPS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, times_used) and the report per target source.

    The report has source, target_share, n_docs, n_tokens (with repeats) and actual_share, also for
    sources that got nothing. Documents without source or of no listed source, and texts without
    tokens, are not selected. A source listed twice counts with its greater share. Records are whole,
    so each shard that is used in part misses its quota by half a record at most, or by more where
    its first record alone is larger. The driver works out quotas of sources (at most MAX_SOURCES, else
    ValueError) and of at most ``max_groups`` groups of shards; those of the shards are worked out group
    by group on the executors. Token counts are computed once and kept as a table.
    """
    spark = docs.sparkSession
    listed = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").cast("bigint").alias("repeats")).where("source IS NOT NULL AND share IS NOT NULL AND repeats IS NOT NULL")
    listed = listed.groupBy("source").agg(F.max_by("share", "share").alias("share"), F.max_by("repeats", "share").alias("repeats"))
    wanted = [(r.source, float(r.share), int(r.repeats)) for r in listed.orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    named = spark.createDataFrame(wanted, "source string, share double, repeats bigint")
    counts = materialize(token_counts(docs, vocabulary=vocabulary).where("n_tokens > 0"), "tokens")
    counts = counts.join(F.broadcast(named.select("source")), "source", "left_semi")
    totals = {r.source: int(r.n) for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    quotas = plan(totals, wanted, block_tokens=block_tokens, total_tokens=total_tokens)

    # shards cut every source into parts of about shard_tokens, so that none is ordered as a whole; groups of shards keep what the driver sees bounded
    whole_tokens = sum(totals.values()) or 1
    cut = []
    for s, _, r, _ in quotas:
        shards = max(1, -(-totals.get(s, 0) // shard_tokens))
        cut.append((s, r, shards, max(1, min(shards, max_groups * totals.get(s, 0) // whole_tokens))))
    shards = spark.createDataFrame(cut, "source string, repeats bigint, shards bigint, groups bigint")
    rows = counts.join(F.broadcast(shards), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))).withColumn("part", F.pmod("shard", "groups"))
    sizes = rows.groupBy("source", "repeats", "part", "shard").agg(F.sum("n_tokens").alias("shard_total"))
    per_group: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).collect():
        per_group.setdefault(r.source, []).append((r.part, int(r.n)))
    filled = []
    for s, _, r, q in quotas:
        parts = sorted(per_group.get(s, []))
        filled += [(s, part, tokens) for (part, _), tokens in zip(parts, shard_quotas([n for _, n in parts], r, q, block_tokens=block_tokens))]
    of_groups = spark.createDataFrame(filled, "source string, part bigint, tokens bigint")

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        quota = shard_quotas(pdf["shard_total"].tolist(), int(pdf["repeats"].iloc[0]), int(pdf["tokens"].iloc[0]), block_tokens=block_tokens)
        return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "quota_tokens": quota, "shard_total": pdf["shard_total"]})

    share = sizes.join(F.broadcast(of_groups), ["source", "part"]).groupBy("source", "part").applyInPandas(apportion, "source string, shard bigint, quota_tokens bigint, shard_total bigint")
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    rows = rows.select("doc_id", "source", "n_tokens", "repeats", "shard").join(share, ["source", "shard"])
    rows = rows.withColumn("before", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    # whole rounds over the shard, then the tokens that are left, to the nearest end of a record; a quota gets one record at least
    rounds = F.floor(F.col("quota_tokens") / F.col("shard_total"))
    rest = F.col("quota_tokens") - rounds * F.col("shard_total")
    near = (F.col("before") + F.col("n_tokens") - rest <= rest - F.col("before")) | ((F.col("before") == 0) & (rounds == 0) & (rest > 0))
    used = F.least(rounds + F.when(near, 1).otherwise(0), F.col("repeats")).cast("bigint")
    chosen = rows.withColumn("times_used", used).where("times_used > 0").select("doc_id", "source", "n_tokens", "times_used")

    got = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("times_used")).alias("n"))
    report = named.join(got, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n", F.lit(0)).alias("n_tokens")
    )
    whole = Window.partitionBy(F.lit(0))  # one row per target source
    return chosen, report.withColumn("actual_share", F.coalesce(F.round(F.try_divide("n_tokens", F.sum("n_tokens").over(whole)), 6), F.lit(0.0)))
