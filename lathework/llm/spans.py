"""Long passages that stand unchanged in more than one text, found through difference-cover anchors.

For a period P with a difference cover D, any two positions have a common shift below P that brings
both onto the cover (modulo P). A passage of min_length characters shared by two texts, wherever it
begins in either, therefore holds one window of min_length - P + 1 characters that starts on the
cover in both. Only windows on the cover are hashed and exchanged: the anchors. Around anchors that
another text has too, the match is extended: every start of a min_length window that holds such an
anchor is hashed in full and exchanged the same way; what another text has is shared.

No pairs of texts are ever formed. Texts are spread over blocks by id; a block sends each hash once
however many of its texts hold it, and gets back one bit per hash. With many blocks, groups of them
pool their hashes first, so that a hash that every block holds is sent on once a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

BLOCK_CHARS = 1_000_000
BUCKET_HASHES = 500_000
BLOCKS_PER_TASK, BUCKETS_PER_TASK = 8, 2
HEAVY_SHARE = 1000
POOLED_BLOCKS = 4096  # with more blocks than this, groups of blocks pool their hashes first

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xD1B54A32D192ED03
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
# fixed values: primitive polynomials over GF(2) by degree
PRIMITIVE = {3: 0b1011, 6: 0b1000011, 9: 0b1000010001, 12: 0b1000001010011, 15: 0b1000000000000011}

Cover = tuple[int, tuple[int, ...]]


@lru_cache(maxsize=8)
def difference_cover(power: int) -> Cover:
    """(P, D): Singer's difference set of order q = 2**power, with P = q*q + q + 1 and q + 1 members.

    D holds the exponents i below P for which the trace of g**i from GF(q**3) to GF(q) is 0. Every
    difference other than 0 occurs exactly once, so no cover of that period is smaller.
    """
    q, degree = 1 << power, 3 * power
    size, field, x = (1 << degree) - 1, [], 1
    for _ in range(size):
        field.append(x)
        x <<= 1
        if x >> degree:
            x ^= PRIMITIVE[degree]
    period = q * q + q + 1
    return period, tuple(i for i in range(period) if field[i] ^ field[i * q % size] ^ field[i * q * q % size] == 0)


def cover_for(min_length: int) -> Cover:
    """The largest cover that leaves anchors of at least a quarter of min_length."""
    best = (1, (0,))
    for power in range(1, 6):
        period, _ = best_next = difference_cover(power)
        if min_length - period + 1 < max(1, min_length // 4):
            break
        best = best_next
    return best


_kept_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int, inverse: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, kept for the next block of the task."""
    if base not in _kept_powers or len(_kept_powers[base][0]) < n:
        size = 1 << max(1, n - 1).bit_length()
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _kept_powers[base] = np.cumprod(up), np.cumprod(down)
    up, down = _kept_powers[base]
    return up[:n], down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Block:
    """The texts of one block as one array of code points with running hashes."""

    def __init__(self, ids: list[int], texts: list[str], min_length: int, cover: Cover):
        kept = [(i, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for i, t in zip(ids, texts) if len(t) >= min_length]
        self.min_length, self.cover = min_length, cover
        self.rows = [i for i, _ in kept]
        self.lengths = np.array([len(c) for _, c in kept], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        total = int(self.lengths.sum())
        self.down = np.ones(1, np.uint64)
        self.sums = np.zeros(1, np.uint64)
        names: dict[int, int] = {}
        self.doc = np.array([names.setdefault(i, len(names)) for i in self.rows], np.int64)
        if total:
            x = np.concatenate([c for _, c in kept]).astype(np.uint64)
            self.letters = x = (x + np.uint64(1)) * np.uint64(_BASE)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            up, self.down = _powers(total, _BASE, _INVERSE)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up)])

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        return _mixed((self.sums[at + width] - self.sums[at]) * self.down[at])

    def checks(self, at: np.ndarray, width: int) -> np.ndarray:
        """16 more bits of a hash of its own, with other values of the letters and another base."""
        if not len(at):
            return np.empty(0, np.uint16)
        x = (self.letters ^ (self.letters >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        up, down = _powers(len(x), _BASE2, _INVERSE2)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up)])
        return (_mixed((sums[at + width] - sums[at]) * down[at]) >> np.uint64(48)).astype(np.uint16)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(position in the block, row) of every anchor, and the anchors' width."""
        period, cover = self.cover
        width = self.min_length - period + 1
        cover = np.array(cover, np.int64)
        at, row = [], []
        for r, (s, n) in enumerate(zip(self.starts, self.lengths)):
            here = (np.arange(0, n - width + 1, period)[:, None] + cover).ravel()
            here = here[here <= n - width]
            at.append(s + here)
            row.append(np.full(len(here), r))
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64), width
        return np.concatenate(at), np.concatenate(row), width

    def candidates(self, at: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, row) of all starts of min_length windows that hold one of the given anchors."""
        first, last = self.starts[row], self.starts[row] + self.lengths[row] - self.min_length
        low, high = np.maximum(first, at + width - self.min_length), np.minimum(at, last)
        edge = np.zeros(len(self.sums) + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge) > 0)
        return starts, np.searchsorted(self.starts, starts, "right") - 1

    def spans(self, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) of the longest runs of positions under windows that begin at ``starts`` (ascending)."""
        if not len(starts):
            return
        row = np.searchsorted(self.starts, starts, "right") - 1
        cut = np.flatnonzero((np.diff(starts) > self.min_length) | (np.diff(row) > 0)) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1):
            r = row[a]
            yield self.rows[r], int(starts[a] - self.starts[r]), int(starts[b] - self.starts[r]) + self.min_length


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as the first one and the steps between them, each step in as many bits as the widest needs."""
    steps = np.diff(values)
    width = max(1, int(steps.max()).bit_length()) if len(steps) else 1
    bits = np.unpackbits(steps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]
    return bytes([width]) + values[:1].astype("<u8").tobytes() + np.packbits(bits).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n numbers behind packed()."""
    width, bits = raw[0], np.zeros((n - 1, 64), np.uint8)
    bits[:, 64 - width :] = np.unpackbits(np.frombuffer(raw, np.uint8, offset=9), count=(n - 1) * width).reshape(n - 1, width)
    steps = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1).astype(np.uint64), steps]), dtype=np.uint64)


class Request:
    """A block's distinct hashes in order, each with whether two of its texts hold it. ``checks``: further bits that must agree, too."""

    def __init__(self, values: np.ndarray, docs: np.ndarray, bits: int, checks: np.ndarray | None = None):
        order = np.argsort(values, kind="stable") if checks is None else np.lexsort((checks, values))
        v, d = values[order] >> np.uint64(64 - bits), docs[order]
        c = np.empty(0, np.uint16) if checks is None else checks[order]
        differs = v[1:] != v[:-1] if checks is None else (v[1:] != v[:-1]) | (c[1:] != c[:-1])
        new = np.concatenate([[True], differs]) if len(v) else np.empty(0, bool)
        cut = np.flatnonzero(new)
        self.bits, self.values, self.checks = bits, v[cut], c[cut] if len(c) else c
        self.several = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut) if len(cut) else np.empty(0, bool)
        self.place = np.empty(len(v), np.int64)
        self.place[order] = np.cumsum(new) - 1

    def slices(self, buckets: int) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) over the ordered values; the bucket is the value's place in their whole range."""
        b = ((self.values >> np.uint64(self.bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
        if len(b):
            cut = np.flatnonzero(np.diff(b)) + 1
            for a, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])):
                yield int(b[a]), int(a), int(e)

    def sent(self, buckets: int) -> list[tuple[int, int, bytes, bytes, bytes]]:
        """(bucket, number of hashes, hashes, checks, flags) for each bucket that has any."""
        return [(b, e - a, packed(self.values[a:e]), self.checks[a:e].astype("<u2").tobytes(), np.packbits(self.several[a:e]).tobytes()) for b, a, e in self.slices(buckets)]

    def answered(self, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
        """For each of the values the request was made from: does another text hold it too?"""
        shared = self.several.copy()
        for b, a, e in self.slices(buckets):
            if b in answers:
                shared[a:e] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=e - a).astype(bool)
        return shared[self.place]


class Pool:
    """Hashes of several blocks in one bucket: the distinct ones, and which of them more than one text holds."""

    def __init__(self, pdf: pd.DataFrame):
        values = [unpacked(raw, n) for n, raw in zip(pdf["n"], pdf["hashes"])]
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for n, f in zip(pdf["n"], pdf["several"])])
        v, c = np.concatenate(values), np.concatenate([np.frombuffer(x, "<u2") for x in pdf["checks"]])
        self.ends = np.cumsum([len(x) for x in values])
        self.order = np.lexsort((c, v)) if len(c) else np.argsort(v, kind="stable")
        v = v[self.order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        if len(c):
            c = c[self.order]
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        self.place = np.cumsum(new) - 1
        self.distinct, self.checks = v[cut], c[cut] if len(c) else c
        self.shared = np.diff(np.concatenate([cut, [len(v)]])) > 1
        self.shared |= np.logical_or.reduceat(several[self.order], cut)

    def bits(self, shared: np.ndarray) -> list[bytes]:
        """One bit per hash in the order sent, block by block."""
        hit = np.empty(len(self.order), bool)
        hit[self.order] = shared[self.place]
        return [np.packbits(hit[a:e]).tobytes() for a, e in zip(np.concatenate([[0], self.ends]), self.ends)]


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: which of each block's hashes some other block has, as one bit per hash in the order sent."""
    pool = Pool(pdf)
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": pool.bits(pool.shared)})


def _pooled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The hashes of a group of blocks as if it were one block."""
    pool, first = Pool(pdf), pdf.iloc[0]
    row = {"block": first["team"], "bucket": first["bucket"], "n": len(pool.distinct), "hashes": packed(pool.distinct), "checks": pool.checks.astype("<u2").tobytes(), "several": np.packbits(pool.shared).tobytes()}
    return pd.DataFrame([row])


def _handed_down(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """What a group of blocks was told, for each of its blocks."""
    if not len(pdf):
        return pd.DataFrame({"block": [], "bucket": [], "bits": []})
    pool = Pool(pdf)
    shared = pool.shared.copy()
    for bits in told["bits"]:
        shared |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(shared)).astype(bool)
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": pool.bits(shared)})


def shared_spans(docs: DataFrame, *, min_length: int = 400, block_chars: int = BLOCK_CHARS, pooled_blocks: int = POOLED_BLOCKS) -> DataFrame:
    """(doc_id, span_start, span_end): longest runs of positions that lie in a passage of at least ``min_length`` code points which occurs unchanged in another document.

    Null, empty and shorter texts share nothing; a passage that only repeats inside one document is
    not shared; rows with the same doc_id are one document. Texts that are wholly equal are told
    apart by length and 128 bits of hash: all but the one with the least id are left out of the
    exchange, and each is one span from 0 to its end. This holds for documents of one text only;
    those of several texts take part with all of them. Anchors are only a filter, so they are sent
    with as few bits as their number needs; full windows are compared by 80 bits of two hashes.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= min_length)
    ids = materialize(texts.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("n")), "texts")
    count, chars = ids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-int(chars) // block_chars))
    block_of = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(blocks)).cast("int")

    same = ["h1", "h2", "n"]
    several = ids.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("b")).where("a <> b").select("doc_id")
    single = ids.join(several, "doc_id", "left_anti")
    groups = materialize(single.groupBy(*same).agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.count("*").alias("size")).where("keep <> last"), "equal-texts")
    is_heavy = F.col("size") > max(1, count // HEAVY_SHARE)
    heavy, light = groups.where(is_heavy).select(*same, "keep"), groups.where(~is_heavy).select(*same, "keep")
    equal = single.join(F.broadcast(heavy), same).unionByName(single.join(F.broadcast(heavy), same, "left_anti").join(light, same))
    equal = materialize(equal.select("doc_id", "keep", "n"), "copies")
    whole = equal.select("doc_id", F.lit(0).cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_end")).distinct()
    # what a block must know of its texts: -1 for copies that stay out, 1 for kept ones whose span is already known
    known = equal.select(block_of.alias("block"), F.lit(0).alias("step"), F.lit(0).alias("bucket"), "doc_id", (F.col("doc_id") != F.col("keep")).alias("out"), F.lit(None).cast("binary").alias("bits"))

    period, cover = cover_for(min_length)
    anchor_bits = min(64, max(40, (int(chars) * len(cover) // period).bit_length() + 12))
    anchor_buckets = max(1, int(chars) * len(cover) // period // BUCKET_HASHES)
    window_buckets = max(1, int(chars) // 4 // BUCKET_HASHES)

    # as many partitions as the data need, whatever the session's default, so that a task holds a few blocks
    by_size = lambda n, each: max(shuffle_partitions(docs.sparkSession), -(-n // each))
    parts = by_size(blocks, BLOCKS_PER_TASK)
    by_block = texts.withColumn("block", block_of).repartition(parts, "block").groupBy("block")

    def opened(pdf: pd.DataFrame, told: pd.DataFrame) -> tuple[Block, set[int], dict[int, dict[int, bytes]]]:
        out = set(told.loc[(told["step"] == 0) & told["out"].astype(bool), "doc_id"]) if len(told) else set()
        done = set(told.loc[(told["step"] == 0) & ~told["out"].astype(bool), "doc_id"]) if len(told) else set()
        answers: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
        for step, bucket, bits in zip(told["step"], told["bucket"], told["bits"]):
            if step:
                answers[step][bucket] = bits
        rows = [(i, t) for i, t in zip(pdf["doc_id"], pdf["text"]) if i not in out]
        return Block([i for i, _ in rows], [t for _, t in rows], min_length, (period, cover)), done, answers

    def anchor_request(block: Block) -> tuple[Request, np.ndarray, np.ndarray, int]:
        at, row, width = block.anchors()
        return Request(block.hashes(at, width), block.doc[row], anchor_bits), at, row, width

    def window_request(block: Block, answers: dict[int, bytes]) -> tuple[Request, np.ndarray]:
        request, at, row, width = anchor_request(block)
        hit = request.answered(anchor_buckets, answers)
        starts, rows = block.candidates(at[hit], row[hit], width)
        return Request(block.hashes(starts, min_length), block.doc[rows], 64, block.checks(starts, min_length)), starts

    def ask(pdf: pd.DataFrame, request: Request, buckets: int) -> pd.DataFrame:
        sent = request.sent(buckets)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]] * len(sent), "bucket": [b for b, *_ in sent], "n": [n for _, n, *_ in sent], "hashes": [h for *_, h, _, _ in sent], "checks": [c for *_, c, _ in sent], "several": [f for *_, f in sent]})

    def ask_anchors(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"block": [], "bucket": [], "n": [], "hashes": [], "checks": [], "several": []})
        return ask(pdf, anchor_request(opened(pdf, told)[0])[0], anchor_buckets)

    def ask_windows(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"block": [], "bucket": [], "n": [], "hashes": [], "checks": [], "several": []})
        block, _, answers = opened(pdf, told)
        return ask(pdf, window_request(block, answers[1])[0], window_buckets)

    def read_spans(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"doc_id": [], "span_start": [], "span_end": []})
        block, done, answers = opened(pdf, told)
        request, starts = window_request(block, answers[1])
        found = [s for s in block.spans(starts[request.answered(window_buckets, answers[2])]) if s[0] not in done]
        return pd.DataFrame(found, columns=["doc_id", "span_start", "span_end"])

    asked = "block int, bucket int, n int, hashes binary, checks binary, several binary"
    teams = max(1, round(blocks**0.5))

    def answers(requests: DataFrame, step: int) -> DataFrame:
        buckets = by_size(anchor_buckets if step == 1 else window_buckets, BUCKETS_PER_TASK)
        by_bucket = lambda df, *more: df.repartition(buckets, "bucket", *more).groupBy("bucket", *more)
        if blocks <= pooled_blocks:
            said = by_bucket(requests).applyInPandas(_answer, "block int, bucket int, bits binary")
        else:
            teamed = by_bucket(requests.withColumn("team", F.pmod("block", F.lit(teams))), "team")
            said = by_bucket(teamed.applyInPandas(_pooled, asked)).applyInPandas(_answer, "block int, bucket int, bits binary")
            said = teamed.cogroup(by_bucket(said.withColumnRenamed("block", "team"), "team")).applyInPandas(_handed_down, "block int, bucket int, bits binary")
        return said.select("block", F.lit(step).alias("step"), "bucket", F.lit(None).cast("bigint").alias("doc_id"), F.lit(False).alias("out"), "bits")

    # one job: the shuffles of the texts and of the hashes are made once and read again by every later step
    told = known
    for step, request in ((1, ask_anchors), (2, ask_windows)):
        asks = by_block.cogroup(told.repartition(parts, "block").groupBy("block")).applyInPandas(request, asked)
        told = told.unionByName(answers(asks, step))
    spans = by_block.cogroup(told.repartition(parts, "block").groupBy("block")).applyInPandas(read_spans, "doc_id bigint, span_start bigint, span_end bigint")
    return whole.unionByName(spans.distinct())


def shared_share(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document with text."""
    per = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    joined = sizes.join(per, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.withColumn("shared_share", F.coalesce(F.round(F.try_divide("shared_chars", "n_chars"), 6), F.lit(0.0)))
