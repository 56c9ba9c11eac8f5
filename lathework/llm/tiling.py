"""Passages of held-out test items inside documents, found by greedy string tiling.

Seeds are word n-grams shared by an item and a document (running Karp-Rabin hashes, verified word by
word). From the seeds the longest match not yet marked is taken again and again, as tiles that do
not overlap; the part of the item that the tiles cover is its leak, in whatever order they stand.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

MIN_WORDS = 13
MAX_ITEM_BYTES = 16 << 20  # of item texts that are broadcast; more of them meet the documents by a join on seeds

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

LEAKS = "doc_id bigint, item_id bigint, longest bigint, tiles bigint, covered bigint, item_words bigint"


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case. A capital I with dot counts as i (its lower form would split the word)."""
    return _WORD.findall(text.replace("İ", "i").lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + x[j : j + n]
    return h


class Items:
    """Test items with their seeds: vocabulary, sorted seed hashes, and where each seed stands."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.vocabulary = k, {}
        self.item_ids, self.ids = [], []
        for item_id, text in items:
            w = words(text)
            if len(w) < k:
                continue
            self.item_ids.append(item_id)
            self.ids.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64))
        hashes = [rolling(x, k) for x in self.ids]
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.item = np.concatenate([np.full(len(h), i) for i, h in enumerate(hashes)]) if hashes else np.empty(0, np.int64)
        self.at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]

    def state(self) -> dict:
        """The parts as plain values: what is broadcast needs no class on the workers."""
        return dict(vars(self))

    @classmethod
    def of(cls, state: dict) -> Items:
        items = cls.__new__(cls)
        vars(items).update(state)
        return items

    def seeds(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, positions in the document, positions in the item) of all shared seeds, item by item."""
        known = doc >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= self.k
        where, hashes = [], []
        for s, e in zip(starts[long], stops[long]):
            h = rolling(doc[s:e], self.k)
            where.append(np.arange(s, s + len(h)))
            hashes.append(h)
        if not hashes:
            return
        h, at = np.concatenate(hashes), np.concatenate(where)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        if not n.any():
            return
        row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, item, there = np.repeat(at, n), self.item[row], self.at[row]
        order = np.argsort(item, kind="stable")
        at, item, there = at[order], item[order], there[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        for a, b, i in zip(np.split(at, cuts), np.split(there, cuts), item[np.concatenate([[0], cuts])]):
            yield int(i), a, b


def matches(at: np.ndarray, there: np.ndarray, doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, document position, item position) from seeds: runs of seeds on one diagonal, verified."""
    order = np.lexsort((at, at - there))
    at, there = at[order], there[order]
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(at - there) != 0)) + 1
    out = []
    for a, b in zip(np.split(at, cuts), np.split(there, cuts)):
        d, i, n = int(a[0]), int(b[0]), len(a) + k - 1
        same = doc[d : d + n] == item[i : i + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        out += [(int(e - s), d + int(s), i + int(s)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= k]
    return out


def tile(found: list[tuple[int, int, int]], doc_words: int, item_words: int, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest match with its unmarked part, again and again, until none of k words is left."""
    in_doc, in_item = np.zeros(doc_words, bool), np.zeros(item_words, bool)
    heap = [(-n, d, i) for n, d, i in found]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[d : d + n] | in_item[i : i + n])
        if free.all():
            in_doc[d : d + n], in_item[i : i + n] = True, True
            tiles.append((n, d, i))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= k:
                heapq.heappush(heap, (-int(e - s), d + int(s), i + int(s)))
    return tiles


def leaks(docs: DataFrame, items: DataFrame, *, min_words: int = MIN_WORDS, min_coverage: float = 0.0, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, longest, tiles, covered, item_words) of documents (doc_id, text) that hold passages of items (item_id, item_text).

    A passage is ``min_words`` or more consecutive words of the item, in its order and with no other
    word between. ``covered`` counts the item's words under tiles; pairs whose covered share is
    under ``min_coverage`` are left out. Null and empty texts hold nothing, items of fewer words
    leak nowhere, a repeated row gives its pairs again. Whole texts are searched, in one pass over the
    documents if the items' texts have at most ``max_item_bytes`` and are broadcast. More items are cut
    into seeds that meet the documents' seeds in a join; only pairs with a common seed are tiled.
    """
    spark = docs.sparkSession
    given = items.where("item_id IS NOT NULL AND item_text IS NOT NULL").select("item_id", "item_text")
    size = given.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    if size <= max_item_bytes:
        shared = spark.sparkContext.broadcast(Items([(r.item_id, r.item_text) for r in given.collect()], min_words).state())
        return spread(texts).mapInPandas(_search(shared, min_words, min_coverage), LEAKS)
    return _joined(spread(texts), given, min_words, min_coverage)


LEAK_COLUMNS = [c.split()[0] for c in LEAKS.split(", ")]


def _tiled(doc_id: int, doc: np.ndarray, items: Items, min_coverage: float) -> Iterator[tuple]:
    """Rows of LEAKS of a document given as numbers of the items' vocabulary."""
    for i, at, there in items.seeds(doc):
        item = items.ids[i]
        tiles = tile(matches(at, there, doc, item, items.k), len(doc), len(item), items.k)
        covered = sum(n for n, _, _ in tiles)
        if tiles and covered >= min_coverage * len(item):
            yield doc_id, items.item_ids[i], max(n for n, _, _ in tiles), len(tiles), covered, len(item)


def _search(shared, k: int, min_coverage: float):  # noqa: ANN001, ANN202
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items.of(shared.value)
        known = items.vocabulary
        for pdf in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                w = words(text)
                rows += _tiled(doc_id, np.fromiter((known.get(x, -1) for x in w), np.int64, len(w)), items, min_coverage)
            yield pd.DataFrame(rows, columns=LEAK_COLUMNS)

    return search


def word_number(word: str) -> int:
    """A number of a word that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def _joined(texts: DataFrame, items: DataFrame, k: int, min_coverage: float) -> DataFrame:
    """Seeds of both sides, each once a text, meet by a join; then each row that has candidates is tiled with them, one item at a time."""

    def seeds_of(key: str, text: str):  # noqa: ANN202
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            numbers: dict[str, int] = {}
            for pdf in batches:
                for i, t in zip(pdf[key], pdf[text]):
                    ids = np.fromiter((numbers.setdefault(x, word_number(x)) for x in words(t)), np.int64)
                    seeds = np.unique(rolling(ids, k)).view(np.int64)
                    yield pd.DataFrame({key: np.full(len(seeds), i), "seed": seeds})
                if len(numbers) > 1_000_000:
                    numbers.clear()

        return cut

    of_items = items.mapInPandas(seeds_of("item_id", "item_text"), "item_id bigint, seed bigint").distinct()
    of_docs = texts.mapInPandas(seeds_of("doc_id", "text"), "doc_id bigint, seed bigint").distinct()
    pairs = of_docs.join(of_items, "seed").select("doc_id", "item_id").distinct()

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc_id, text, item_id, item_text in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["item_text"]):
                one, w = Items([(item_id, item_text)], k), words(text)
                rows += _tiled(doc_id, np.fromiter((one.vocabulary.get(x, -1) for x in w), np.int64, len(w)), one, min_coverage)
            yield pd.DataFrame(rows, columns=LEAK_COLUMNS)

    met = pairs.join(items, "item_id").join(texts, "doc_id").select("doc_id", "text", "item_id", "item_text")
    return met.mapInPandas(tiles, LEAKS)
