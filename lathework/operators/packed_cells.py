"""Several values packed in one cell, split by dictionary-guided segmentation.

A cell is first cut at every separator, wherever it stands. A multi-pattern automaton finds the known
whole values in it, and dynamic programming picks the best cover of the cell by known values and single
pieces: a known value keeps the separators it holds. The dictionary of known values is learned from all
cells: the values that hold a separator under quotes or brackets, in cells where all of these close,
with the number of times each stands there. A caller may add values of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# fixed values: what separates values, with the full-width forms
SEPARATORS = ";；,，、､|｜/／\n\r"
BLANK_SEPARATORS = " \t　\xa0"
# fixed values: quotes and round brackets that protect what is in them
QUOTES = {'"': '"', "＂": "＂", "“": "”", "„": "”", "「": "」", "『": "』"}
BRACKETS = {"(": ")", "（": "）"}
CLOSERS = set(")）")

MAX_DICTIONARY_BYTES = 16 << 20  # of a dictionary that is broadcast; a larger one meets the cells by a join

Span = tuple[int, int, int]  # start, end and count of a known value in a cell


def unquoted(text: str) -> str:
    """``text`` without outer blanks and enclosing quotes; a doubled quote inside becomes one."""
    text = text.strip()
    if len(text) > 1 and text[0] in QUOTES and _close_quote(text, 0) == len(text) - 1:
        q = QUOTES[text[0]]
        text = (text[1:-1].replace(q + q, q) if q == text[0] else text[1:-1]).strip()
    return text


def _close_quote(text: str, at: int) -> int:
    """Where the quote opened at ``at`` closes (doubled quotes are content), or -1."""
    q = QUOTES[text[at]]
    i = text.find(q, at + 1)
    while i >= 0 and q == text[at] and text[i + 1 : i + 2] == q:
        i = text.find(q, i + 2)
    return i


def _json_list(text: str) -> list[str] | None:
    t = text.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    try:
        values = json.loads(t)
    except (ValueError, RecursionError):
        return None
    return ["" if v is None else v.strip() if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values]


def protected_values(text: str, separators: str) -> list[str]:
    """Values of a cell that hold separators under quotes or brackets; none if a quote or bracket stays open."""
    values, start, depth, i, n = [], 0, [], 0, len(text)
    while i < n:
        c = text[i]
        if c in QUOTES:
            i = _close_quote(text, i)
            if i < 0:
                return []
        elif c in BRACKETS:
            depth.append(c)
        elif c in CLOSERS and depth:
            depth.pop()
        elif c in separators and not depth:
            values.append(text[start:i])
            start = i + 1
        i += 1
    if depth:
        return []
    return [v for v in (v.strip() for v in [*values, text[start:]]) if any(c in separators for c in v)]


def torn(piece: str) -> bool:
    """Does the piece hold a quote or bracket without its partner?"""
    depth, i = 0, 0
    while i < len(piece):
        c = piece[i]
        if c in QUOTES:
            i = _close_quote(piece, i)
            if i < 0:
                return True
        elif c in BRACKETS:
            depth += 1
        elif c in CLOSERS:
            depth -= 1
            if depth < 0:
                return True
        i += 1
    return depth > 0


def _cuts(text: str, separators: str) -> list[int]:
    return [i for i, c in enumerate(text) if c in separators]


def segment(text: str, separators: str, known: Iterable[Span] = ()) -> list[str]:
    """The values of one cell. ``known``: (start, end, count) of known whole values found in it.

    Pieces run from separator to separator. A known value that begins where a piece begins and ends
    where one ends covers all pieces between. Of all covers the best has the fewest torn pieces, then
    the fewest values, then the more frequent known values; of equal ones the first found.
    """
    cuts = _cuts(text, separators)
    starts, ends = [0, *[c + 1 for c in cuts]], [*cuts, len(text)]
    # a known value may have blanks around it: where each piece's text begins and ends
    begin, stop = {}, {}
    for k, (s, e) in enumerate(zip(starts, ends)):
        piece = text[s:e]
        begin[s + len(piece) - len(piece.lstrip())] = begin[s] = k
        stop[e - len(piece) + len(piece.rstrip())] = stop[e] = k
    edges: dict[int, list[tuple[int, int]]] = {}
    for s, e, n in known:
        if s in begin and e in stop and stop[e] > begin[s]:
            edges.setdefault(begin[s], []).append((stop[e], n))
    if not edges:
        return [v for v in (unquoted(text[s:e]) for s, e in zip(starts, ends)) if v]
    best: list[tuple[int, int, int] | None] = [(0, 0, 0), *[None] * len(starts)]
    back = [0] * (len(starts) + 1)
    for k, (s, e) in enumerate(zip(starts, ends)):
        here = best[k]
        for last, t, n in [*[(j, 0, n) for j, n in edges.get(k, ())], (k, int(torn(text[s:e])), 0)]:
            cost = (here[0] + t, here[1] + 1, here[2] - n)
            if best[last + 1] is None or cost < best[last + 1]:
                best[last + 1], back[last + 1] = cost, k
    items, k = [], len(starts)
    while k:
        items.append(text[starts[back[k]] : ends[k - 1]])
        k = back[k]
    return [v for v in map(unquoted, reversed(items)) if v]


class Automaton:
    """Known whole values with their counts, found in a text in one pass."""

    def __init__(self, values: Mapping[str, int] | Iterable[str]):
        counts = values if isinstance(values, Mapping) else dict.fromkeys(values, 1)
        self._found = ahocorasick.Automaton()
        for v, n in counts.items():
            if v:
                self._found.add_word(v, (len(v), n))
        if len(self._found):
            self._found.make_automaton()

    def spans(self, text: str) -> list[Span]:
        if not len(self._found):
            return []
        return [(end + 1 - size, end + 1, n) for end, (size, n) in self._found.iter(text)]


def split_cell(text: str | None, separators: str, automaton: Automaton | None = None) -> list[str]:
    """The non-empty values of a cell in their order; [] for null or blank. A JSON list gives its elements."""
    if text is None or not text.strip():
        return []
    values = _json_list(text)
    if values is not None:
        return [v for v in values if v]
    return segment(text, separators, automaton.spans(text) if automaton else ())


def _separators_of(kind: str) -> str:
    return SEPARATORS + BLANK_SEPARATORS if kind == "ids" else SEPARATORS


def learn_dictionary(cells: DataFrame) -> DataFrame:
    """(kind, value, n): values with protected separators and how often they stand in cells in which every quote and bracket closes."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple[str, str], int] = {}
            for text, kind in zip(pdf["cell"], pdf["kind"]):
                if _json_list(text) is None:
                    for v in protected_values(text, _separators_of(kind)):
                        found[kind, v] = found.get((kind, v), 0) + 1
            yield pd.DataFrame([(k, v, n) for (k, v), n in sorted(found.items())], columns=["kind", "value", "n"])

    held = F.col("cell").rlike("[" + "".join(["\\" + c for c in '"()']) + "＂“„「『（）]")
    return cells.where(held).select("cell", "kind").mapInPandas(learn, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def start_key(pieces: Sequence[str]) -> int:
    """Hash of a value's first two pieces, without blanks outside: what a value and the place where it may stand share."""
    return int.from_bytes(hashlib.blake2b("\0".join([pieces[0].lstrip(), pieces[1].strip()]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _pieces(text: str, separators: str) -> list[str]:
    cuts = _cuts(text, separators)
    return [text[s:e] for s, e in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)])]


def _covered(cells: DataFrame, dictionary: DataFrame, told: Callable[[str, str, Automaton], list[tuple]], columns: str, max_dictionary_bytes: int) -> DataFrame:
    """Rows (row_id, field_name, *columns): what ``told`` (kind, cell, automaton) says of each cell.

    A dictionary within the bound is broadcast and becomes one automaton a task. A larger one is joined
    to the cells by the hash of the two pieces that a value begins with, and each batch of cells has an
    automaton of the values that may stand in it.
    """
    schema = f"row_id bigint, field_name string, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    size = dictionary.agg(F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0))).first()[0]
    if size <= max_dictionary_bytes:
        listed: dict[str, dict[str, int]] = {}
        for r in dictionary.collect():
            listed.setdefault(r.kind, {})[r.value] = r.n
        shared = cells.sparkSession.sparkContext.broadcast(listed)

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automata = {k: Automaton(v) for k, v in shared.value.items()}
            for pdf in batches:
                out = [(r, f, *t) for r, f, k, c in zip(*(pdf[x] for x in ("row_id", "field_name", "kind", "cell"))) for t in told(k, c, automata.get(k))]
                yield pd.DataFrame(out, columns=names)

        return cells.mapInPandas(whole, schema)

    def first_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[start_key([*_pieces(v, _separators_of(k)), ""]) for k, v in zip(pdf["kind"], pdf["value"])])

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [_pieces(c, _separators_of(k)) for k, c in zip(pdf["kind"], pdf["cell"])]
            yield pdf.assign(keys=[list({start_key(p[i : i + 2]) for i in range(len(p) - 1)}) for p in parts])

    known = dictionary.select("kind", "value", "n").mapInPandas(first_key, "kind string, value string, n bigint, key bigint")
    places = cells.mapInPandas(keyed, "row_id bigint, field_name string, kind string, cell string, keys array<bigint>")
    met = places.select("row_id", "field_name", "kind", F.explode("keys").alias("key")).join(known, ["kind", "key"])
    may = met.groupBy("row_id", "field_name", "kind").agg(F.collect_set(F.struct("value", "n")).alias("may"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            here: dict[str, dict[str, int]] = {}
            for k, values in zip(pdf["kind"], pdf["may"]):
                here.setdefault(k, {}).update({v["value"]: v["n"] for v in (values if values is not None else ())})
            automata = {k: Automaton(v) for k, v in here.items()}
            out = [(r, f, *t) for r, f, k, c in zip(*(pdf[x] for x in ("row_id", "field_name", "kind", "cell"))) for t in told(k, c, automata[k])]
            yield pd.DataFrame(out, columns=names)

    return cells.join(may, ["row_id", "field_name", "kind"], "left").select("row_id", "field_name", "kind", "cell", "may").mapInPandas(cover, schema)


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where("cell IS NOT NULL AND trim(cell) <> ''").select("row_id", "field_name", "kind", "cell")


def _known(cells: DataFrame, known: DataFrame | None) -> DataFrame:
    learned = learn_dictionary(cells)
    if known is not None:
        learned = learned.unionByName(known.select("kind", "value", F.lit(1).cast("bigint").alias("n")).where("value <> ''")).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    return materialize(learned, "known-values")


def split_values(cells: DataFrame, *, known: DataFrame | None = None, max_dictionary_bytes: int = MAX_DICTIONARY_BYTES) -> DataFrame:
    """One row per value of ``cells`` (row_id, field_name, kind, cell): (row_id, field_name, pos_no, item_text).

    ``kind`` is "ids" where blanks separate too, else "text". pos_no counts the non-empty values
    from 1; repeated values stay; null and blank cells give no row. ``known`` (kind, value) adds whole
    values to the learned ones: they keep their separators even without quotes or brackets. The
    dictionary is broadcast only if its measured size is within ``max_dictionary_bytes``.
    """
    cells = _filled(cells)
    said = lambda kind, cell, automaton: list(enumerate(split_cell(cell, _separators_of(kind), automaton), 1))
    return _covered(cells, _known(cells, known), said, "pos_no bigint, item_text string", max_dictionary_bytes)


def decided_cells(cells: DataFrame, *, known: DataFrame | None = None, max_dictionary_bytes: int = MAX_DICTIONARY_BYTES) -> DataFrame:
    """(row_id, field_name, decided) of every filled cell: would it be split otherwise without the dictionary?"""
    cells = _filled(cells)

    def differs(kind: str, cell: str, automaton: Automaton | None) -> list[tuple]:
        seps = _separators_of(kind)
        return [(split_cell(cell, seps, automaton) != split_cell(cell, seps),)]

    return _covered(cells, _known(cells, known), differs, "decided boolean", max_dictionary_bytes)


def packed_cells(df: DataFrame, *, row_id: str, fields: dict[str, str]) -> DataFrame:
    """``fields`` of ``df`` (name -> kind) as cells for split_values, in one pass over the table."""
    entries: list[Column] = [F.struct(F.lit(n).alias("field_name"), F.lit(k).alias("kind"), F.col(n).alias("cell")) for n, k in fields.items()]
    return df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*entries)).alias("e")).select("row_id", "e.*")
