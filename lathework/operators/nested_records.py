"""Deeply nested semi-structured records as flat tables linked to their parents.

A depth-first walk gives every node of a body its pre-order and post-order number; an ancestor's
interval contains its descendants'. Nodes of the declared record types are emitted with their
interval and scalar fields; each node is linked to the nodes whose intervals contain its own, found
on the stack of the intervals still open. A body is one row, so all of this happens where it is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "pre int, post int, ordinal int, no int, fields map<string,string>, value string"
NODE_SCHEMA = f"key_id bigint, body_key bigint, node_type string, is_leaf boolean, {NODE}"


@dataclass(frozen=True)
class RecordTypes:
    """``holders``: key -> record type of what is under it. ``running``: types numbered through the body.

    ``wrappers``: keys whose text may hold encoded JSON. ``scalars``: types whose plain text is the record.
    """

    holders: dict[str, str]
    running: frozenset[str] = frozenset()
    wrappers: frozenset[str] = frozenset()
    scalars: frozenset[str] = frozenset()


SOURCE_MAP = RecordTypes(
    holders={"paragraphs": "paragraph", "claims": "claim", "source_anchor": "anchor"}, running=frozenset({"paragraph"}),
    wrappers=frozenset({"paragraphs", "claims", "review", "sections"}), scalars=frozenset({"anchor"}),
)


def as_written(v: object) -> str:
    """A value's text: strings as they are, null as '', all else as compact JSON."""
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def parse(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it is not complete. Shallow texts go to the standard parser."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    """One pass with a stack of the open containers: [container, key] pairs, so that depth costs memory only."""
    skip = lambda i: _SPACE.match(text, i).end()
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]
    at, closed = skip(0), False  # closed: a value has just ended, so a comma or a closing sign follows
    while True:
        box, key = stack[-1]
        if closed:
            if len(stack) == 1:
                if at != len(text):
                    raise ValueError(f"text after the value at {at}")
                return root[0]
            c, at = text[at : at + 1], skip(at + 1)
            if c == ("}" if isinstance(box, dict) else "]"):
                stack.pop()
                continue
            if c != ",":
                raise ValueError(f"comma expected before {at}")
        elif text[at : at + 1] == ("}" if isinstance(box, dict) else "]") and len(stack) > 1 and not box:
            stack.pop()
            at, closed = skip(at + 1), True
            continue
        if isinstance(box, dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"key expected at {at}")
            key, at = json.decoder.scanstring(text, at + 1)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"colon expected at {at}")
            at = skip(at + 1)
        c = text[at : at + 1]
        if c == '"':
            value, at = json.decoder.scanstring(text, at + 1)
            closed = True
        elif c in ("{", "["):
            value, at, closed = {} if c == "{" else [], at + 1, False
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"value expected at {at}")
            value, at, closed = json.loads(m[0]), m.end(), True
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        if not closed:
            stack.append((value, None))
        at = skip(at)


def _decoded(v: object) -> object:
    if isinstance(v, str) and v.strip()[:1] in ("[", "{"):
        try:
            return parse(v)
        except ValueError:
            return v
    return v


def label_nodes(root: object, types: RecordTypes) -> list[tuple]:
    """(node_type, pre, post, ordinal, no, fields, value) of every node of a declared type, in the order of pre.

    pre and post count all nodes of the tree from 1. ordinal is the position in the list (1 for a
    single object), no the position that the type is numbered by. Nulls are no records, though
    they keep their position. The walk keeps its own stack, so depth is no limit.
    """
    out: list[list] = []
    pre = post = 0
    running = dict.fromkeys(types.running, 0)
    # entries: (value, key, ordinal, node_type) on the way down, a row to close on the way up
    stack: list = [(root, None, 1, None)]
    while stack:
        top = stack.pop()
        if isinstance(top, list):
            post += 1
            top[2] = post
            continue
        value, key, ordinal, kind = top
        pre += 1
        if key in types.wrappers:
            value = _decoded(value)
        row: list = [None, pre, 0, ordinal, ordinal, None, None]
        if kind and not isinstance(value, list):
            if kind in running:
                running[kind] += 1
                row[4] = running[kind]
            if value is not None:
                fields = {k: as_written(v) for k, v in value.items() if not isinstance(v, (list, dict))} if isinstance(value, dict) else {}
                row[0], row[5], row[6] = kind, fields, None if isinstance(value, dict) else as_written(value)
                out.append(row)
        stack.append(row)
        children: list = []
        if isinstance(value, dict):
            children = [(v, k, 1, types.holders.get(k)) for k, v in value.items()]
        elif isinstance(value, list):
            children = [(_decoded(v) if key in types.wrappers else v, None, i, kind) for i, v in enumerate(value, 1)]
        stack.extend(reversed(children))
    return [tuple(r) for r in out]


def link_by_containment(nodes: Sequence[tuple], chain: Sequence[str]) -> list[tuple[tuple, list[tuple], bool]]:
    """(node, its nearest ancestor of every outer type, holds no node of the next type) of a body's nodes in the order of pre.

    ``chain`` names the types, outermost first. A node's ancestors are the open intervals: those that
    began before it and end after it. Intervals of any type that ended are closed first, so a record
    nested in another of its own type hides it only while it is open. Nodes that lack an outer
    ancestor are left out.
    """
    rank = {t: i for i, t in enumerate(chain)}
    open_: list[tuple] = []
    linked: list[tuple[tuple, list[tuple]]] = []
    parents: set[int] = set()
    for node in nodes:
        while open_ and open_[-1][2] < node[2]:
            open_.pop()
        level = rank.get(node[0])
        if level is not None:
            nearest = {n[0]: n for n in open_}
            outer = [nearest[t] for t in chain[:level] if t in nearest]
            if len(outer) == level:
                linked.append((node, outer))
                if outer:
                    parents.add(outer[-1][1])
        open_.append(node)
    return [(node, outer, node[1] not in parents) for node, outer in linked]


def linked_nodes(df: DataFrame, *, key: str, body: str, types: RecordTypes, chain: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Nodes of the types in ``chain`` of every body that is complete JSON: NODE_SCHEMA and a struct (NODE) per outer type.

    Null, empty, cut off or undecodable bodies give no rows; a body of any depth is read whole. Repeated
    deliveries of the same body repeat their rows (see distinct_nodes). ``is_leaf``: the node holds no node
    of the next type. ``fields``: the scalar fields that are kept, all if not given.
    """
    outer = list(chain[:-1])
    schema = f"{NODE_SCHEMA}, " + ", ".join(f"{t} struct<{NODE}>" for t in outer) if outer else NODE_SCHEMA
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")] + outer
    parts = [c.split()[0] for c in NODE.split(", ")]

    def kept(node: tuple) -> tuple:
        return node if fields is None else (*node[:5], {f: node[5][f] for f in fields if f in node[5]}, node[6])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            # a body delivered again and again goes on to the shuffle once a batch
            pdf = pdf.drop_duplicates(["key_id", "body_key"])
            for key_id, body_key, text in zip(pdf["key_id"], pdf["body_key"], pdf["body"]):
                try:
                    root = parse(text)
                except ValueError:
                    continue
                for node, above, leaf in link_by_containment(list(map(kept, label_nodes(root, types))), chain):
                    structs = [dict(zip(parts, a[1:])) for a in above]
                    rows.append((key_id, body_key, node[0], leaf, *node[1:], *structs, *[None] * (len(outer) - len(structs))))
            yield pd.DataFrame(rows, columns=names)

    bodies = df.where(F.col(body).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key_id"), F.xxhash64(body).alias("body_key"), F.col(body).alias("body"))
    return bodies.mapInPandas(walk, schema)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Each node of each body once, however often the body was delivered."""
    return nodes.dropDuplicates(["key_id", "body_key", "pre"])
