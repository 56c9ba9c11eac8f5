"""Event logs as streams. The log's own number is the order; event time is not, so there is no watermark and a late row is a later row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVIDENCE_OUT = "id string, seq bigint, supports array<string>, reported_terms array<string>, roles array<string>, state string"
EVIDENCE_STATE = "seq bigint, supports array<string>, reported_terms array<string>, roles array<string>, state string"


def fold_evidence(events: DataFrame) -> DataFrame:
    """Running state of evidence: (id, seq, supports, reported_terms, roles, state) after each micro-batch that touches an id.

    ``events``: (id, seq, kind, supports, reported_terms, roles, status), of an update its new lists. Within a batch events count in
    the order of seq; an event at or below the last seq seen is a repeat and is ignored. The rules are those of registry.evidence_state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *lists, status = state.get if state.exists else (-1, None, None, None, None)
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        touched = False
        for r in pdf.itertuples(index=False):
            if r.seq <= last:
                continue
            last = int(r.seq)
            given = [_list(r.supports), _list(r.reported_terms), _list(r.roles)]
            if r.kind not in ("DEPRECATE", "UNLINK", "UPDATE_SUPPORTS"):
                lists, status, touched = given, r.status if isinstance(r.status, str) else "ACTIVE", True
            elif status is not None and r.kind == "DEPRECATE":
                status, touched = "DEPRECATED", True
            elif status is not None and r.kind == "UPDATE_SUPPORTS" and given[0] is not None:
                lists, touched = [new if new is not None else old for new, old in zip(given, lists)], True
        state.update((last, *lists, status))
        if touched:
            yield pd.DataFrame({"id": [key[0]], "seq": [last], "supports": [lists[0]], "reported_terms": [lists[1]], "roles": [lists[2]], "state": [status]})

    return events.groupBy("id").applyInPandasWithState(step, EVIDENCE_OUT, EVIDENCE_STATE, "update", GroupStateTimeout.NoTimeout)


def _list(v: object) -> list[str] | None:
    return None if v is None else list(v)


def check_chains(corrections: DataFrame) -> DataFrame:
    """Corrections (key, seq, old, new) that do not continue the key's last state, or change nothing: (key, seq, expected, old, new)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        bad = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
            if (last is not None and r.old != last) or r.old == r.new:
                bad.append((key[0], int(r.seq), last, r.old, r.new))
            last = r.new
        if last is not None:
            state.update((last,))
        if bad:
            yield pd.DataFrame(bad, columns=["key", "seq", "expected", "old", "new"])

    return corrections.groupBy("key").applyInPandasWithState(step, "key string, seq bigint, expected string, old string, new string", "last string", "append", GroupStateTimeout.NoTimeout)


def last_known(observations: DataFrame, *, unknown: str = "UNKNOWN") -> DataFrame:
    """(key, seq, status, last_known) after each batch: an unknown observation keeps the last known one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for s in pdf["status"]:
            known = s if s != unknown else known
        state.update((known,))
        yield pd.DataFrame({"key": [key[0]], "seq": [int(pdf["seq"].iloc[-1])], "status": [pdf["status"].iloc[-1]], "last_known": [known]})

    return observations.groupBy("key").applyInPandasWithState(step, "key string, seq bigint, status string, last_known string", "known string", "update", GroupStateTimeout.NoTimeout)


def refresh_on_write(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], *, checkpoint: str) -> StreamingQuery:
    """Rebuild derived tables whenever rows arrive: each batch once, in order. ``rebuild`` must give the same for a repeated batch number."""
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, *, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and give the emitted rows as a table (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
