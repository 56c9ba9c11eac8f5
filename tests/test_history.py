import random
from datetime import date, datetime

from lathework.operators import history

ATTRS = ("status", "first_verified", "last_verified", "preferred_chinese")
SCHEMA = "row_id long, workspace_id string, snapshot_date date, term_id string, status string, first_verified string, last_verified string, preferred_chinese string, loaded_at timestamp_ntz, scope string, value string"
ARGS = dict(scope="workspace_id", date="snapshot_date", entity="term_id", attributes=ATTRS, loaded_at="loaded_at", row_id="row_id")


def frame(spark, data):
    return spark.createDataFrame([(i, *r, "c", "v") for i, r in enumerate(data)], SCHEMA)


def row(ws, day, term, s, f="", l="", p="", h=1):
    return (ws, date(2024, 1, day) if day else None, term, s, f, l, p, datetime(2024, 2, 1, h))


def versions(spark, rows, data):
    return rows(history.versions(frame(spark, data), **ARGS), "scope", "entity", "status", "valid_from", "valid_to")


def d(n):
    return date(2024, 1, n)


def test_changes_gaps_and_ends(spark, rows):
    data = [row("w", 1, "t", "A"), row("w", 3, "t", " A\t"), row("w", 5, "u", "A"), row("w", 6, "t", "A"), row("w", 7, "t", "B"), row("w", 8, "u", None), row("w", 8, "u", "")]
    assert versions(spark, rows, data) == [("w", "t", "A", d(1), d(5)), ("w", "t", "A", d(6), d(7)), ("w", "t", "B", d(7), d(8)), ("w", "u", "", d(8), None), ("w", "u", "A", d(5), d(6))]


def test_last_loaded_wins_and_ties_go_to_the_larger_row(spark, rows):
    data = [row("w", 1, "t", "late", h=9), row("w", 1, "t", "early", h=2), row("w", 2, "t", "x", h=3), row("w", 2, "t", "y", h=3)]
    assert versions(spark, rows, data) == [("w", "t", "late", d(1), d(2)), ("w", "t", "y", d(2), None)]


def test_null_and_blank_keys_still_date_snapshots(spark, rows):
    data = [row("w", 1, "t", "A"), row("w", 2, None, "A"), row("w", 3, "  ", "A"), row("w", None, "t", "Z"), row(None, 1, "t", "Z")]
    assert versions(spark, rows, data) == [("w", "t", "A", d(1), d(2))]
    assert versions(spark, rows, []) == []


def test_attribute_log_has_own_intervals(spark, rows):
    data = [row("w", 1, "t", "A", "x"), row("w", 2, "t", "B", "x"), row("w", 3, "t", "B", "y")]
    log = rows(history.attribute_log(frame(spark, data), **ARGS), "attribute", "value", "valid_from", "valid_to")
    assert ("status", "A", d(1), d(2)) in log and ("status", "B", d(2), None) in log and ("first_verified", "x", d(1), d(3)) in log and ("last_verified", "", d(1), None) in log


def test_against_brute_force(spark, rows):
    rnd = random.Random(5)
    data = [row(f"w{rnd.randrange(2)}", rnd.randrange(1, 9), f"t{rnd.randrange(3)}", rnd.choice("AB "), rnd.choice(["x", None]), "", rnd.choice("pq"), rnd.randrange(1, 4)) for _ in range(120)]
    want = set()
    clean = lambda v: (v or "").strip()
    for ws in ("w0", "w1"):
        days = sorted({r[1] for r in data if r[0] == ws})
        for t in ("t0", "t1", "t2"):
            state = {}
            for i, r in enumerate(data):
                if r[0] == ws and r[2] == t and (r[1] not in state or (r[7], i) >= state[r[1]][0]):
                    state[r[1]] = ((r[7], i), tuple(map(clean, r[3:7])))
            start = None
            for k, day in enumerate([*days, None]):
                now = state.get(day, (None, None))[1]
                if start and now != start[1]:
                    want.add((ws, t, start[1][0], start[0], day))
                    start = None
                if now and not start:
                    start = (day, now)
    assert set(versions(spark, rows, data)) == want
    joined = history.versions(frame(spark, data), **ARGS, max_calendar_rows=0)
    assert set(rows(joined, "scope", "entity", "status", "valid_from", "valid_to")) == want
