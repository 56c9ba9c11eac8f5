import random
from datetime import datetime, timedelta

from lathework.operators import orphans

T0 = datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def refs(spark, data):
    return orphans.references(spark.createDataFrame([(i, k, at(h), "x", "m") for i, (k, h) in enumerate(data)], "row_id long, fk string, used timestamp_ntz, key string, ref_month string"), table="t", field="fk", row_id="row_id", at="used")


def events(spark, data):
    df = spark.createDataFrame([(i, k, a, at(h)) for i, (k, a, h) in enumerate(data)], "seq long, id string, adds boolean, at timestamp_ntz")
    return orphans.periods_from_events(df, field="fk", key="id", adds="adds", at="at", order="seq")


def spans(spark, data):
    df = spark.createDataFrame([(k, at(a), at(z), 1) for k, a, z in data], "id string, a timestamp_ntz, z timestamp_ntz, start int")
    return orphans.periods_from_rows(df, field="fk", key="id", start="a", stop="z")


def found(rows, r, p, total=10, **how):
    return rows(orphans.orphans(r, p, total, **how), "row_id", "reason")


def test_reasons_and_boundaries(spark, rows):
    p = spans(spark, [("A", 5, 10), ("B", 0, None), ("C", 9, 3)])
    r = refs(spark, [(" a ", 4), ("A", 5), ("a", 9), ("A", 10), ("b", 0), ("zz", 1), (None, 1), ("  ", 1), ("c", 9), ("A", None)])
    assert found(rows, r, p) == [(0, "LATE"), (3, "DELETED"), (5, "MISSING"), (8, "DELETED")]


def test_readded_evidence(spark, rows):
    p = events(spark, [("E", True, 20), ("E", False, 30), ("e ", True, 1), ("E", False, 10), ("E", True, 2), ("F", False, 1), ("G", False, 1), ("G", True, 3)])
    r = refs(spark, [("E", 0), ("E", 5), ("E", 10), ("E", 20), ("E", 31), ("F", 5), ("G", 2), ("G", 4)])
    assert found(rows, r, p) == [(0, "LATE"), (2, "DELETED"), (4, "DELETED"), (5, "MISSING"), (6, "LATE")]


def test_empty_tables(spark, rows):
    assert found(rows, refs(spark, []), spans(spark, [])) == []
    assert found(rows, refs(spark, [("A", 1)]), spans(spark, [])) == [(0, "MISSING")]
    assert found(rows, refs(spark, []), events(spark, [])) == []


def test_hot_keys_against_brute_force(spark, rows):
    rnd = random.Random(1)
    log = [(f"k{rnd.randrange(6)}", rnd.random() < 0.6, rnd.randrange(1500)) for _ in range(40)]
    uses = [(("K0" if rnd.random() < 0.4 else f"k{rnd.randrange(8)}"), rnd.randrange(1500)) for _ in range(400)]
    want = []
    for i, (k, h) in enumerate(uses):
        seen = sorted((e[2], j, e[1]) for j, e in enumerate(log) if e[0].upper() == k.upper())
        first = next((e[0] for e in seen if e[2]), None)
        before = [e for e in seen if e[0] <= h]
        if first is None:
            want.append((i, "MISSING"))
        elif first > h:
            want.append((i, "LATE"))
        elif not before[-1][2]:
            want.append((i, "DELETED"))
    for total, most in ((400, 10**6), (10**9, 10**6), (400, 0), (150_000, 10**6)):  # all keys heavy, none, heavy without broadcast, one heavy
        assert found(rows, refs(spark, uses), events(spark, log), total, max_broadcast_rows=most) == sorted(want, key=repr)
    counts = rows(orphans.orphan_counts(refs(spark, uses), events(spark, log), 150_000), "ref_month", "reason", "n_orphans")
    month = {i: at(h).strftime("%Y-%m") for i, (_, h) in enumerate(uses)}
    assert counts == sorted({(month[i], r, sum(month[j] == month[i] and s == r for j, s in want)) for i, r in want}, key=repr)


def test_heavy_keys_are_checked_by_broadcast_and_the_rest_by_anti_join(spark):
    r, p = refs(spark, [("hot", h) for h in range(50)] + [("cold", 1)]), spans(spark, [("HOT", 3, 9), ("HOT", 20, 30), ("HOT", 25, 40)])
    bad = {(x.key, x.heavy, x.verdict, x.n) for x in orphans.judged_groups(r, p, 40_000)[0].collect()}
    assert bad == {("HOT", True, "MIXED", 50), ("COLD", False, "MISSING", 1)}
