import json
import random
import re

from lathework.llm import multiset_dedup as M


def found(spark, rows, records, **how):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r), "c", 1) for i, r in enumerate(records)], "submission_id long, record string, keep_id string, n int")
    return rows(M.copies(df, row_id="submission_id", record="record", **how))


def test_same_and_different(spark, rows):
    a = {"English_Term": "Drift Map", "Abbreviation": "", "Domain": None, "Context": "x"}
    same = [{"context": " X ", "english term": "[drift-map]"}, {"ENGLISH_TERM": "DRIFT\tMAP。", "CONTEXT": "x", "Abbreviation": "..."}]
    other = [{"English_Term": "Drift Map 2", "Context": "x"}, {"English_Term": "Drift Map"}, {"English_Term": "x", "Context": "Drift Map"}]
    assert found(spark, rows, [a, *same, *other]) == [(0, 1), (0, 2)]


def test_nulls_broken_and_empty(spark, rows):
    assert found(spark, rows, [None, None, "{broken", "{broken", "", {}, {"a": ""}, {"a": None}, "[1]"]) == [(5, 6), (5, 7)]
    assert found(spark, rows, []) == []


def test_hot_group_and_brute_force(spark, rows):
    rnd = random.Random(3)
    records = [{rnd.choice(["Name", "name", "NAME "]): rnd.choice(["hot", "HOT!", f"v{rnd.randrange(60)}"]), "k": rnd.choice(["", "1", " 1."])} for _ in range(400)]
    squeeze = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    first, want = {}, []
    for i, r in enumerate(records):
        key = frozenset((squeeze(a), squeeze(b)) for a, b in r.items() if squeeze(b))
        if first.setdefault(key, i) != i:
            want.append((first[key], i))
    for bound in (10**6, 0):  # kept records of heavy groups broadcast, or met by a salted shuffle
        assert found(spark, rows, records, max_broadcast_bytes=bound) == sorted(want, key=repr)


def test_colliding_fingerprints_are_told_apart(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "multiset_hash", lambda pairs: [F.lit(1).cast("bigint").alias(c) for c in M.FINGERPRINT])
    assert found(spark, rows, [{"a": "1"}, {"a": "2"}, {"a": "2"}, {"a": "1"}, {"b": "2"}, {"a": "2"}]) == [(0, 3), (1, 2), (1, 5)]
