import heapq

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lathework.llm import mixing as M


def one_by_one(weights, seats, caps):
    got, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


@settings(max_examples=1000, deadline=None)
@example([(7.0, 17), (7.0, 18), (0.2, 1)], 35)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.05, 0.1, 0.2, 0.3, 1.0, 7.0]), st.integers(0, 60)), min_size=1, max_size=7), st.integers(0, 200))
def test_apportionment_is_by_highest_quotients(sources, seats):
    weights, caps = [w for w, _ in sources], [c for _, c in sources]
    got, want = M.sainte_lague(weights, seats, caps), one_by_one(weights, seats, caps)
    assert got == want


def docs(spark, n=400):
    sources = ["big", "BIG ", "small-one", "small_one", None, "other", " "]
    return spark.createDataFrame([(i, f"word{i} some text of this record " * (1 + i % 7), sources[i % 7] if i % 7 < 2 or i % 3 == 0 else "big", 1) for i in range(n)], "doc_id long, text string, source string, n_tokens int")


def targets(spark, data):
    return spark.createDataFrame(data, "source string, target_share double, max_repeats int")


LISTED = [("big", 0.6, 1), ("small_one", 0.3, 3), ("absent", 0.1, 4)]


def test_shares_and_repeats(spark, rows):
    chosen, report = M.mix(docs(spark), targets(spark, LISTED), block_tokens=64)
    used = rows(chosen, "doc_id", "source", "n_tokens", "times_used")
    assert len({u[0] for u in used}) == len(used)
    assert all(u[3] <= {"big": 1, "small_one": 3}[u[1]] for u in used)
    got = {r.source: r for r in report.collect()}
    assert got["absent"].n_tokens == 0 and got["absent"].actual_share == 0.0
    assert abs(got["big"].actual_share - 0.6 / 0.9) < 0.03 and abs(got["small_one"].actual_share - 0.3 / 0.9) < 0.03
    assert got["big"].n_tokens == sum(u[2] * u[3] for u in used if u[1] == "big")


def test_same_seed_same_choice_and_shards(spark, rows):
    one = M.mix(docs(spark), targets(spark, LISTED), block_tokens=64, shard_tokens=2000, total_tokens=6000)
    two = M.mix(docs(spark).repartition(7), targets(spark, LISTED), block_tokens=64, shard_tokens=2000, total_tokens=6000)
    assert rows(one[0]) == rows(two[0])
    assert rows(one[0]) != rows(M.mix(docs(spark), targets(spark, LISTED), block_tokens=64, shard_tokens=2000, total_tokens=6000, seed=8)[0])
    n = sum(r.n_tokens for r in one[1].collect())
    assert 5000 < n < 7500


def test_groups_of_shards_give_every_source_its_quota(spark):
    how = dict(block_tokens=64, shard_tokens=500, total_tokens=6000)
    one, few = (M.mix(docs(spark), targets(spark, LISTED), **how, **more)[1].collect() for more in ({}, {"max_groups": 4}))
    assert [(r.source, r.n_docs > 0) for r in one] == [(r.source, r.n_docs > 0) for r in few]
    assert all(abs(a.actual_share - b.actual_share) < 0.03 for a, b in zip(one, few))


def test_counts_are_those_of_the_tokenizer(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "def f(x):\n    return '中文' + x  <|endoftext|>", "a"), (2, None, "a"), (3, "", "a"), (4, "x", None)], "doc_id long, text string, source string")
    t.encode_special_tokens = True
    assert rows(M.token_counts(d)) == [(1, "a", len(t.encode("def f(x):\n    return '中文' + x  <|endoftext|>", add_special_tokens=False).ids)), (2, "a", 0), (3, "a", 0)]


@pytest.mark.parametrize("listed", [[], [("absent", 1.0, 1)], [("big", 0.0, 1)], [("big", 1.0, 0)], [(None, 1.0, 1)]])
def test_nothing_to_select(spark, listed):
    assert M.mix(docs(spark, 20), targets(spark, listed), block_tokens=64)[0].count() == 0
    assert M.mix(docs(spark, 20).limit(0), targets(spark, LISTED), block_tokens=64)[0].count() == 0


def test_tiny_source_is_not_rounded_away(spark):
    assert M.plan({"a": 10_000_000, "b": 200}, [("a", 0.5, 1), ("b", 0.5, 4)], block_tokens=1024, total_tokens=None) == [("a", 0.5, 1, 800), ("b", 0.5, 4, 800)]
    assert M.plan({"a": 10_000_000, "b": 50}, [("a", 0.5, 1), ("b", 0.5, 4)], block_tokens=1024, total_tokens=100_000)[1][3] == 200
    d = spark.createDataFrame([(i, "word of the larger source", "a") for i in range(300)] + [(1000 + i, "few words", "b") for i in range(4)], "doc_id long, text string, source string")
    got = {r.source: r for r in M.mix(d, targets(spark, [("a", 0.5, 1), ("b", 0.5, 4)]))[1].collect()}
    assert got["b"].n_docs == 4 and abs(got["a"].actual_share - 0.5) < 0.05


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=6), st.integers(1, 4), st.floats(0, 1))
def test_shards_share_all_tokens_of_a_source(sizes, repeats, part):
    tokens = int(sum(sizes) * repeats * part)
    got = M.shard_quotas(sizes, repeats, tokens, block_tokens=64)
    assert sum(got) == tokens and all(0 <= q <= n * repeats for q, n in zip(got, sizes))
