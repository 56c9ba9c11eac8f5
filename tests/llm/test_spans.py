import random

import pytest

from lathework.llm import spans as S


@pytest.mark.parametrize("power", [1, 2, 3, 4, 5])
def test_difference_cover(power):
    period, cover = S.difference_cover(power)
    assert len(cover) == (1 << power) + 1
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in docs:
        on = [False] * (len(t or "") + 1)
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                on[i : i + n] = [True] * n
        start = None
        for i, x in enumerate(on):
            if x and start is None:
                start = i
            if not x and start is not None:
                out.add((d, start, i))
                start = None
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", 3) for d, t in docs], "doc_id long, text string, block string, span_start int")


def test_against_brute_force(spark, rows):
    rnd = random.Random(4)
    alphabet = "abcdefgh \n中文𝄞é"
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    pool = [make(rnd.randrange(15, 120)) for _ in range(12)]
    docs = [(i, "".join(rnd.choice([make(rnd.randrange(1, 30)), rnd.choice(pool)]) for _ in range(rnd.randrange(1, 8)))) for i in range(60)]
    docs += [(60, docs[0][1]), (61, docs[0][1]), (62, "x" * 300), (63, "x" * 90), (64, None), (65, ""), (66, "ab" * 40), (67, docs[1][1] + make(5))]
    for n in (20, 41):
        for size in (500, 1_000_000):
            assert rows(S.shared_spans(frame(spark, docs), min_length=n, block_chars=size)) == brute(docs, n)


def test_production_length(spark, rows):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))[:n]
    share, short = text(400), text(399)
    docs = [(1, text(37) + "#" + share + "!" + text(50)), (2, text(211) + "?" + share + "." + text(9)), (3, "%" + short + "~"), (4, "&" + short + "^" + text(500)), (5, text(2000))]
    assert rows(S.shared_spans(frame(spark, docs))) == [(1, 38, 438), (2, 212, 612)] == brute(docs, 400)


def test_copies_and_repeated_rows(spark, rows):
    docs = [(1, "q" * 10 + "abcdefghijklmnopqrstuvwxyz"), (1, "q" * 10 + "abcdefghijklmnopqrstuvwxyz"), (2, "zz")]
    assert rows(S.shared_spans(frame(spark, docs), min_length=20)) == []
    assert rows(S.shared_spans(frame(spark, [*docs, (3, docs[0][1])]), min_length=20)) == [(1, 0, 36), (3, 0, 36)]
    assert rows(S.shared_spans(frame(spark, []), min_length=20)) == []


def test_hot_passage_in_a_third_of_all_texts(spark, rows):
    rnd = random.Random(8)
    hot = "".join(rnd.choice("abcdef") for _ in range(60))
    docs = [(i, (hot if i % 3 == 0 else "") + "".join(rnd.choice("ghijkl") for _ in range(50))) for i in range(300)]
    assert rows(S.shared_spans(frame(spark, docs), min_length=40, block_chars=2000)) == brute(docs, 40)
    assert rows(S.shared_spans(frame(spark, docs), min_length=40, block_chars=2000, pooled_blocks=1)) == brute(docs, 40)  # groups of blocks pool their hashes


def test_windows_with_one_hash_in_common_are_told_apart(spark, rows, monkeypatch):
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    share, head = make(30), make(12)
    docs = [(1, head + make(40) + share), (2, share + make(9)), (3, head + make(30)), (4, make(40) + head)]
    want = brute(docs, 25)
    assert rows(S.shared_spans(frame(spark, docs), min_length=25)) == want
    whole = S.Block.hashes
    # all full windows collide in the first hash; the second one still tells them apart
    monkeypatch.setattr(S.Block, "hashes", lambda self, at, width: whole(self, at, width) if width < 25 else whole(self, at, width) * S.np.uint64(0) + S.np.uint64(5))
    assert rows(S.shared_spans(frame(spark, docs), min_length=25)) == want


def test_share(spark, rows):
    d = frame(spark, [(1, "x" * 30 + "y"), (2, "x" * 30), (3, ""), (4, None)])
    assert rows(S.shared_share(d, S.shared_spans(d, min_length=20))) == [(1, 31, 30, 0.967742), (2, 30, 30, 1.0), (3, 0, 0, 0.0)]


@pytest.mark.parametrize("values", [[0], [2**64 - 1], [0, 2**64 - 1], [1, 2, 3, 2**40, 2**63], list(range(1000))])
def test_packing(values):
    import numpy as np

    v = np.array(values, np.uint64)
    assert S.unpacked(S.packed(v), len(v)).tolist() == values


def test_document_of_several_texts_keeps_them_all(spark, rows):
    r = random.Random(5)
    t, u, v = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (60, 70, 80))
    # 2 has the whole text of 1 beside one that shares a passage with 3; 4 has that of 5 and is the least of its group
    docs = [(1, t), (2, t), (2, "x" * 100 + u[:50] + "y"), (3, "zz" + u[:50] + "w"), (4, v), (4, "q" * 90 + u[5:65]), (5, v), (6, u)]
    assert rows(S.shared_spans(frame(spark, docs), min_length=40)) == brute_of_documents(docs, 40)


def brute_of_documents(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t) - n + 1):
            where.setdefault(t[i : i + n], set()).add(d)
    starts = sorted({(d, i) for d, t in docs for i in range(len(t) - n + 1) if len(where[t[i : i + n]]) > 1})
    out = []
    for d, i in starts:
        if out and out[-1][0] == d and i <= out[-1][2]:
            out[-1][2] = i + n
        else:
            out.append([d, i, i + n])
    return sorted(map(tuple, out), key=repr)
