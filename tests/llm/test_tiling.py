import random

from lathework.llm import tiling as T


def frames(spark, docs, items):
    return spark.createDataFrame(list(docs), "doc_id long, text string, item_id string, longest int"), spark.createDataFrame(list(items), "item_id long, item_text string, suite string, doc_id int")


def brute(doc, item, k):
    d, i = T.words(doc), T.words(item)
    grams = {tuple(i[j : j + k]) for j in range(len(i) - k + 1)}
    return any(tuple(d[j : j + k]) in grams for j in range(len(d) - k + 1))


def test_against_brute_force(spark, rows):
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice("alpha beta gamma delta eps".split()) for _ in range(30)), "s", 0) for i in range(6)]
    docs = []
    for d in range(60):
        w = [rnd.choice("alpha beta gamma x y z".split()) for _ in range(40)]
        if d % 2:
            t = items[rnd.randrange(6)][1].split()
            n, s = rnd.randrange(8, 20), rnd.randrange(10)
            w[5:5] = t[s : s + n]
        docs.append((d, rnd.choice([" ", "_", ", ", "\n"]).join(w).upper(), "c", 0))
    df, it = frames(spark, docs, items)
    for k in (5, 13):
        want = sorted(((d, i) for d, t, *_ in docs for i, x, *_ in items if brute(t, x, k)), key=repr)
        assert rows(T.leaks(df, it, min_words=k).select("doc_id", "item_id")) == want
        assert rows(T.leaks(df, it, min_words=k, max_item_bytes=0).select("doc_id", "item_id")) == want  # by a join on seeds


def test_reordered_passages_are_covered(spark, rows):
    a, b = " ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(15))
    df, it = frames(spark, [(1, f"{b} other {a}", "c", 0), (2, a, "c", 0)], [(7, f"{a} {b}", "s", 0)])
    assert rows(T.leaks(df, it)) == [(1, 7, 15, 2, 28, 28), (2, 7, 13, 1, 13, 28)]
    assert rows(T.leaks(df, it, min_coverage=0.9).select("doc_id")) == [(1,)]
    assert rows(T.leaks(df, it, max_item_bytes=0)) == rows(T.leaks(df, it))


def test_tiles_do_not_overlap(spark):
    found = [(6, 0, 0), (6, 3, 0), (5, 10, 3)]
    tiles = T.tile(found, 20, 10, 3)
    assert tiles[0] == (6, 0, 0) and len({p for n, d, _ in tiles for p in range(d, d + n)}) == sum(n for n, _, _ in tiles)


def test_edges(spark, rows):
    w = " ".join(f"w{i}" for i in range(13))
    df, it = frames(spark, [(1, None, "c", 0), (2, "", "c", 0), (3, w, "c", 0), (3, w, "c", 0), (4, w.replace("w5", "w5x"), "c", 0), (5, "İ " + w.replace(" ", "__"), "c", 0)], [(1, w, "s", 0), (2, "short", "s", 0), (3, None, "s", 0), (4, "", "s", 0)])
    for bound in (10**6, 0):
        assert rows(T.leaks(df, it, max_item_bytes=bound).select("doc_id", "item_id")) == [(3, 1), (3, 1), (5, 1)]
    assert T.leaks(df.limit(0), it, max_item_bytes=0).count() == 0 and T.leaks(df, it.limit(0), max_item_bytes=-1).count() == 0
    assert T.leaks(df.limit(0), it).count() == 0 and T.leaks(df, it.limit(0)).count() == 0


def test_long_repetitive_text(spark, rows):
    df, it = frames(spark, [(1, "a b " * 20_000, "c", 0)], [(1, "a b " * 20, "s", 0)])
    assert rows(T.leaks(df, it).select("longest", "covered")) == [(40, 40)]
