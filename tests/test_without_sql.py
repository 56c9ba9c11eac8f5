"""Queries that SQL cannot say, over their own whole output: against a plain second way, or by what must be kept."""

import math
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

from lathework.functions import udfs
from lathework.plans import catalogue

RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def texts(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def t_tail(t, df, steps=4000):
    """Two-sided tail of Student's t by Simpson's rule over the density, after t = sqrt(df) * tan(a)."""
    a, b = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    h = (b - a) / steps
    f = [math.cos(a + i * h) ** (df - 1) for i in range(steps + 1)]
    area = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_p_values(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey", "l_discount").toPandas()
    per = lines.groupby("l_suppkey")["l_discount"].agg(["mean", "std", "count"])
    per = per[(per["count"] > 1) & (per["std"] > 0)]
    got = {r.l_suppkey: r.p for r in catalogue.QUERIES["p_values"](spark, data).collect()}
    assert len(got) == len(per)
    for k, m, s, n in per.itertuples():
        assert abs(got[k] - t_tail((m - 0.05) / (s / math.sqrt(n)), n - 1)) < 2e-6


def test_numeric_tokens(spark, data):
    got = {r.doc_id: r.n_tokens for r in catalogue.QUERIES["numeric_tokens"](spark, data).collect()}
    for i, t in texts(spark, data):
        tokens = udfs.numeric_tokens_of(t or "")
        assert got[i] == len(tokens)
        # no digit is in two tokens, and each token but a month's number is in the text
        digits = lambda s: sum(c.isdigit() or c in RAISED for c in s)
        assert sum(map(digits, tokens)) <= digits(t or "") + 2 * len(re.findall("(?i)january|february|march|april|may|june|july|august|september|october|november|december", t or "")) + 2 * len(tokens)
    # where numbers are plain they are all found, once each and in order
    for r in spark.read.parquet(f"{data}/text_frame_inventory.parquet").where("source_text IS NOT NULL").select("source_text").collect():
        assert udfs.numeric_tokens_of(r.source_text) == re.findall(r"\d+", r.source_text)


def test_semantic_tokens_keep_the_text(spark, data):
    kinds = Counter()
    for _, t in texts(spark, data):
        tokens = udfs.semantic_tokens_of(t or "")
        kinds.update(k for k, _ in tokens)
        kept = "".join(x for k, x in tokens if k not in ("SPACE", "CITATION"))
        whole = re.sub(rf"\[(\d+(?:\s*[-–—,;，、]\s*\d+)*)\]|[{RAISED}]+(?:[˒,，–—-][{RAISED}]+)*", "", udfs.typography_of(t or ""))
        squeeze = lambda s: re.sub(r"\s", "", s)
        assert squeeze(kept) == squeeze(whole)
    assert dict(kinds) == {r.kind: r.n for r in catalogue.QUERIES["semantic_token_kinds"](spark, data).collect()}


def plain_semantic_tokens(text):
    """Every kind tried at every place."""
    kinds, at, out = [(k, re.compile(p)) for k, p in udfs.TOKEN_KINDS], 0, []
    while at < len(text):
        blank = re.compile(r"\s[ \t]*").match(text, at)
        found = max(((m.end() - at, -i) for i, (_, p) in enumerate(kinds) if (m := p.match(text, at))), default=None)
        if found:
            end, kind = at + found[0], kinds[-found[1]][0]
        elif text[at] != "\n" and blank:
            end, kind = blank.end(), "SPACE"
        else:
            end, kind = at + 1, "BREAK" if text[at] == "\n" else "PUNCTUATION" if text[at] in "，。；：！？、（）【】《》" else "TEXT"
        out.append((kind, text[at:end]))
        at = end
    return out


def test_semantic_tokens_are_the_longest_at_each_place():
    parts = ["p", "f", "rs", "df", "β", "χ²", "[", "]", "(", ")", "=", "<", "1", "9", "95%", "10", "123", ".", "x", "×", "*", "^", "+", "-", "−", "–", ":", "/", "%", " ", "\n", "　", "\x1c", "SWS", "swſ", "REM", "nrem", "cb", "-Nap", "Δ", "Error", "CI"]
    parts += ["Hz", "Kg", "ms", "ſ", "s", "μV", "http", "s://", "foo", "_", "c", "n", "ά", "é", "٣", "²", "⁰", "，", "。", "共", "\u200b", "ı", "3d", "{", ",", "remember", "ht"]
    pick = random.Random(1)
    for _ in range(8000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 14)))
        want, got, counts = plain_semantic_tokens(udfs.typography_of(text)), udfs.semantic_tokens_of(text), {}
        assert [k for k, _ in got] == [k for k, _ in want], text
        assert [x for k, x in got if k not in ("CITATION", "SPACE")] == [x for k, x in want if k not in ("CITATION", "SPACE")]
        udfs.count_kinds(text, counts)
        assert counts == Counter(k for k, _ in want)


BOUNDED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.executor.pyspark.memory", "1200m").getOrCreate()
from lathework.functions import udfs
from lathework.plans.catalogue import QUERIES
s.range(0, 10000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("{{a1}} "), 100).alias("text")).write.parquet({data!r} + "/documents.parquet")
want = [("CODE", 1000000), ("SPACE", 1000000), ("TEXT", 2000000)]
assert sorted(map(tuple, QUERIES["semantic_token_kinds"](s, {data!r}).collect())) == want
t = s.read.parquet({data!r} + "/documents.parquet").select(F.explode(udfs.semantic_tokens("text")).alias("t"))
assert sorted(map(tuple, t.groupBy("t.kind").count().collect())) == want
print("all right")
"""


def test_semantic_tokens_in_bounded_memory(tmp_path):
    """A batch of 10,000 texts, four million tokens, in a worker that may take 1.2 GB: as counts, and as tokens."""
    code = BOUNDED.format(repo=str(Path(__file__).resolve().parents[1]), data=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("all right"), done.stderr[-2000:]


def test_typography_is_stable_and_keeps_words(spark, data):
    out = {r.doc_id: r.stable for r in catalogue.QUERIES["chinese_typography"](spark, data).collect()}
    letters = lambda s: re.sub(r"[^A-WYZa-wyz0-9㐀-鿿]", "", s)  # noqa: E731  an x between numbers becomes the sign of multiplication
    for i, t in texts(spark, data):
        if t is not None:
            n = udfs.typography_of(t)
            assert out[i] == (udfs.typography_of(n) == n) and letters(n) == letters(t)


def test_page_lines_keep_every_text(spark, data):
    frames = spark.read.parquet(f"{data}/text_frame_inventory.parquet").where("source_id IS NOT NULL AND source_page IS NOT NULL").toPandas()
    frames = frames[frames["bbox_pt"].map(lambda b: b is not None and b[2] > b[0] and b[3] > b[1]) & (frames["source_text"].fillna("").str.strip() != "")]
    lines = catalogue.QUERIES["page_lines"](spark, data).toPandas()
    page = ["source_id", "source_page"]
    words = lambda d, c: {k: Counter("".join(g[c].fillna("")).replace(" ", "")) for k, g in d.groupby(page)}
    assert words(frames, "source_text") == words(lines, "text")
    for k, g in lines.groupby(page):
        f = frames[(frames["source_id"] == k[0]) & (frames["source_page"] == k[1])]
        assert g["x0"].min() == min(b[0] for b in f["bbox_pt"]) and g["x1"].max() == max(b[2] for b in f["bbox_pt"])
        # lines of one block follow each other in one column, without overlap beyond two points
        for _, block in g.groupby("block"):
            b = block.sort_values("top")
            assert ((b["top"].shift(-1) - b["bottom"]).dropna() >= -2.0 - 1e-9).all() and b["font"].map(re.compile("(?i)bold").search).map(bool).nunique() == 1
