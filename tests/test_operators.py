"""Small tests of the operators behind the reference queries: edge cases that the test tables don't hold."""

import math

import pytest
from pyspark.sql import functions as F

from lathework.functions import normalize as N
from lathework.functions import udfs
from lathework.operators import checks, coverage, identity, ordered, registry, rules, spatial, status, token_compare


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(c.alias("r")).first().r


@pytest.mark.parametrize(("raw", "doi"), [(" HTTPS://doi.org/10.1/A ", "10.1/a"), ("doi: 10.1/b", "10.1/b"), ("http://dx.doi.org/10.1/c", "10.1/c"), ("https://doi.org/", None), (None, None), ("", None)])
def test_doi(spark, raw, doi):
    assert one(spark, N.normalize_doi(F.col("x")), x=raw) == doi


@pytest.mark.parametrize(("raw", "ok"), [("2024-02-29", True), ("2023-02-29", False), ("2024-2-9", False), (" 2024-02-09", False), (None, False)])
def test_iso_date(spark, raw, ok):
    assert one(spark, N.is_iso_date(F.col("x")), x=raw) is ok


@pytest.mark.parametrize(("raw", "canon"), [("5 × 10⁻³", "5x10^-3"), ("− 2", "-2"), ("χ² = 3", "chi2=3"), ("12 minutes", "12min"), ("1,234", "1234"), ("r^2 = .3", "r2=.3"), ("3 DAYS", "3day")])
def test_canon_is_the_same_in_both_engines(spark, raw, canon):
    assert one(spark, N.canon_number(F.col("x")), x=raw) == canon == udfs.canon(raw)


def test_numeric_tokens():
    text = "n = 28, p < .001, t(12) = −2.50; 3.2 × 10^-5 Hz, 12 ms v2.1.0 in March Figure 3 [1,2] T1 and 1,234 plus 10.1234/abc.d 0,05"
    assert udfs.numeric_tokens_of(text) == ["10.1234/abc.d", "3.2x10^-5", "p<.001", "t(12)=-2.50", "t1", "12ms", "version2.1.0", "3", "3", "28", "1234", "005"]
    assert udfs.numeric_tokens_of("") == []


def test_semantic_tokens_cover_the_text():
    text = "在SWS x REM 中，p < 0.05 [1, 2–4] 共 12ms\nABC-1 ok"
    kinds = udfs.semantic_tokens_of(text)
    assert ("PROTECTED", "SWS×REM") in kinds and ("STAT", "p < 0.05") in kinds and ("CITATION", "1,2–4") in kinds and ("UNIT", "12 ms") in kinds and ("BREAK", "\n") in kinds
    assert udfs.typography_of(udfs.typography_of(text)) == udfs.typography_of(text)


def test_html_and_visible_text(spark):
    assert udfs.html_text("<p>a &amp; b<br>c</p>") == "a & b c"
    assert one(spark, N.visible_text(F.col("x")), x="# A **b** [c](d) ![e](f)") == "A b c e"
    assert one(spark, N.visible_length(F.col("x")), x="a　b​c ") == 3


def test_sequences_in_texts(spark):
    assert one(spark, ordered.holds_in_order(F.array(F.lit("ab"), F.lit(None).cast("string"), F.lit("b")), F.col("x")), x="ab b") is True
    assert one(spark, ordered.holds_in_order(F.array(F.lit("ab"), F.lit("b")), F.col("x")), x="b ab") is False
    assert one(spark, ordered.headings_in_order(["A", "B"], F.col("x")), x="B A") is False
    seq = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    assert one(spark, N.holds_sequence(seq("a", "b", "c"), seq("b", "c"))) is True
    assert one(spark, N.holds_sequence(seq("a", "b"), seq("b", "c"))) is False
    assert one(spark, N.holds_sequence(seq("a"), seq("a", "b"))) is False
    assert one(spark, N.holds_sequence(seq(), seq())) is True


def test_boxes(spark):
    assert one(spark, N.is_box(F.col("b")), b=[0.0, 0.0, 1.0, 1.0]) is True
    for b in ([0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 1.0], [0.0, 0.0, math.inf, 1.0], [0.0, math.nan, 1.0, 1.0]):
        assert one(spark, N.is_box(F.col("b")), b=b) is False
    assert one(spark, N.boxes_intersect(F.col("a"), F.col("b")), a=[0.0, 0.0, 1.0, 1.0], b=[1.0, 0.0, 2.0, 1.0]) is False


def test_bags_and_cancellation(spark, rows):
    d = spark.createDataFrame([("p", 1, "x", True), ("p", 1, "x", True), ("p", 2, "x", False), ("p", 3, "y", True), ("q", 4, "y", False)], "page string, unit int, token string, src boolean")
    diff = coverage.bag_difference(d, ["page", "unit"], "token", "src")
    assert rows(coverage.cancel_within(diff, page=["page"], unit="unit", token="token")) == [("p", 1, "x", 1, 0), ("p", 3, "y", 1, 0), ("q", 4, "y", 0, 1)]
    allowed = spark.createDataFrame([(1, "MISSING", "x", None), (3, "PAIR", "y", "z")], "unit int, kind string, source_token string, translated_token string")
    extra = diff.unionByName(spark.createDataFrame([("p", 3, "z", 0, 1)], diff.schema))
    assert rows(coverage.without_allowed(extra, allowed, unit="unit", token="token"), "unit", "token", "missing", "added") == [(2, "x", 0, 1), (4, "y", 0, 1)]


def test_coverage_with_nulls_and_repeats(spark, rows):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "n")], "k int, v string")
    f = spark.createDataFrame([(2, "c"), (3, "d"), (None, "n")], "k int, v string")
    assert rows(coverage.coverage(e, f, ["k"], ["v"])) == [(1, "MISSING", ""), (2, "MISMATCH", "v"), (3, "EXTRA", "")]
    assert coverage.coverage(e.limit(0), f.limit(0), ["k"]).count() == 0


def test_missing_numbers(spark, rows):
    d = spark.createDataFrame([("a", 2), ("a", 4), ("b", 1)], "g string, n int")
    assert rows(coverage.missing_numbers(d, ["g"], "n")) == [("a", 1), ("a", 3)]
    assert rows(coverage.is_sequence(d, ["g"], "n")) == [("a", 2, False), ("b", 1, True)]


def test_identity_rules(spark, rows):
    left = spark.createDataFrame([(1, "a", None), (2, None, "d"), (3, "x", "y")], "id int, p string, d string")
    right = spark.createDataFrame([(7, "a", "d"), (8, None, None)], "id int, p string, d string")
    both = spark.createDataFrame([(4, "a", "d")], left.schema)
    assert rows(identity.identity_links(left.unionByName(both), right.unionByName(both.withColumn("id", F.lit(9))), [("p", "p"), ("d", "d")], left_id="id", right_id="id")) == [(1, 2, 7), (2, 2, 7), (4, 2, 7)]
    d = spark.createDataFrame([(1, "10.1/A", "P1"), (2, None, " p1 "), (3, "https://doi.org/10.1/a", None)], "id int, DOI string, Paper_ID string")
    assert rows(identity.find_records(d, "DOI", "doi: 10.1/a"), "id") == [(1,), (3,)] and rows(identity.find_records(d, "Paper_ID", "P1"), "id") == [(1,), (2,)] and identity.find_records(d, "DOI", " ").count() == 0
    docs = spark.createDataFrame([("k", False, True, 1), ("k", False, True, 2), ("m", True, False, 1), ("m", False, True, 2), ("z", None, None, 3)], "k string, f boolean, p boolean, o int")
    assert rows(identity.current_rows(docs, key="k", flag="f", preferred="p", order="o"), "k", "o", "ambiguous") == [("k", 2, True), ("m", 1, False), ("z", 3, False)]


LOG = "seq long, event_type string, evidence_id string, target string, supports array<string>, new_supports array<string>, reported_terms array<string>, roles array<string>, status string"


def fold(spark, events):
    e = spark.createDataFrame(events, LOG)
    updates = {"supports": "new_supports", "reported_terms": "reported_terms", "roles": "roles"}
    return registry.evidence_state(e, key=F.col("evidence_id"), target=F.col("target"), kind="event_type", order="seq", payload=[], updates=updates, guard="new_supports")


def test_evidence_fold_rules(spark, rows):
    n = None
    got = fold(spark, [
        (1, "DEPRECATE", n, "A", n, n, n, n, n), (2, n, "A", n, ["x"], n, ["x"], ["r"], n), (3, "UPDATE_SUPPORTS", n, "A", n, ["x", "y"], ["y"], n, n), (4, "UPDATE_SUPPORTS", n, "A", n, n, ["z"], ["q"], n), (5, "DEPRECATE", n, "A", n, n, n, n, n),
        (6, "ADD", "B", n, ["p"], n, n, n, "OLD"), (7, "UNLINK", n, "B", n, n, n, n, n), (8, "UPDATE_SUPPORTS", n, "Z", n, ["q"], n, n, n), (9, "DEPRECATE", n, "C", n, n, n, n, n), (10, "IMPORT", "C", n, n, n, n, n, n),
        (11, "UPDATE_SUPPORTS", n, "B", n, ["s"], n, ["t"], n), (12, "ADD", "D", n, ["d"], n, ["d"], n, n), (13, "UPDATE_SUPPORTS", n, "D", n, [], n, n, n), (14, "ADD", "D", n, ["e"], n, n, n, n),
    ])
    assert rows(got) == [("A", ["x", "y"], ["y"], ["r"], "DEPRECATED"), ("B", ["s"], None, ["t"], "OLD"), ("C", None, None, None, "ACTIVE"), ("D", ["e"], None, None, "ACTIVE")]
    assert rows(fold(spark, [])) == []


def test_resolve_counts_good_candidates_only(spark, rows):
    reg = spark.createDataFrame(
        [("T9", "map", "S", None, "c", "HIGH", "ACTIVE", "E1", None), ("T1", "Map ", "S", None, "c", "LOW", "ACTIVE", "E1", None), ("T3", "cue", "S", None, "c", "HIGH", "ACTIVE", "E1", None), ("T4", "cue", "s", None, "C", "HIGH", "CONTEXTUAL", None, "E2"), ("T5", "gain", "S", None, "c", "HIGH", "ACTIVE", " ", "")],
        "term_id string, english_term string, domain string, subdomain string, context string, confidence string, status string, evidence_id string, evidence_ids string",
    )
    q = spark.createDataFrame([(1, "MAP", "S", None, "c"), (2, "cue", "S", None, "c"), (3, "gain", None, None, None), (4, "none", None, None, None), (5, "map", "other", None, None)], "query_id int, english_term string, domain string, subdomain string, context string")
    assert rows(registry.resolve(q, reg)) == [(1, 2, "REUSE", "T9"), (2, 2, "VERIFY", ""), (3, 1, "VERIFY", ""), (4, 0, "VERIFY", ""), (5, 0, "VERIFY", "")]


def test_appended_rows_are_judged_one_by_one(spark, rows):
    schema = "a int, b int, v string"
    target = spark.createDataFrame([(None, 20, "t"), (None, None, "t")], schema)
    new = spark.createDataFrame([(1, 20, "known by b"), (1, 30, "free"), (None, 40, "null a"), (None, 41, "null a, too"), (5, 50, "first"), (5, 60, "shares a"), (6, 60, "shares b with a refused row"), (6, 60, "shares b with a refused row")], schema)
    assert rows(registry.append_new(target, new, [["a"], ["b"]]), "v") == [("first",), ("free",), ("null a",), ("null a, too",), ("shares b with a refused row",)]
    assert rows(registry.append_new(target, new.limit(0), [["a"], ["b"]])) == []
    assert rows(registry.append_new(target.limit(0), new, [["a", "b"]]), "a", "b") == sorted([(1, 20), (1, 30), (None, 40), (None, 41), (5, 50), (5, 60), (6, 60)], key=repr)


def test_citations_put_in_brackets(spark):
    assert udfs.bracketed("记忆2,3。再见2。{x}5 结束2，", ["2", "2,3", "5"]) == "记忆[2,3]。再见[2]。{x}5 结束2，"
    assert udfs.bracketed("睡眠（a）4-6 与", ["4–6"]) == "睡眠（a）[4–6] 与" and udfs.bracketed("无", []) == "无"
    d = spark.createDataFrame([("研究7。", ["7"]), (None, ["7"]), ("研究7。", None)], "t string, g array<string>")
    assert [r.x for r in d.select(udfs.bracket_citations("t", "g").alias("x")).collect()] == ["研究[7]。", None, "研究7。"]
    assert one(spark, udfs.raised_citations(F.col("x")), x="见[1, 2–4]。") == "见¹,²–⁴。"


def test_block_kinds_and_roles_fit(spark, rows):
    d = spark.createDataFrame([(10.0, 20.0, 9.0, 1, "head", False), (960.0, 990.0, 9.0, 1, "foot", False), (300.0, 320.0, 18.0, 1, "Title", False), (300.0, 320.0, 10.0, 2, "bold " * 40, True), (300.0, 320.0, 10.0, 3, "bold", True)], "top double, bottom double, size double, lines int, text string, bold boolean")
    kind = spatial.block_kind(top=F.col("top"), bottom=F.col("bottom"), page_height=F.lit(1000.0), size=F.col("size"), body_size=F.lit(10.0), lines=F.col("lines"), text=F.col("text"), bold=F.col("bold"), in_table=F.lit(False))
    d = d.withColumn("kind", kind).select("kind", N.text_role(F.col("kind"), F.col("size"), F.lit(10.0), F.col("text")).alias("role"))
    assert [tuple(r) for r in d.collect()] == [("header", "OTHER"), ("footer", "OTHER"), ("title", "TITLE"), ("heading", "H3"), ("paragraph", "BODY")]


def test_reconcile_needs_exactly_one_match(spark, rows):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None)], "k int, v string")
    u = spark.createDataFrame([(1, "z"), (2, "z"), (3, "n"), (4, "q")], "k int, v string")
    new, audit = registry.reconcile(t, u, key="k", fields=["v"], reason="r")
    assert rows(new) == [(1, "z"), (2, "b"), (2, "c"), (3, "n")]
    assert rows(audit) == [(1, "v", "a", "z", "r"), (3, "v", None, "n", "r")]


def test_preferred_wording_keeps_the_old_one(spark, rows):
    r = spark.createDataFrame([("t", "old", "x;y"), ("u", "same", None)], "term_id string, preferred_chinese string, alternative_chinese string")
    c = spark.createDataFrame([("t", "new", "why"), ("u", "same", "why"), ("t", "none", " ")], "term_id string, preferred_chinese string, note string")
    new, events = registry.change_preferred(r, c)
    assert rows(new) == [("t", "new", "x; y; old"), ("u", "same", None)] and rows(events) == [("t", "old", "new", "why")]


def test_stable_numbers_and_ranges(spark, rows):
    items = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c"), ("g", "a")], "kind string, item string")
    old = spark.createDataFrame([("f", "b", 4)], "kind string, item string, no long")
    assert rows(ordered.stable_numbers(items, old, kind="kind", item="item", number="no", order=["item"]), "kind", "item", "no") == [("f", "a", 5), ("f", "b", 4), ("f", "c", 6), ("g", "a", 1)]
    r = ordered.running_ranges(spark.createDataFrame([("x", 1, 2), ("x", 2, 0), ("x", 3, None), ("x", 4, 3)], "g string, o int, n int"), group=["g"], order=["o"], length="n")
    assert rows(r, "o", "first_no", "last_no") == [(1, 1, 2), (2, 3, 2), (3, 3, 2), (4, 3, 5)]


def test_upper_median(spark, rows):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", None), ("c", 5.0), ("c", 5.0)], "g string, v double")
    assert rows(ordered.upper_median_per_group(d, ["g"], "v")) == [("a", 4, 3.0), ("c", 2, 5.0)]
    assert rows(ordered.mode_per_group(d, ["g"], "v")) == [("a", 1.0), ("c", 5.0)]


def test_leading(spark, rows):
    tops = [("ok", t) for t in (10.0, 10.2, 22.1, 34.0)] + [("wide", t) for t in (10.0, 24.0, 38.0)] + [("odd", 10.0), ("odd", 60.0), ("one", 5.0), ("free", 1.0), ("free", 20.0)]
    want = spark.createDataFrame([("ok", 12.0), ("wide", 12.0), ("odd", 12.0), ("one", 12.0)], "f string, l double")
    assert rows(ordered.leading_issues(spark.createDataFrame(tops, "f string, y double"), want, frame="f", at="y", leading="l")) == [("odd", None), ("wide", 14.0)]


def test_owners(spark, rows):
    boxes = spark.createDataFrame([(1, 1, [0.0, 0.0, 100.0, 100.0]), (1, 2, [10.0, 10.0, 50.0, 50.0]), (1, 3, [40.0, 40.0, 80.0, 80.0]), (1, 4, [200.0, 0.0, 210.0, 10.0]), (1, 5, [200.0, 0.0, 210.0, 10.0])], "page int, id int, b array<double>")
    points = spark.createDataFrame([(1, "in2", 20.0, 20.0), (1, "both", 45.0, 45.0), (1, "tie", 205.0, 5.0), (1, "none", 150.0, 0.0), (2, "other", 20.0, 20.0), (1, "null", None, 1.0)], "page int, p string, x double, y double")
    held = spatial.containing(points, boxes, page=["page"], point="p", x="x", y="y", box="id", bounds="b")
    assert rows(spatial.smallest_owner(held, page=["page"])) == [(1, "in2", 2)]
    assert rows(spatial.innermost_owner(held, page=["page"])) == [(1, "in2", 2)]
    assert rows(spatial.owner_counts(held, points, page=["page"], point="p"), "point", "owners") == [("both", 3), ("in2", 2), ("none", 0), ("null", 0), ("other", 0), ("tie", 2)]


def glyphs(*words, size=10.0, font="F"):
    """(word, left, top) as glyphs of 5 points, one page."""
    return [(1, c, x + 5.0 * k, x + 5.0 * k + 5.0, top, top + 10.0, size, font) for word, x, top in words for k, c in enumerate(word)]


def lines_of(spark, rows, g):
    return rows(spatial.glyph_lines(spark.createDataFrame(g, "page int, " + spatial.GLYPHS), page=["page"]), "text", "x0", "top", "peers")


def test_lines_and_blocks(spark, rows):
    g = glyphs(("ab", 0.0, 100.0), ("cd", 14.0, 100.5), ("ef", 0.0, 112.0), ("zz", 0.0, 300.0))
    lines = spatial.glyph_lines(spark.createDataFrame(g, "page int, " + spatial.GLYPHS), page=["page"])
    assert rows(spatial.line_blocks(lines, page=["page"]), "text", "block") == [("ab cd", 1), ("ef", 1), ("zz", 2)]
    assert spatial.glyph_lines(spark.createDataFrame([], "page int, " + spatial.GLYPHS), page=["page"]).count() == 0
    # two columns of a page are two lines of one row
    assert lines_of(spark, rows, glyphs(("left", 0.0, 50.0), ("right", 300.0, 51.0))) == [("left", 0.0, 50.0, 2), ("right", 300.0, 51.0, 2)]


def test_ligatures_find_their_line(spark, rows):
    shifted = glyphs(("af", 0.0, 100.0)) + [(1, "ﬁ", 10.0, 15.0, 104.0, 114.0, 10.0, "F")] + glyphs(("ne", 15.0, 100.0))
    assert lines_of(spark, rows, shifted) == [("affine", 0.0, 100.0, 1)]
    # a ligature that stands alone goes to the nearest line in reach, not to the other column
    apart = glyphs(("one", 0.0, 100.0), ("two", 300.0, 103.0)) + [(1, "ﬀ", 315.5, 323.0, 106.5, 116.5, 10.0, "F")]
    assert [r[0] for r in lines_of(spark, rows, apart)] == ["one", "twoff"]


BLOCK_LINES = "page int, line int, text string, x0 double, x1 double, top double, bottom double, size double, font string, peers int, cell int"


@pytest.mark.parametrize(("second", "same"), [
    ({}, True), ({"top": 119.0}, False), ({"top": 118.0}, True), ({"top": 107.0}, False), ({"x0": 20.0}, False), ({"size": 11.5}, False), ({"size": 11.0}, True), ({"font": "F-Bold"}, False), ({"x0": 0.0, "x1": 30.0}, True),
    ({"x0": 80.0, "x1": 200.0}, False), ({"peers": 3}, False), ({"cell": 1}, False), ({"cell": 1, "first": 1, "peers": 4}, True),
])
def test_what_keeps_lines_apart(spark, rows, second, same):
    one = dict(page=1, line=1, text="a", x0=0.0, x1=100.0, top=100.0, bottom=110.0, size=10.0, font="F", peers=1, cell=second.get("first"))
    two = {**one, "line": 2, "top": 112.0, "bottom": 122.0, "cell": None, **{k: v for k, v in second.items() if k != "first"}}
    got = spatial.line_blocks(spark.createDataFrame([tuple(one.values()), tuple(two.values())], BLOCK_LINES), page=["page"])
    assert (len({r.block for r in got.collect()}) == 1) is same


def test_tables_cells_and_margins(spark, rows):
    lines = spark.createDataFrame([(1, 1, 10.0, 20.0, 10.0, 20.0), (1, 2, 200.0, 210.0, 10.0, 20.0)], "page int, line int, x0 double, x1 double, top double, bottom double")
    cells = spark.createDataFrame([(1, 7, [0.0, 0.0, 100.0, 100.0]), (1, 8, [5.0, 5.0, 30.0, 30.0]), (2, 9, [0.0, 0.0, 500.0, 500.0])], "page int, cell int, bounds array<double>")
    assert rows(spatial.table_cells(lines, cells, page=["page"]), "line", "cell") == [(1, 8), (2, None)]
    t = spark.createDataFrame([(1, "a", False, 2, 2, 0.0, 10.0), (1, "b", True, 5, 5, 0.0, 500.0), (1, "c", False, 1, 9, 0.0, 9.0), (2, "d", False, 1, 2, 0.0, 9.0), (2, "e", True, 1, 3, 0.0, 220.0), (2, "f", True, 9, 3, 0.0, 100.0)], "page int, table_id string, by_text boolean, n_rows int, n_columns int, x0 double, x1 double")
    assert rows(spatial.table_candidates(t, page_width=F.lit(600.0)), "table_id") == [("a",), ("e",)]
    g = [(1, c, 580.0, 590.0, 100.0 + k, 101.0 + k, False, -1.0, 600.0) for k, c in enumerate("doi ")] + [(1, "x", 300.0, 310.0, 1.0, 2.0, False, 1.0, 600.0), (1, "y", 1.0, 5.0, 1.0, 2.0, True, 0.0, 600.0), (1, "L", 2.0, 6.0, 9.0, 10.0, False, 1.0, 600.0)]
    m = spatial.margin_frames(spark.createDataFrame(g, "page int, text string, x0 double, x1 double, top double, bottom double, upright boolean, turn double, width double"), page=["page"], width="width")
    assert rows(m, "side", "rotation", "text", "top", "bottom") == [("left", 90, "L", 9.0, 10.0), ("right", 270, "doi", 100.0, 104.0)]


def test_fragments(spark, rows):
    frag = spark.createDataFrame([(1, "f", 50.0, 55.0, 10.0, 20.0), (1, "far", 0.0, 5.0, 500.0, 510.0)], "page int, fragment string, x0 double, x1 double, top double, bottom double")
    lines = spark.createDataFrame([(1, 1, 0.0, 45.0, 11.0, 21.0), (1, 2, 0.0, 45.0, 14.0, 24.0)], "page int, line int, x0 double, x1 double, top double, bottom double")
    assert rows(spatial.attach_fragments(frag, lines, page=["page"])) == [(1, "f", 1)]


def test_residuals(spark, rows):
    d = spark.createDataFrame([(1, "p", "n = 28", "28 n = 3"), (2, "p", "3 x", "x"), (3, "q", None, "5")], "unit int, page string, s string, t string")
    assert rows(token_compare.numeric_residuals(d, page=["page"], unit="unit", source="s", target="t"), "unit", "token", "missing", "added") == [(3, "5", 0, 1)]
    p = spark.createDataFrame([(1, "译 slow wave sleep 译", "the slow wave sleep phase"), (2, "译", "a b"), (3, "REM", "REM")], "k int, o string, s string")
    assert rows(token_compare.longest_shared_run(p, key="k", output="o", source="s", least=1, allowed=["rem"])) == [(1, 3, "slow wave sleep")]


def test_status(spark, rows):
    d = spark.createDataFrame([(1, "VERIFIED"), (1, "UNKNOWN"), (2, "VERIFIED"), (3, "MISSING"), (3, "CONFLICT")], "g int, s string")
    assert rows(status.reduced(d, ["g"], "s")) == [(1, "UNKNOWN"), (2, "VERIFIED"), (3, "CONFLICT")]
    o = spark.createDataFrame([("k", 1, "VERIFIED"), ("k", 2, "UNKNOWN"), ("k", 3, "UNKNOWN"), ("m", 1, "UNKNOWN")], "k string, o int, s string")
    assert rows(status.latest_known(o, key=["k"], order="o", status="s"), "k", "s", "last_known") == [("k", "UNKNOWN", "VERIFIED"), ("m", "UNKNOWN", None)]
    w = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "title string, md5 string")
    c = spark.createDataFrame([("a", "1"), ("b", None), ("c", "x"), ("e", "1")], "title string, md5 string")
    assert rows(status.plan_attachments(w, c, title="title", digest="md5"), "title", "action") == [("a", "ALREADY_VERIFIED"), ("b", "REUSE_PARTIAL"), ("c", "CONFLICT"), ("d", "NEW")]
    assert rows(status.plan_files(w, c, path="title", digest="md5"), "title", "action") == [("a", "IDENTICAL"), ("b", "CONFLICT"), ("c", "CONFLICT"), ("d", "NEW")]


def test_rules(spark, rows):
    p = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "k int, v array<string>")
    r = spark.createDataFrame([(2, ["a"], "X"), (1, ["b"], "Y"), (3, ["b"], "X")], "ordinal int, any_of array<string>, outcome string")
    assert rows(rules.route(p, r, key="k", values="v")) == [(1, ["Y", "X"]), (2, []), (3, [])]
    assert rows(rules.unknown_values(p, ["a"], key="k", values="v")) == [(1, ["b"])]


def test_checks(spark, rows):
    d = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    c = checks.run_checks(d, [checks.Check("POSITIVE", F.col("v") > 0, F.col("id")), checks.Check("ID", F.col("id") > 0)])
    assert rows(c) == [("ID", True, 0, ""), ("POSITIVE", False, 2, "2")]
    assert rows(checks.report(c, validator="x"), "passed", "n_checks", "n_failed", "first_failure") == [(False, 2, 1, "POSITIVE")]
    assert rows(checks.report(checks.run_checks(d.limit(0), [checks.Check("A", F.col("v") > 0)]), validator="x"), "passed") == [(True,)]


@pytest.mark.parametrize(("args", "p"), [
    (("z", 1.959964, None, None), 0.05), (("t", 2.228139, 10.0, None), 0.05), (("t", 12.7062, 1.0, None), 0.05), (("F", 4.964603, 1.0, 10.0), 0.05), (("F", 1.0, 5.0, 5.0), 0.5), (("chi2", 3.841459, 1.0, None), 0.05),
    (("chi2", 18.307, 10.0, None), 0.05), (("r", 0.422714, 20.0, None), 0.05), (("t", 0.0, 5.0, None), 1.0),
])
def test_tails(args, p):
    from lathework.functions import statistics

    assert statistics.tail(*args) == pytest.approx(p, abs=2e-5)


def test_tails_without_sense():
    from lathework.functions import statistics

    assert [statistics.tail(*a) for a in ((None, 1.0, 1.0, 1.0), ("t", None, 1.0, None), ("t", 1.0, None, None), ("F", 1.0, 1.0, None), ("chi2", -1.0, 1.0, None), ("r", 1.5, 3.0, None), ("other", 1.0, 1.0, 1.0))] == [None] * 7


def test_strict_types(spark):
    values = {"1": True, "0": False, "true": False, '"1"': False, "1.5": False, "null": False}
    for text, ok in values.items():
        assert one(spark, N.is_positive_int(F.parse_json(F.lit(text)))) is ok
    for text, ok in {"1.5": True, "-2": True, "true": False, '"1"': False}.items():
        assert one(spark, N.is_number(F.parse_json(F.lit(text)))) is ok


def test_creators(spark):
    people = spark.createDataFrame([([("A", "B", None, None), (None, None, "Institute", "editor"), ("X", None, None, None)],)], "p array<struct<firstName:string,lastName:string,name:string,creatorType:string>>")
    assert [tuple(x) if x else None for x in people.select(N.creators(F.col("p")).alias("c")).first().c] == [("A", "B", 0, "author"), ("", "Institute", 1, "editor"), None]


def test_funnel(spark, rows):
    d = spark.createDataFrame([("a", 1, 100), ("a", 2, None), ("a", 3, 120), ("b", 1, 5), ("b", 2, 5)], "g string, o int, n int")
    assert rows(ordered.funnel_breaks(d, group=["g"], order="o", n="n")) == [("a", 3, 120, 100)]


def test_term_wording_in_texts(spark, rows):
    terms = spark.createDataFrame(
        [("P1", "Drift Map", "漂移图", "游移图；迁移图; 漂移图", " "), ("P1", "cue", "线索", "提示", "see note"), ("P2", "gain", "增益", None, None), ("P2", None, "无", "游移图", None)],
        "paper_id string, english_term string, preferred_chinese string, alternative_chinese string, context_note string",
    )
    texts = spark.createDataFrame(
        [(1, "P1", "a DRIFT map here"), (2, "P1", "drift map 漂移图 游移图 线索"), (3, "P1", "迁移图 and 提示"), (4, "P1", "gain"), (5, "P2", "Gain, drift map"), (6, "P2", "增益 gain"), (7, "P2", None)],
        "id long, paper_id string, text string",
    )
    got = registry.wording_in_texts(terms, texts, text_id="id", text="text", scope=["paper_id"])
    absent, stray = "PREFERRED_ABSENT", "ALTERNATIVE_WITHOUT_NOTE"
    assert rows(got, "text_id", "english_term", "issue", "wording") == sorted(
        [(1, "Drift Map", absent, None), (2, "Drift Map", stray, "游移图"), (3, "Drift Map", absent, None), (3, "Drift Map", stray, "迁移图"), (3, "cue", absent, None), (5, "gain", absent, None)], key=repr
    )
    assert registry.wording_in_texts(terms.limit(0), texts, text_id="id", text="text").count() == 0


def test_term_wording_in_given_documents(spark, data, rows):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect()]
    reg = spark.read.parquet(f"{data}/terminology_registry.parquet").withColumn("context_note", F.col("notes"))
    want = set()
    for r in reg.collect():
        english, preferred = (r.english_term or "").strip(), (r.preferred_chinese or "").strip()
        others = {a.strip() for a in (r.alternative_chinese or "").replace("；", ";").split(";")} - {""}
        for i, t in docs if english and preferred else []:
            if (english.casefold() in t.casefold() or any(a in t for a in others)) and preferred not in t:
                want.add((i, english, preferred, "PREFERRED_ABSENT", None))
            if not (r.context_note or "").strip():
                want |= {(i, english, preferred, "ALTERNATIVE_WITHOUT_NOTE", a) for a in others - {preferred} if a in t}
    got = registry.wording_in_texts(reg, spark.createDataFrame(docs, "doc_id long, text string"), text_id="doc_id", text="text")
    assert rows(got, "text_id", "english_term", "preferred_chinese", "issue", "wording") == sorted(want, key=repr)


def test_term_choices_compare_the_context(spark, rows):
    reg = spark.createDataFrame(
        [("T1", "Map", "图", "Sleep", "Timing", "prose", "ACTIVE"), ("T2", "map ", "地图", "Social", "", "", None), ("T3", "cue", "线索", "Sleep", "", "", "ACTIVE"), ("T4", "cue", "提示", "Sleep", "", "", "DEPRECATED")],
        "term_id string, english_term string, preferred_chinese string, domain string, subdomain string, context string, status string",
    )
    terms = spark.createDataFrame(
        [("P1", "T1", "map", "图", "sleep ", None, "PROSE"), ("P2", "T1", "map", "图", "Sleep", "timing", None), ("P3", "T2", "MAP", "图", "Sleep", "Timing", "prose"), ("P4", "T3", "cue", "线索", None, None, None), ("P5", "T9", "map", "图", "Sleep", None, None)],
        "paper_id string, term_id string, english_term string, preferred_chinese string, domain string, subdomain string, context string",
    )
    assert rows(registry.term_choices(terms, reg)) == sorted(
        [("P2", "T1", "AMBIGUOUS"), ("P3", "T2", "PREFERRED"), ("P3", "T2", "DOMAIN"), ("P3", "T2", "SUBDOMAIN"), ("P3", "T2", "CONTEXT"), ("P5", "T9", "UNKNOWN")], key=repr
    )


def test_records(spark, rows):
    from lathework.functions import records as R

    meta = spark.createDataFrame([(1, {"title": " T ", "journal": "J", "publicationTitle": " ", "doi": "doi: 10.1/A"}), (2, {"title": "U", "url": "http://x", "DOI": "", "itemType": "book"}), (3, {"title": " "}), (4, None)], "id int, m map<string,string>")
    got = {r.id: r.i for r in meta.select("id", R.item_record(F.col("m")).alias("i")).collect()}
    assert (got[1].title, got[1].publication_title, got[1].doi, got[1].source_uri, got[1].item_type) == ("T", "J", "10.1/a", "https://doi.org/10.1/a", "journalArticle")
    assert (got[2].source_uri, got[2].item_type, got[2].doi) == ("http://x", "book", "") and got[3] is None and got[4] is None
    item = spark.range(1).select(R.attachment_record(F.parse_json(F.lit('{"key": "K", "data": {"title": null, "md5": "AB", "parentItem": "P"}}'))).alias("a")).first().a
    assert (item.key, item.title, item.parent, item.md5, item.filename) == ("K", "", "P", "ab", "")
    p = spark.createDataFrame([("book", None), ("note", None), ("book", "P"), (None, " ")], "t string, p string")
    assert [r.x for r in p.select(R.is_parent_item(F.col("t"), F.col("p")).alias("x")).collect()] == [True, False, False, True]
    for raw, prefix in ((" /users/0/ ", "users/0"), ("groups/12", "groups/12"), ("users/1", None), ("groups/", None), (None, None)):
        assert one(spark, R.library_prefix(F.col("x")), x=raw) == prefix


def test_roles_styles_and_reviews(spark, rows):
    from lathework.functions import records as R

    f = spark.createDataFrame([(None, "body", "TRANSLATE", None, "Abstract: x"), ("H1", "heading", "TRANSLATE", None, ""), ("", "logo", "RETAIN_SOURCE", "FORMULA", ""), (None, "unknown", "RETAIN_SOURCE", "TRADEMARK", None)], "role string, kind string, a string, why string, t string")
    assert rows(f.select(R.frame_role(F.col("role"), F.col("kind")), R.inferred_role(F.col("kind"), F.col("a"), F.col("why"), F.col("t")))) == sorted([("BODY", "ABSTRACT"), ("H1", "H2"), ("OTHER", "FORMULA"), ("OTHER", "OTHER")])
    s = spark.createDataFrame([("body", "ZH-cn"), ("ABSTRACT", "en"), ("H1", None), ("new", "en")], "r string, l string")
    assert [r.x for r in s.select(R.style_name(F.col("r"), F.col("l"), {"H1": "HEADING_1"}).alias("x")).collect()] == ["BODY_ZH", "ABSTRACT_EN", "HEADING_1", "BODY_EN"]
    assert one(spark, R.indent_points(F.lit(2.0), F.lit(10.3333))) == 20.667
    b = spark.createDataFrame([([("A", "x"), ("A", "y"), (None, "x")],)], "b array<struct<stage:string,type:string>>")
    left = lambda **k: [tuple(x) for x in b.select(R.without(F.col("b"), {n: F.lit(v).cast("string") for n, v in k.items()}).alias("r")).first().r]
    assert left(stage="A", type=None) == [(None, "x")] and left(stage="A", type="x") == [("A", "y"), (None, "x")] and len(left(stage=None, type=None)) == 3
    v = spark.createDataFrame([(("NONE", "r", "2024-02-29", "eye"),), (("NONE", "r", "2023-02-29", "eye"),), (("NONE", " ", "2024-02-29", "eye"),), (("SOME", "r", "2024-02-29", "eye"),), (None,)], "v struct<finding:string,reviewer:string,reviewed_date:string,method:string>")
    assert [r.x for r in v.select(R.is_reviewed(F.col("v"), "NONE").alias("x")).collect()] == [True, False, False, False, False]
    c = spark.createDataFrame([(["a"], None, False), ([], [], False), (None, ["u"], True)], "f array<string>, u array<string>, r boolean")
    assert [r.x for r in c.select(R.candidates_pass(F.col("f"), F.col("u"), F.col("r")).alias("x")).collect()] == [False, True, True]


def test_propagation_and_closure(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c")], "from_stage string, to_stage string")
    changed = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "e"), ("r", None)], "k string, stage string")
    assert rows(rules.propagated(changed, edges, key="k", stage="stage", depth=2)) == [("p", "a", 0), ("p", "b", 1), ("p", "c", 1), ("p", "d", 2), ("q", "e", 0), ("r", None, 0)]
    stages = spark.createDataFrame([("p", "a", 1, True), ("p", "b", 2, None), ("p", "c", 3, False), ("q", "a", 1, True)], "k string, s string, o int, done boolean")
    assert rows(rules.first_open(stages, key="k", stage="s", ordinal="o", done=F.col("done"))) == [("p", "b"), ("q", None)]
    assert [one(spark, rules.recency(F.lit(y).cast("int"), F.lit(2026))) for y in (2024, 2021, 2020, None)] == ["CURRENT", "RECENT_SUPPORT", "FOUNDATIONAL", None]


def test_evidence_is_added_once_and_whole(spark, rows):
    schema = "evidence_id string, event_type string, verified_date string, supports array<string>, roles array<string>"
    log = spark.createDataFrame([("TERMEV-0001", None, None, None, None), ("TERMEV-0002", "DEPRECATE", None, None, None)], schema)
    new = [("TERMEV-0001", "ADD", "2024-01-01", ["a"], ["r"]), ("TERMEV-0002", "ADD", "2024-01-01", ["a"], ["r"]), ("TERMEV-0002", "ADD", "2024-01-01", ["b"], ["r"]), ("X", "ADD", "2024-01-01", ["a"], ["r"]), (None, "ADD", "2024-01-01", ["a"], ["r"]),
           ("TERMEV-0003", "ADD", "2024-13-01", ["a"], ["r"]), ("TERMEV-0004", "ADD", "2024-01-01", [" "], ["r"]), ("TERMEV-0005", "ADD", "2024-01-01", ["a"], None)]
    accepted, refused = registry.add_evidence(log, spark.createDataFrame(new, schema))
    assert rows(accepted, "evidence_id", "supports") == [("TERMEV-0002", ["a"])]
    assert rows(refused, "evidence_id", "problem") == sorted([("TERMEV-0001", "KNOWN"), ("X", "ID"), (None, "ID"), ("TERMEV-0003", "DATE"), ("TERMEV-0004", "SUPPORTS"), ("TERMEV-0005", "ROLES")], key=repr)


def test_migrations(spark, rows):
    old = spark.createDataFrame([("a", "1")], "Discipline string, Term string")
    assert registry.renamed_schema(old, {"Discipline": "Domain", "Absent": "X"}, {"Context": F.lit(""), "Term": F.lit("no")}).collect()[0].asDict() == {"Domain": "a", "Term": "1", "Context": ""}
    f = spark.createDataFrame([("F1", "body", "TRANSLATE", None, "x"), ("F2", "reference", "RETAIN_SOURCE", "REFERENCE_ENTRY", "y")], "frame_id string, kind string, translation_action string, retain_reason string, source_text string")
    frames, ledger = registry.exact_migration(f, spark.createDataFrame([("U1", "F1"), ("U2", "F2"), ("U3", None)], "unit_id string, frame_id string"))
    assert rows(frames, "frame_id", "role", "translatable", "preserve_english", "replacement_status") == [("F1", "BODY", True, False, "TRANSLATED"), ("F2", "REFERENCE", False, True, "INTENTIONAL_PRESERVE")]
    assert rows(ledger, "unit_id", "frame_id") == [("U1", "F1")]


def test_small_text_functions(spark, rows):
    assert one(spark, N.latin_runs(F.col("x"), ["the"]), x="甲 the slow wave sleep phase 乙 the the the the") == ["the slow wave sleep phase"]
    assert one(spark, N.loose(F.col("x")), x="**A**\u200b b_C#") == "abc"
    assert one(spark, N.latin_words(F.col("x")), x="REM is NREM and REM's a ab") == ["NREM", "REM", "REM's", "and"]
    assert one(spark, N.box_area(F.col("b")), b=[0.0, 0.0, 2.0, 3.0]) == 6.0 and one(spark, N.box_area(F.col("b")), b=[2.0, 0.0, 0.0, 3.0]) == 0.0
    assert one(spark, N.box_contains(F.col("a"), F.col("b")), a=[0.0, 0.0, 10.0, 10.0], b=[-0.25, 0.0, 10.2, 9.0]) is True
    assert one(spark, N.same_column(F.col("a"), F.col("b"), F.lit(100.0)), a=[0.0, 0.0, 10.0, 1.0], b=[9.0, 0.0, 19.0, 1.0]) is False
    assert one(spark, N.append_note(F.col("a"), F.col("b")), a=" x ", b="y") == "x | y" and one(spark, N.append_note(F.col("a"), F.col("b")), a=None, b="y") == "y"
    assert one(spark, N.first_filled(F.col("a"), F.col("b")), a=" ", b=" y ") == "y" and one(spark, N.quantize(F.lit(0.375), 0.25)) == 0.5
    assert one(spark, N.same_filename(F.col("a"), F.col("b")), a="a+b.pdf", b="a b.pdf") is True and one(spark, N.is_substantive(F.col("x")), x="It works.") is True and one(spark, N.is_substantive(F.col("x")), x="12.") is False
    assert one(spark, N.marks_found(F.col("x"), r"[A-Z]+-\d+"), x="AUD-1 and AUD-1") == ["AUD-1"]
    assert one(spark, N.citation_payload(F.col("x")), x="1; 2 — 4") == "1,2–4" and one(spark, N.mapped(F.col("x"), {"a": "b"}, "z"), x="q") == "z"
    assert one(spark, status.same_bytes(F.col("a"), F.col("b")), a="x\r\ny", b="x\ny") is True
    assert one(spark, status.three_valued([F.lit(True), F.lit(None).cast("boolean")])) == "UNKNOWN" and one(spark, status.three_valued([F.lit(None).cast("boolean"), F.lit(False)])) == "CONFLICT"
    t = spark.createDataFrame([("u", [("SWS", "name", ["slow"]), ("x", " ", ["y"])])], "u string, t array<struct<text:string,reason:string,aliases:array<string>>>")
    assert rows(token_compare.allowed_words(t, tokens="t", aliases="aliases", base=["The"])) == [("slow",), ("sws",), ("the",)]
    c = spark.createDataFrame([("c", "1", "a"), ("c", "2", "b"), ("d", "1", "a"), ("d", "2", "a")], "k string, s string, t string")
    assert rows(token_compare.distinct_value_conflicts(c, key="k", source=F.col("s"), target=F.col("t")), "k", "passed") == [("c", True), ("d", False)]
    assert one(spark, token_compare.residual_words(F.lit("slow wave"), F.lit("wave"), F.lit("s l o w"), F.array(F.lit("x")))) == ["slow"]
