import json

import pytest

from lathework.operators import nested_records as R
from lathework.plans import core_queries


def found(spark, rows, tmp_path, bodies):
    d = [(i, "p", b if isinstance(b, str) or b is None else json.dumps(b), "clash") for i, b in bodies]
    spark.createDataFrame(d, "map_id long, paper_id string, body string, node_type string").write.mode("overwrite").parquet(f"{tmp_path}/c_source_map.parquet")
    return rows(core_queries.p3_found(spark, str(tmp_path)))


def brute(body):
    """The rows of one body of the plain layout, by nested loops."""
    out, as_list = [], lambda v: [] if v is None else v if isinstance(v, list) else [v]
    for pn, p in enumerate(as_list(body.get("paragraphs")), 1):
        head = (pn, R.as_written(p.get("paragraph_index")))
        claims = as_list(p.get("claims"))
        for cn, c in enumerate(claims, 1):
            anchors = as_list(c.get("source_anchor"))
            mid = (cn, R.as_written(c.get("source_class")))
            out += [(*head, *mid, an, a if isinstance(a, str) else R.as_written(a.get("section"))) for an, a in enumerate(anchors, 1)] or [(*head, *mid, 0, "")]
        if not claims:
            out.append((*head, 0, "", 0, ""))
    return out


PLAIN = {"paragraphs": [
    {"paragraph_index": 7, "claims": [{"source_class": "MAIN", "source_anchor": ["a", {"section": "s"}, {"section": None}, {}]}, {"source_anchor": None}, {}]},
    {"paragraph_index": "8", "claims": {"source_class": None, "source_anchor": {"section": "one"}}, "extra": {"seen": [1, {"by": "x"}]}}, {}, {"paragraph_index": None, "claims": []},
]}


def test_layouts(spark, rows, tmp_path):
    want = [(1, *r) for r in brute(PLAIN)]
    for body in (PLAIN, {"review": PLAIN}, {"paragraphs": json.dumps(PLAIN["paragraphs"])}, {"sections": [{"paragraphs": PLAIN["paragraphs"][:1]}, {"paragraphs": PLAIN["paragraphs"][1:]}]}):
        assert found(spark, rows, tmp_path, [(1, body)]) == sorted(want, key=repr)


def test_repeats_broken_and_empty(spark, rows, tmp_path):
    one = {"paragraphs": {"paragraph_index": 1}}
    assert found(spark, rows, tmp_path, [(1, one), (1, one), (2, json.dumps(one)[:-1]), (3, None), (4, ""), (5, "[]"), (6, "3"), (7, {"paragraphs": "text"})]) == [(1, 1, "1", 0, "", 0, ""), (7, 1, "", 0, "", 0, "")]
    assert found(spark, rows, tmp_path, [(9, "")]) == []


def test_intervals_contain_descendants():
    nodes = R.label_nodes(PLAIN, R.SOURCE_MAP)
    assert len({n[2] for n in nodes}) == len(nodes) == 4 + 4 + 5
    inside = {n[0]: sum(p[1] < n[1] and p[2] > n[2] for p in nodes) for n in nodes}
    assert inside == {"paragraph": 0, "claim": 1, "anchor": 2}


def test_a_record_nested_in_its_own_type_hides_the_outer_one_only_while_open(spark, rows, tmp_path):
    body = {"paragraphs": [{"paragraph_index": 1, "more": {"paragraphs": {"paragraph_index": "in"}}, "claims": [{"source_class": "M", "source_anchor": ["a"]}]}]}
    assert found(spark, rows, tmp_path, [(1, body)]) == [(1, 1, "1", 1, "M", 1, "a"), (1, 2, "in", 0, "", 0, "")]
    linked = R.link_by_containment(R.label_nodes(body, R.SOURCE_MAP), ["paragraph", "claim", "anchor"])
    assert [(n[0], [a[4] for a in up], leaf) for n, up, leaf in linked] == [("paragraph", [], False), ("paragraph", [], True), ("claim", [1], False), ("anchor", [1, 1], True)]


def test_deep_bodies_are_read_whole(spark, rows, tmp_path):
    empty = '{"x":' * 50000 + "1" + "}" * 50000
    held = '{"x":' * 50000 + '{"paragraphs":[{"paragraph_index":"deep"}]}' + "}" * 50000
    assert found(spark, rows, tmp_path, [(1, empty), (2, PLAIN), (3, held), (4, held[:-1])]) == sorted([(2, *r) for r in brute(PLAIN)] + [(3, 1, "deep", 0, "", 0, "")], key=repr)


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\n\\u00e9", {}, [], null, true], "b": {"c": {"d": [[]]}}}', "[]", " 3 ", '"x"', "[1,]", "[1", "{", '{"a"}', '{"a":1,}', "[1 2]", "[] x", "", "[,1]", '{"a":}', "{1:2}", "]", "nul"])
def test_the_parser_for_deep_texts_agrees_with_the_standard_one(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            R._parse_deep(text)
    else:
        assert R._parse_deep(text) == want


@pytest.mark.parametrize(("name", "n"), [("p3_paragraphs", 4), ("p3_claims", 4), ("p3_anchors", 5)])
def test_tables(spark, tmp_path, rows, name, n):
    found(spark, rows, tmp_path, [(1, PLAIN), (1, PLAIN)])
    assert core_queries.QUERIES[name](spark, str(tmp_path)).count() == n
