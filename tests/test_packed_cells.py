import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lathework.operators import packed_cells as P

TEXT, IDS = P._separators_of("text"), P._separators_of("ids")


def split(cell, separators=TEXT):
    """A cell that the dictionary has learned from."""
    return P.split_cell(cell, separators, P.Automaton(P.protected_values(cell or "", separators)))


@pytest.mark.parametrize(("cell", "items"), [
    ("a;b，c、d|e／f\ng", list("abcdefg")), ("；；a；；", ["a"]), ("“x,y”、z", ["x,y", "z"]), ('"say ""x;y"" now"; b', ['say "x;y" now', "b"]), ("f(N1, N2) / g", ["f(N1, N2)", "g"]),
    ("词（狭义，旧译）；后", ["词（狭义，旧译）", "后"]), ('["a;b", "", null, 3, " c "]', ["a;b", "3", "c"]), ('所谓"a;b"现象; c', ['所谓"a;b"现象', "c"]), ('"a"', ["a"]), ('""', []), ("  ", []), (None, []),
    ("a; a", ["a", "a"]), ("((a;b);c);d", ["((a;b);c)", "d"]), ("[not json; x", ["[not json", "x"]),
])
def test_cells(cell, items):
    assert split(cell) == items


def test_without_the_dictionary_every_separator_cuts():
    assert P.split_cell("词（狭义，旧译）；后", TEXT) == ["词（狭义", "旧译）", "后"]
    assert P.split_cell("AC/DC; x", TEXT) == ["AC", "DC", "x"]
    assert P.split_cell("AC/DC; x", TEXT, P.Automaton(["AC/DC"])) == ["AC/DC", "x"]
    assert P.split_cell("a/b/c", TEXT, P.Automaton({"a/b": 1, "b/c": 9})) == ["a", "b/c"]
    assert P.split_cell("xAC/DC; AC/DCx", TEXT, P.Automaton(["AC/DC"])) == ["xAC", "DC", "AC", "DCx"]


def test_blanks_separate_ids_only():
    assert P.split_cell("A-1 B-2\tC-3", IDS) == ["A-1", "B-2", "C-3"]
    assert P.split_cell("two words; x", TEXT) == ["two words", "x"]


def test_open_marks_are_cut_and_known_values_kept():
    assert P.split_cell('"a; b', TEXT) == ['"a', "b"]
    assert P.split_cell("x (a; b", TEXT) == ["x (a", "b"]
    assert P.split_cell('"x; foo,bar; b', TEXT, P.Automaton(["foo,bar"])) == ['"x', "foo,bar", "b"]
    assert P.split_cell("a) b; c", TEXT) == ["a) b", "c"]


def test_long_cells_take_linear_time():
    assert len(P.split_cell(";".join("v%d" % i for i in range(200_000)), TEXT)) == 200_000
    assert len(P.split_cell("(" + ";".join("v%d" % i for i in range(2_000)), TEXT)) == 2_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab ;,"、(', min_size=1, max_size=6), min_size=1, max_size=5))
def test_quoted_values_round_trip(values):
    kept = [v.strip() for v in values if v.strip()]
    assert split(" ; ".join('"' + v.replace('"', '""') + '"' for v in values)) == kept


def cells(spark, data):
    return spark.createDataFrame(data, "row_id long, field_name string, kind string, cell string, pos_no int, item_text string")


DATA = [(1, "f", "text", "a；“b,c”", 0, ""), (1, "f", "text", "a；“b,c”", 0, ""), (2, "f", "ids", "X Y", 0, ""), (3, "f", "text", None, 0, ""), (4, "f", "text", '"open; “b,c”', 0, ""), (5, "f", "text", "k/l; m", 0, "")]


def test_split_values_and_joined_dictionary_agree(spark, rows):
    whole = rows(P.split_values(cells(spark, DATA)))
    assert whole == sorted([(1, "f", 1, "a"), (1, "f", 2, "b,c")] * 2 + [(2, "f", 1, "X"), (2, "f", 2, "Y"), (4, "f", 1, '"open'), (4, "f", 2, "b,c"), (5, "f", 1, "k"), (5, "f", 2, "l"), (5, "f", 3, "m")])
    own = spark.createDataFrame([("text", "k/l"), ("text", "zz"), ("text", "")], "kind string, value string")
    for known in (None, own):
        assert rows(P.split_values(cells(spark, DATA[1:]), known=known, max_dictionary_bytes=1)) == rows(P.split_values(cells(spark, DATA[1:]), known=known))
    assert (5, "f", 1, "k/l") in rows(P.split_values(cells(spark, DATA), known=own))
    assert rows(P.split_values(cells(spark, []))) == []


def test_the_dictionary_decides(spark, rows):
    assert rows(P.decided_cells(cells(spark, DATA[1:]))) == [(1, "f", True), (2, "f", False), (4, "f", True), (5, "f", False)]
    assert rows(P.learn_dictionary(cells(spark, DATA[:3]))) == [("text", "“b,c”", 2)]
