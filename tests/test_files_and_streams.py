import json

import pytest
from pyspark.sql import functions as F

from lathework.sources import readers, sinks
from lathework.streaming import stateful


def test_fixed_csv(spark, tmp_path, rows):
    f = tmp_path / "a.csv"
    f.write_text('﻿A,B\n1,\n"x ""y""\nz",2\n', encoding="utf-8")
    assert rows(readers.fixed_csv(spark, str(f), ["A", "B"])) == [("1", ""), ('x "y"\nz', "2")]
    with pytest.raises(readers.HeaderError):
        readers.fixed_csv(spark, str(f), ["B", "A"])


def test_versioned_csv(spark, tmp_path, rows):
    f = tmp_path / "old.csv"
    f.write_text("Term_ID,Discipline\nT1,d\n")
    versions = [(["Term_ID", "Domain", "Usage_Count"], {}), (["Term_ID", "Discipline"], {"Domain": F.col("Discipline"), "Usage_Count": F.lit("0")})]
    assert rows(readers.versioned_csv(spark, str(f), versions)) == [("T1", "d", "0")]


def test_jsonl_keeps_line_numbers_and_bad_lines(spark, tmp_path, rows):
    f = tmp_path / "a.jsonl"
    f.write_text('﻿{"a":1}\n\n[1,2]\n{"a":\n', encoding="utf-8")
    assert rows(readers.jsonl(spark, str(f), "a int"), "seq", "valid") == [(1, True), (3, False), (4, False)]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), required=False).count() == 0


def test_documents_and_words(spark, tmp_path, rows):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.yaml").write_text(json.dumps({"paper_id": "p", "other": {"x": 1}}))
    assert rows(readers.documents(spark, [str(tmp_path / "d")], "paper_id string").select("record.paper_id", F.variant_get("raw", "$.other.x", "int").alias("x"))) == [("p", 1)]
    (tmp_path / "o.tsv").write_text("conf\ttext\n90\tgood\n10\tbad\nxx\tnone\n70\tedge\n")
    assert rows(readers.delimited_words(spark, str(tmp_path / "o.tsv")), "text") == [("good edge",)]


def test_markdown(spark, rows):
    d = spark.createDataFrame([("f", "x\n## A\n1\n## B\n2\n## A\n3\n| a | b |\n|---|:-:|\n| c\\|d | e |\n")], "file string, value string")
    assert rows(readers.markdown_sections(d, key="file", value="value"), "section", "body")[1] == ("B", "2")
    assert rows(readers.pipe_tables(d, cells=2), "cells") == [(["a", "b"],), (["c\\|d", "e"],)]
    assert d.select(readers.section_body(F.col("value"), "B")).first()[0].strip() == "2"


def test_html(spark, rows):
    d = spark.createDataFrame([("f", "intro<hr>2024-01-02 <a href='u'>t</a><hr>no date")], "file string, value string")
    assert rows(readers.html_entries(d, key="file", value="value", marker="<hr>"), "seq", "stamp", "links", "text") == [(1, "2024-01-02", ["u"], "2024-01-02 t"), (2, "", [], "no date")]


def test_binaries_and_docx(spark, tmp_path, rows):
    import zipfile

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "e.pdf").write_bytes(b"")
    (tmp_path / "b" / "x.txt").write_bytes(b"abc")
    assert rows(readers.file_descriptors(readers.binaries(spark, str(tmp_path / "b"))), "filename", "content_type", "problem", "size_bytes") == [("x.txt", "text/plain", "", 3)]
    landed = spark.createDataFrame([("a/e.pdf", 0), ("a/big.mp4", 300 << 20)], "file string, size_bytes long")
    assert rows(readers.file_descriptors(landed), "filename", "content_type", "problem") == [("big.mp4", "video/mp4", "TOO_LARGE"), ("e.pdf", "application/pdf", "EMPTY")]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/></w:document>')
    assert rows(readers.docx_text(spark, str(tmp_path / "d.docx")), "text") == [("ab\n",)]


def test_replace_may_read_what_it_replaces(spark, tmp_path, rows):
    path = "file://" + str(tmp_path / "t")
    sinks.replace(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    sinks.replace(spark.read.parquet(path).withColumn("k", F.col("k") + 1), path)
    assert rows(spark.read.parquet(path)) == [(2, "a")]
    sinks.append_guarded(spark.createDataFrame([(2, "z"), (3, "b"), (3, "b")], "k int, v string"), path, [["k"]])
    assert rows(spark.read.parquet(path)) == [(2, "a"), (3, "b")]
    assert len(list(tmp_path.iterdir())) == 1


def test_csv_and_reports(spark, tmp_path, rows):
    path = "file://" + str(tmp_path / "c")
    sinks.replace_csv(spark.createDataFrame([(1, None), (2, 'q"x')], "k int, v string"), path)
    assert rows(readers.fixed_csv(spark, path, ["k", "v"])) == [("1", ""), ("2", 'q"x')]
    sinks.write_observations(spark.createDataFrame([("ok-1", 1), ("../x", 2)], "paper_id string, v int"), str(tmp_path / "o"), parts=["paper_id"])
    assert rows(spark.read.json(str(tmp_path / "o")), "v") == [(1,)]


def test_overview_is_written_in_order(spark, tmp_path, rows):
    d = spark.createDataFrame([("W34", "b", None), ("W33", "z", "1"), ("W34", "B", "x|y")], "week string, title string, v string").repartition(3)
    sinks.write_table_and_text(d, "file://" + str(tmp_path / "o"), order=["week", "title"])
    assert [r.value for r in spark.read.text(str(tmp_path / "o" / "markdown")).collect()] == ["| W33 | z | 1 |", "| W34 | B | x\\|y |", "| W34 | b |  |"]
    assert [r.value for r in spark.read.text(str(tmp_path / "o" / "csv")).collect()][1:] == ["W33,z,1", "W34,B,x|y", 'W34,b,""']
    sinks.append_events(spark.createDataFrame([(1,)], "k int"), str(tmp_path / "e"))
    sinks.append_events(spark.createDataFrame([(2,)], "k int"), str(tmp_path / "e"))
    assert rows(spark.read.json(str(tmp_path / "e"))) == [(1,), (2,)]
    sinks.export(d, str(tmp_path / "x"), format="json")
    sinks.replace_jsonl(d.limit(0), "file://" + str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "x")).count() == 3 and spark.read.text(str(tmp_path / "j")).count() == 0
    sinks.export(spark.createDataFrame([("A",), ("B",)], "status string"), str(tmp_path / "s"), format="json", status=["A"])
    assert rows(spark.read.json(str(tmp_path / "s"))) == [("A",)]


N = None
EVENTS = [
    ("A", 2, N, ["x"], ["x"], N, N), ("A", 1, "DEPRECATE", N, N, N, N), ("A", 3, "UPDATE_SUPPORTS", ["y"], ["y"], ["r"], N), ("A", 4, "UPDATE_SUPPORTS", N, ["lost"], N, N), ("B", 5, "ADD", ["p"], N, N, "OLD"), ("C", 6, "DEPRECATE", N, N, N, N),
    ("D", 7, "ADD", ["z"], N, N, N), ("D", 8, "DEPRECATE", N, N, N, N), ("B", 9, "UNLINK", N, N, N, N), ("D", 10, "UPDATE_SUPPORTS", ["w"], N, N, N),
]
EVENT = "id string, seq long, kind string, supports array<string>, reported_terms array<string>, roles array<string>, status string"


def test_streamed_fold_equals_batch_over_several_batches(spark, tmp_path, rows):
    from lathework.operators import registry

    log = spark.createDataFrame(EVENTS, EVENT).withColumn("new", F.col("supports"))
    batch = registry.evidence_state(log, key=F.col("id"), target=F.col("id"), kind="kind", order="seq", payload=[], updates={"supports": "new", "reported_terms": "reported_terms", "roles": "roles"}, guard="new")
    got = {}

    def keep(df, n):
        got.update({r.id: (r.id, r.supports, r.reported_terms, r.roles, r.state) for r in df.orderBy("seq").collect()})

    for i, part in enumerate((EVENTS[:3], EVENTS[3:], EVENTS[:2])):  # the last part repeats old events
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = stateful.fold_evidence(spark.readStream.schema(EVENT).json(str(tmp_path / "in")))
        out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        if i == 1:
            assert sorted(got.values()) == rows(batch) == [("A", ["y"], ["y"], ["r"], "ACTIVE"), ("B", ["p"], None, None, "OLD"), ("D", ["w"], None, None, "DEPRECATED")]
            got.clear()
    assert got == {}


def test_streamed_chains_and_carry(spark, tmp_path, rows):
    c = [("p", 1, "a", "b"), ("p", 2, "b", "c"), ("p", 3, "x", "d"), ("q", 4, "m", "m")]
    spark.createDataFrame(c, "key string, seq long, old string, new string").coalesce(1).write.json(str(tmp_path / "c"))
    s = stateful.check_chains(spark.readStream.schema("key string, seq long, old string, new string").json(str(tmp_path / "c")))
    assert rows(stateful.run_to_memory(s, "chains", mode="append", checkpoint=str(tmp_path / "cp1"))) == [("p", 3, "c", "x", "d"), ("q", 4, None, "m", "m")]
    o = [("k", 1, "VERIFIED"), ("k", 2, "UNKNOWN"), ("m", 1, "UNKNOWN")]
    spark.createDataFrame(o, "key string, seq long, status string").coalesce(1).write.json(str(tmp_path / "o"))
    s = stateful.last_known(spark.readStream.schema("key string, seq long, status string").json(str(tmp_path / "o")))
    assert rows(stateful.run_to_memory(s, "known", mode="update", checkpoint=str(tmp_path / "cp2"))) == [("k", 2, "UNKNOWN", "VERIFIED"), ("m", 1, "UNKNOWN", None)]
