"""Readers with strict contracts on top of Spark's file sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip


class HeaderError(ValueError):
    """A file's header is not the expected one."""


def _header(spark: SparkSession, path: str, separator: str) -> list[str]:
    line = spark.read.text(path).limit(1).collect()
    if not line:
        raise HeaderError(f"{path}: no header")
    return [h.strip().strip('"') for h in line[0][0].lstrip("\ufeff").rstrip("\r").split(separator)]


def fixed_csv(spark: SparkSession, path: str, fields: Sequence[str], *, separator: str = ",") -> DataFrame:
    """CSV with exactly this header in this order; every value stays a string, an empty field is ''. A byte order mark is tolerated."""
    got = _header(spark, path, separator)
    if got != list(fields):
        raise HeaderError(f"{path}: expected {list(fields)}, got {got}")
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def versioned_csv(spark: SparkSession, path: str, versions: Sequence[tuple[Sequence[str], Mapping[str, Column]]]) -> DataFrame:
    """CSV in any of several known headers, read as the first one.

    ``versions`` holds (header, columns of the first version by name as expressions over this header); the first one needs none.
    """
    got = _header(spark, path, ",")
    current = list(versions[0][0])
    for header, upgrade in versions:
        if got == list(header):
            df = fixed_csv(spark, path, header)
            return df.select(*[upgrade[c].alias(c) if c in upgrade else F.col(c) if c in header else F.lit("").alias(c) for c in current])
    raise HeaderError(f"{path}: unknown header {got}")


def jsonl(spark: SparkSession, path: str, schema: str | None = None, *, required: bool = True) -> DataFrame:
    """Lines of JSON objects with their place: (file, seq, value, valid, [record]).

    Blank lines are skipped, seq is the line number of the file from 1. ``valid`` is false for anything that is no JSON object;
    nothing is thrown away. An absent optional file is an empty relation.
    """
    empty = "file string, seq bigint, value string, valid boolean" + (f", record struct<{_as_struct(schema)}>" if schema else "")
    if not required and not _exists(spark, path):
        return spark.createDataFrame([], empty)
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n")).alias("p", "value"))
    lines = lines.where(F.trim("value") != "").select("file", (F.col("p") + 1).cast("bigint").alias("seq"), "value")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    lines = lines.withColumn("valid", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    return lines.withColumn("record", F.from_json("value", schema)) if schema else lines


def _as_struct(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (f.strip().split(" ", 1) for f in schema.split(",")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """JSON documents, one a file: (file, record, raw). ``raw`` is the whole document as a variant, so that unknown fields survive."""
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return text.select("file", F.from_json("value", schema).alias("record"), F.try_parse_json("value").alias("raw"))


def delimited_words(spark: SparkSession, path: str, *, least: float = 70.0) -> DataFrame:
    """Words of OCR tables (tab-separated, columns text and conf) of at least this confidence: (file, text). A confidence that is no number is -1."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path).withColumn("file", F.col("_metadata.file_path")).withColumn("_i", F.monotonically_increasing_id())
    kept = df.where((F.trim("text") != "") & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) >= least))
    return kept.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.trim("text").alias("t")))), lambda s: s["t"]), " ").alias("text"))


def pipe_tables(text: DataFrame, *, cells: int, key: str = "file", value: str = "value") -> DataFrame:
    """(key, seq, cells): rows of Markdown pipe tables with exactly this many cells, separator rows left out."""
    lines = text.select(key, F.posexplode(F.split(value, "\r?\n")).alias("p", "line")).where(F.trim("line").startswith("|"))
    parts = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    rows = lines.select(key, (F.col("p") + 1).cast("bigint").alias("seq"), parts.alias("cells"))
    return rows.where((F.size("cells") == cells) & ~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))


def markdown_sections(text: DataFrame, *, key: str, value: str, level: int = 2) -> DataFrame:
    """(key, section, body): the text under each heading of this level; repeated headings are put together in order, text before the first is left out."""
    lines = text.select(key, F.posexplode(F.split(value, "\r?\n")).alias("p", "line"))
    heading = F.regexp_extract("line", rf"^#{{{level}}}\s+(.+?)\s*$", 1)
    w = Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_h", F.nullif(heading, F.lit(""))).withColumn("section", F.last("_h", ignorenulls=True).over(w)).where("section IS NOT NULL AND _h IS NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy(key, "section").agg(F.trim(body).alias("body"))


def section_body(markdown: Column, name: str) -> Column:
    """The text under one level-2 heading, up to the next heading of level 1 or 2; '' if absent."""
    return F.regexp_extract(markdown, rf"(?ms)^##\s+{name}\s*$(.*?)(?=^#{{1,2}}\s+|\z)", 1)


def find_section(sections: Column, aliases: Sequence[str]) -> Column:
    """The body of the first section (map column) whose name contains an alias, case ignored; null if none."""
    names = F.array(*[F.lit(a.lower()) for a in aliases])
    return F.get(F.filter(F.map_entries(sections), lambda e: F.exists(names, lambda a: F.contains(F.lower(e["key"]), a))), F.lit(0))["value"]


def html_links(html: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, seq, href): all link targets of a page in order."""
    return html.select(key, F.posexplode(F.regexp_extract_all(value, F.lit("(?i)href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("p", "href")).select(key, (F.col("p") + 1).cast("bigint").alias("seq"), "href")


def html_entries(html: DataFrame, *, key: str, value: str, marker: str) -> DataFrame:
    """(key, seq, stamp, links, text): one entry per part of a page between marker patterns; the part before the first marker is none."""
    parts = html.select(key, F.posexplode(F.split(value, marker)).alias("seq", "part")).where("seq > 0")
    stamp = F.regexp_extract("part", r"(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1)
    links = F.regexp_extract_all("part", F.lit("(?i)href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return parts.select(key, F.col("seq").cast("bigint").alias("seq"), stamp.alias("stamp"), links.alias("links"), F.trim(F.regexp_replace(F.regexp_replace("part", "<[^>]*>", " "), r"\s+", " ")).alias("text"))


def binaries(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """(file, size_bytes, sha256, md5, modified_ms) of files. Contents are hashed where they are read and go no further.

    Spark's file sources pass over files of zero bytes: compare with a list of wanted names to see them missing.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return df.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.unix_millis("modificationTime").alias("modified_ms"))


# fixed values: content types by file ending
CONTENT_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "mp4": "video/mp4"}


def file_descriptors(files: DataFrame, *, most_bytes: int = 256 << 20) -> DataFrame:
    """``files`` (of binaries()) with filename, content_type and problem ('' , EMPTY or TOO_LARGE)."""
    ending = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    problem = F.when(F.col("size_bytes") == 0, "EMPTY").when(F.col("size_bytes") > most_bytes, "TOO_LARGE").otherwise("")
    return files.withColumns({"filename": F.regexp_extract("file", r"([^/]+)$", 1), "content_type": F.coalesce(F.element_at(kinds, ending), F.lit("application/octet-stream")), "problem": problem})


def docx_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of DOCX files: paragraphs by line, their runs put together."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    @F.pandas_udf(T.StringType())
    def text(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
            except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                return None
            return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), text("content").alias("text"))


def xml_text(c: Column) -> Column:
    """All text of an XML document, tags removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def aliased(df: DataFrame, aliases: Mapping[str, Sequence[str]], *, required: Sequence[str] = ()) -> DataFrame:
    """Canonical columns from alias columns that exist (first filled one, trimmed, '' if none) and ``problem``: required fields left blank."""
    out = {c: F.coalesce(*[F.nullif(strip(F.col(f"`{a}`")), F.lit("")) for a in names if a in df.columns], F.lit("")) for c, names in aliases.items()}
    d = df.select(*[e.alias(c) for c, e in out.items()])
    blank = F.filter(F.array(*[F.when(F.col(r) == "", F.lit(r)) for r in required]), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    return d.withColumn("problem", F.array_join(blank, ","))


def ledger_text(rows: DataFrame, *, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(group, text): the first filled of the columns per row, in order, one a line; groups without text are left out."""
    d = rows.withColumn("_t", F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in columns])).where("_t IS NOT NULL")
    return d.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda s: s["_t"]), "\n").alias("text"))
