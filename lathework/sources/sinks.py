"""Writers: staged replacement, guarded appends, reports and exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import append_new
from ..operators.status import markdown_table


def _paths(df: DataFrame, path: str):  # noqa: ANN202
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def replace(df: DataFrame, path: str, *, format: str = "parquet", **options: str) -> None:  # noqa: A002
    """Write beside ``path`` and move into place, so that readers find the old or the new table and a failed write changes nothing.

    The old one is moved away first and dropped last; if the move fails it is put back. ``df`` may read from ``path``.
    """
    fs, target, make = _paths(df, path)
    staged, old = make(f"{path}.staged-{uuid.uuid4().hex}"), make(f"{path}.old-{uuid.uuid4().hex}")
    df.write.format(format).options(**options).save(staged.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot put {path} in place")
    if had:
        fs.delete(old, True)


def replace_csv(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    """One CSV file with header, all values as text, replaced as a whole (for registries that people edit); in the order of code points of ``order``, if given."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).coalesce(1)
    replace(text.sortWithinPartitions(*order) if order else text, path, format="csv", header="true", escape='"')


def replace_jsonl(df: DataFrame, path: str) -> None:
    replace(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")), path, format="text")


def append_guarded(df: DataFrame, path: str, keys: Sequence[Sequence[str]], *, format: str = "parquet") -> None:  # noqa: A002
    """Append the rows that the table at ``path`` does not know under any of the keys."""
    target = df.sparkSession.read.schema(df.schema).format(format).load(path)
    append_new(target, df, keys).write.mode("append").format(format).save(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export(df: DataFrame, path: str, *, format: str, status: Sequence[str] | None = None) -> None:  # noqa: A002
    """Read-only export, optionally of some statuses."""
    out = df if status is None else df.where(F.col("status").isin(*status))
    out.write.mode("error").format(format).option("header", "true").save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report (one row, see checks.report) as one JSON document."""
    replace_jsonl(report.coalesce(1), path)


def write_observations(df: DataFrame, path: str, *, parts: Sequence[str]) -> None:
    """Observations by identity; rows whose identity is unsafe as a folder name are not kept."""
    safe = F.lit(True)
    for p in parts:
        safe = safe & F.coalesce(F.col(p).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))
    df.where(safe).write.mode("append").partitionBy(*parts).json(path)


def write_table_and_text(df: DataFrame, path: str, *, order: Sequence[str]) -> None:
    """A derived overview as CSV and as the lines of a Markdown table, both in the order of ``order``."""
    replace_csv(df, f"{path}/csv", order=order)
    rows = df.coalesce(1).sortWithinPartitions(*order)
    replace(markdown_table(rows, df.columns), f"{path}/markdown", format="text")
