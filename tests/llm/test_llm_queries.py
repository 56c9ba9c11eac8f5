import glob
import os

import duckdb
import pytest

from lathework.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in Q.SQL:
        c = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        r = c.sql(Q.SQL[name])
        names = list(r.columns)
        assert sorted(names) == columns
        assert got == sorted((tuple(x[names.index(y)] for y in columns) for x in r.fetchall()), key=repr)


def test_queries_need_no_package_on_the_workers(tmp_path, data):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lathework.llm.queries import QUERIES
for name in ("p6_found", "p7_found", "p8_coverage", "p9_selection", "p10_found"):
    QUERIES[name](s, {data!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("all ran"), done.stderr[-2000:]
