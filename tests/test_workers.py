"""Functions shipped to workers must not need the package there: queries run from a folder without it."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from {module} import QUERIES
for name in {names!r}:
    QUERIES[name](s, {data!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""


def ran_elsewhere(tmp_path, data, module, names):
    repo = str(Path(__file__).resolve().parents[1])
    code = SCRIPT.format(repo=repo, module=module, names=names, data=data)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    return done.stdout.strip().endswith("all ran"), done.stderr[-2000:]


def test_core_queries(tmp_path, data):
    names = ["p1_records", "p2_found", "p3_found", "numeric_tokens", "semantic_token_kinds", "chinese_typography", "html_plain", "page_lines", "p_values", "term_in_documents", "p2_decided", "residual_runs", "numeric_suite"]
    ok, said = ran_elsewhere(tmp_path, data, "lathework.plans.catalogue", names)
    assert ok, said
