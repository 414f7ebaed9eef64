"""The driver's contract, in a fresh process with a plain session in another folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
assert entry.entry(spark).count() == 10
queries = entry.queries()
assert set(entry.oracle_sql()) <= set(queries)
# these send functions to Python workers, which must not need the package
for name in ("fit_ridge_grouped", "aligned_r2", "factor_ss_general", "bootstrap_dominance"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
print("done")
"""


def test_entry_runs_anywhere(tmp_path):
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "done" in out.stdout, out.stderr[-2000:]


ALONE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("longspark.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
from longspark.catalog import load
assert entry.queries() == load()[0] and entry.oracle_sql() == load()[1] and len(entry.queries()) > 190
print("done")
"""


def test_entry_does_without_the_corpus_operators(tmp_path):
    out = subprocess.run([sys.executable, "-c", ALONE], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "done" in out.stdout, out.stderr[-2000:]
