"""Every registered query against its SQL; those without SQL are computed in full."""

import os
import shutil
import subprocess
import sys

import pytest

from claimspark.plans import ORACLE_SQL, QUERIES

from .compare import DATA, connect, rows_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), connect().sql(ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    """All columns are computed: a count alone would prune them."""
    out = QUERIES[name](spark, DATA)
    out.write.format("noop").mode("overwrite").save()
    got = out.toPandas()
    assert len(got) and not got.isna().all().any()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """With its folders gone, whole or but for compiled leftovers, and with or without the pipeline, the entry has the other queries."""
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "*.pyc", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; from claimspark.plans import QUERIES, ORACLE_SQL; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL), set(e.queries()) ^ set(QUERIES)"
    for leave in ("pipeline", "folder", "none"):
        if leave == "folder":
            (at / "claimspark" / "llm" / "__pycache__").mkdir(parents=True)
        if leave == "none":
            (at / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
