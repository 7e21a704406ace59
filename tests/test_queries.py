"""Each of the library's own queries against its SQL."""

import os
import shutil
import subprocess
import sys

import pytest

from fieldgrid.plans import queries, sql

ALL, SQL = queries.queries(), sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, small):
    assert ALL[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, with_pipeline):
    """The rest imports and has its queries where the operators on corpora are deleted, their pipeline there or not."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{home}/fieldgrid", tmp_path / "fieldgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", tmp_path)
    if with_pipeline and os.path.exists(f"{home}/corpus_pipeline.py"):
        shutil.copy(f"{home}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == sorted(ALL)
