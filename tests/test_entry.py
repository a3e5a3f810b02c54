"""The driver contract holds with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from quillon import queries

ROOT = Path(__file__).parents[1]


def test_every_core_query_has_a_twin():
    assert set(queries.QUERIES) == set(queries.ORACLE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "max_k", "min_k", "sum_k", "n"] and df.count() > 0


def test_imports_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    skip = [p.name for p in (ROOT / "quillon").iterdir() if p.name not in ("__init__.py", "queries.py", "sql.py", "functions", "operators", "plans", "sources", "streaming")]
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("__pycache__", *skip))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
