"""Every query runs; those with SQL agree with DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from eventweave.plans.oracle import SQL
from eventweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"online_known_graph", "online_infer_groups", "online_infer_graph", "online_many_runs"}  # their operators are tested on smaller networks


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name in SQL:
        result = db.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == theirs


def test_every_name_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports and lists its queries with both folders and the pipeline taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "eventweave", tmp_path / "eventweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=True)
