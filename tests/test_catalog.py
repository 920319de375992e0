import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidemill import catalog
from verify_oracles import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())


def test_entry_and_names(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_entry_works_without_the_optional_folder(tmp_path):
    root = Path(entry_point.__file__).parent
    (tmp_path / "tidemill").mkdir()
    for p in (root / "tidemill").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tidemill" / p.name).symlink_to(p)
    (tmp_path / "entry_copy.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import entry_copy as e; q = e.queries(); assert 'daily_revenue' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
