"""The driver's contract: every query with SQL agrees with DuckDB, and the rest stands without the llm subpackage."""

import datetime
import decimal
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO, DATA = Path(__file__).parents[1], "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
sys.path.insert(0, str(REPO))
import __spark_entry__ as entry  # noqa: E402


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(v) for v in row) for row in cursor.fetchall()]
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_other_queries_run(spark):
    for name in ("er_pairs", "key_values"):
        entry.queries()[name](spark, DATA).collect()
    assert entry.entry(spark).columns


def test_stands_without_llm(tmp_path):
    code = """
import sys
sys.modules["proofgrid.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(k.startswith("op") for k in e.queries()) and "pipeline" not in e.queries()
assert not any(m.startswith("proofgrid.llm.") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
    used = [p for p in (REPO / "proofgrid").rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
    assert used == []
