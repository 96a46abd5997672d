"""Every query with SQL gives DuckDB's rows; the entry module works with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from chronotext.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, D)
    names = sorted(got.columns)
    out = duck.sql(catalog.SQL[name])
    assert sorted(out.columns) == names
    order = [out.columns.index(c) for c in names]
    want = sorted((tuple(r[k] for k in order) for r in out.fetchall()), key=repr)
    have = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert len(have) == len(want) and have == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_plans_push_down_and_have_few_exchanges(spark):
    def plan(name):
        df = catalog.QUERIES[name](spark, D)
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan("token_map").count("Exchange hashpartitioning") == 0
    assert plan("hysteresis_regions").count("Exchange hashpartitioning") == 1
    assert plan("chunk_pack").count("Exchange hashpartitioning") == 1
    assert plan("multitoken_merge").count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan("frame_logits")


def test_entry_without_the_optional_part(tmp_path):
    for p in ("chronotext", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "chronotext/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'token_map' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
