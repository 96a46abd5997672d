"""Queries with SQL give DuckDB's rows over whole tables."""

import duckdb
import pytest

from chronotext.llm import queries

TABLES = "documents embeddings benchmark".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rows_are_those_of_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.QUERIES[name](spark, d)
    out = con.sql(queries.SQL[name])
    names = sorted(got.columns)
    assert sorted(out.columns) == names
    order = [out.columns.index(c) for c in names]
    want = sorted(tuple(r[k] for k in order) for r in out.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want
    assert want or "embedding" in name


def test_embeddings_with_near_copies_against_sql(spark, tmp_path):
    """The same on rows that have near copies: the tables above hold none."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x[200:300] = x[:100] + 0.2 * rng.standard_normal((100, 64))
    x[300:320] = x[5]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "op3_embedding_near_dedup"
    got = {(r.vec_id, r.group_id) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(queries.SQL[name]).fetchall()) and len(got) > 100
