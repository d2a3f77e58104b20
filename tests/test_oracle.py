"""Every query of the engine against its SQL on DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from quarry.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want
