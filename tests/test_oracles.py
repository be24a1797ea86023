"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from retroscope.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return str(v)[:10] if hasattr(v, "year") else v

    return sorted(map(repr, ([one(v) for v in r] for r in rows)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [[r[i] for i in order] for r in want.fetchall()]
    assert plain(got.select(*columns).collect()) == plain(want)
