"""Every registered ledger query against its SQL."""

import duckdb
import pytest

from wherewhen.plans import frame_queries, queries

SF = "/root/testdata/sf0.001"
assert frame_queries.__name__  # registers its queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def flat(v) -> str:
    """Numbers to six digits whatever their types, so that only values count."""
    if v is None or v != v:
        return "null"
    return f"{float(v) + 0.0:.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def normal(rows):
    return sorted(tuple(map(flat, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = normal(tuple(r) for r in got.select(columns).collect())
    expected = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    assert rows == normal(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
