"""Every registered query of the sensor library against its DuckDB text at the smallest scale."""

import math

import duckdb
import pytest

from sensorframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def cell(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 7) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.select(columns).collect())) == plain(want.fetchall())


def test_rows_only_queries(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracles())):
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
