"""Every query of the catalog against its SQL counterpart on DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quern.plans import catalog
from quern.sources.tables import NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = rows(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        r = duck.sql(catalog.ORACLE_SQL[name])
        assert found == rows(r.columns, r.fetchall())
    else:
        assert found[1]


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
