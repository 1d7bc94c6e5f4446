"""Queries of the package that SQL can express, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quern.llm import entries

FOLDER = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(float(f"{r[k]:.9g}") if isinstance(r[k], float) else r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", list(entries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for n in ("documents", "pages"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    df, r = entries.QUERIES[name](spark, FOLDER), c.sql(entries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())
