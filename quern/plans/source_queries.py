"""Sources and sinks: tables written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import files
from ..sources.tables import table
from .catalog import ORACLE_SQL, QUERIES, query

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
_NAMES = [x.split()[0] for x in _ORDERS.split(", ")]


def _back(spark, df: DataFrame, kind: str, schema: StructType | str | None = None, partition_by: list[str] | None = None, **options) -> DataFrame:
    at = files.scratch(spark)
    files.write(df, at, kind, partition_by=partition_by, **options)
    return files.read(spark, at, kind, schema=schema, **options)


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*[f"cast({x.replace(' ', ' AS ')}) AS {x.split()[0]}" for x in _ORDERS.split(", ")])


def _round_trip(kind: str, **options):
    return lambda spark, d: _back(spark, _orders(spark, d), kind, _ORDERS, **options)


for _kind, _options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true", "escape": '"'})):
    QUERIES[f"round_trip_{_kind}"] = _round_trip(_kind, **_options)
    ORACLE_SQL[f"round_trip_{_kind}"] = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@query("SELECT c_mktsegment || ' ' || c_name AS value FROM customer")
def round_trip_text(spark, d):
    return _back(spark, table(spark, d, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("value")), "text")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def partitioned_files(spark, d):
    """The filter on the folder's column reads one folder only."""
    back = _back(spark, _orders(spark, d), "parquet", partition_by=["o_orderstatus"])
    return back.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def bucketed_tables(spark, d):
    """Both tables are dealt by the key when written, so neither the join nor the groups exchange rows."""
    names = [f"quern_{n}_{uuid.uuid4().hex}" for n in ("orders", "customer")]
    files.write_table(table(spark, d, "orders").select("o_custkey"), names[0], bucket_by=(8, ["o_custkey"]))
    files.write_table(table(spark, d, "customer").select("c_custkey"), names[1], bucket_by=(8, ["c_custkey"]))
    o, c = (spark.table(n) for n in names)
    return o.join(c.hint("merge"), o.o_custkey == c.c_custkey).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


#: A column of each type: name, Spark's expression, DuckDB's.
_TYPES = [
    ("a_bool", "l_linenumber = 1", "l_linenumber = 1"),
    ("a_byte", "cast(l_linenumber AS TINYINT)", "CAST(l_linenumber AS TINYINT)"),
    ("a_short", "cast(l_linenumber AS SMALLINT)", "CAST(l_linenumber AS SMALLINT)"),
    ("an_int", "cast(l_linenumber AS INT)", "CAST(l_linenumber AS INT)"),
    ("a_long", "cast(l_orderkey AS BIGINT)", "CAST(l_orderkey AS BIGINT)"),
    ("a_float", "cast(l_quantity AS FLOAT)", "CAST(l_quantity AS FLOAT)"),
    ("a_double", "l_extendedprice", "l_extendedprice"),
    ("a_decimal", "cast(l_extendedprice AS DECIMAL(12, 2))", "CAST(l_extendedprice AS DECIMAL(12, 2))"),
    ("a_wide_decimal", "cast(l_orderkey AS DECIMAL(30, 5))", "CAST(l_orderkey AS DECIMAL(30, 5))"),
    ("a_text", "l_returnflag", "l_returnflag"),
    ("a_date", "cast(l_shipdate AS DATE)", "CAST(l_shipdate AS DATE)"),
    ("a_time", "cast(l_shipdate AS TIMESTAMP_NTZ)", "CAST(l_shipdate AS TIMESTAMP)"),
    ("an_array", "array(l_linenumber, 7)", "[l_linenumber, 7]"),
]


def _all_types(null: bool):
    def run(spark, d):
        wrap = (lambda e: f"if(l_orderkey < 0, {e}, null)") if null else (lambda e: e)
        t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{wrap(e)} AS {n}" for n, e, _ in _TYPES], f"{wrap('named_struct(\'n\', l_linenumber)')} AS a_struct", f"{wrap('map(l_returnflag, l_linenumber)')} AS a_map")
        back = _back(spark, t, "parquet", t.schema)
        return back.selectExpr("l_orderkey", "l_linenumber", *[n for n, _, _ in _TYPES], "a_struct.n AS in_struct", "map_values(a_map)[0] AS in_map")

    return run


def _types_sql(null: bool) -> str:
    wrap = (lambda e: f"CASE WHEN l_orderkey < 0 THEN {e} END") if null else (lambda e: e)
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{wrap(e)} AS {n}" for n, _, e in [*_TYPES, ("in_struct", "", "l_linenumber"), ("in_map", "", "l_linenumber")]) + " FROM lineitem"


for _name, _null in (("parquet_all_types", False), ("parquet_all_types_null", True)):
    QUERIES[_name] = _all_types(_null)
    ORACLE_SQL[_name] = _types_sql(_null)
