"""Functions by name: a registry of Column builders, which can also be offered to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import custom

_BUILDERS: dict[str, Callable[..., Column]] = {}


def register(name: str, builder: Callable[..., Column]) -> None:
    """Offers builder under a name; the last one of a name holds."""
    _BUILDERS[name.lower()] = builder


def call(name: str, *args) -> Column:
    """The registered function of that name, or else Spark's own."""
    found = _BUILDERS.get(name.lower())
    return found(*args) if found else F.call_function(name, *args)


def names() -> list[str]:
    return sorted(_BUILDERS)


for _f in (custom.date_diff, custom.array_position_instance, custom.array_frequency, custom.unnest, custom.count_all):
    register(_f.__name__, _f)
register("arbitrary", F.any_value)

#: SQL bodies of the same functions; they're expanded into the plan like any expression.
SQL_FUNCTIONS = (
    "array_position_instance(a ARRAY<STRING>, v STRING, n INT) RETURNS INT RETURN CASE WHEN a IS NULL OR v IS NULL OR n IS NULL THEN NULL WHEN n = 0 THEN 0 ELSE coalesce(try_element_at(filter(transform(a, (x, i) -> CASE WHEN x = v THEN i + 1 END), p -> p IS NOT NULL), n), 0) END",
    "hours_between(a TIMESTAMP, b TIMESTAMP) RETURNS DOUBLE RETURN timestampdiff(MICROSECOND, a, b) / 3600000000D",
    "array_frequency(a ARRAY<STRING>) RETURNS MAP<STRING, INT> RETURN map_from_entries(transform(array_distinct(filter(a, x -> x IS NOT NULL)), v -> struct(v, size(filter(a, x -> x = v)))))",
)


def register_sql(spark: SparkSession) -> None:
    """Defines them as temporary SQL functions of the session."""
    for f in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
