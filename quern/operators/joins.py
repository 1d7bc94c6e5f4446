"""Range and as-of joins, which Spark plans as nested loops or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """Rows with start <= point < end (and equal on). Intervals are dealt to buckets of the given width, so the join is an equi-join; every interval is copied to each bucket it touches.

    point, start and end are numbers; choose width near the usual length of an interval.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    on = on or []
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    r = right.filter(F.col(start) < F.col(end)).select("*", F.explode(F.sequence(bucket(start), bucket(end))).alias("bucket__"))
    l = left.withColumn("bucket__", bucket(point))  # noqa: E741
    same = l["bucket__"] == r["bucket__"]
    for k in on:
        same = same & (l[k] == r[k])
    same = same & (l[point] >= r[start]) & (l[point] < r[end])
    out = l.join(r, same, how)
    return out.select(*[l[c] for c in left.columns], *[r[c] for c in right.columns if c not in on])


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left WHERE column NOT IN (SELECT other FROM right), by SQL's rules: a null among right's keys leaves none, a null in left stays only if right is empty.

    Keys are made distinct and both sides shuffled by them, whatever their size; what right holds at all is told by one row.
    """
    keys = right.select(F.col(other).alias("key__")).distinct()
    seen = right.agg(F.count(F.lit(1)).alias("rows"), F.count(other).alias("keys"))
    rows, with_key = seen.select("rows").scalar(), seen.select("keys").scalar()
    found = left.join(keys.hint("merge"), left[column] == keys["key__"], "left_anti")
    return found.filter((rows == with_key) & (F.col(column).isNotNull() | (rows == 0)))


def asof_join(left: DataFrame, right: DataFrame, time: str, on: list[str], values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row of the same keys at or before its time (strict: before), null if there is none.

    Both sides are united and sorted once by key and time; no pairs are formed.
    """
    l = left.select("*", F.lit(None).cast("struct<" + ",".join(f"`{v}`:{right.schema[v].dataType.simpleString()}" for v in values) + ">").alias("right__"), F.lit(0 if strict else 1).alias("side__"))  # noqa: E741
    r = right.select(*on, time, F.struct(*values).alias("right__"), F.lit(1 if strict else 0).alias("side__"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(time, "side__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_left = F.col("side__") == (0 if strict else 1)
    out = both.withColumn("last__", F.last("right__", ignorenulls=True).over(w)).filter(is_left)
    return out.select(*left.columns, *[F.col(f"last__.{v}").alias(v if v not in left.columns else f"right_{v}") for v in values])
