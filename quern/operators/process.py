"""Event-log analyses: directly-follows graphs, variants, throughput times, start and end activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def steps(log: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """log with source and target: each event's activity and its case's next one (null at the end). One exchange by case."""
    return log.withColumn("source", F.col(activity)).withColumn("target", F.lead(activity).over(Window.partitionBy(case).orderBy(*order)))


def directly_follows(log: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """Edges (source, target) with how often one follows the other and in how many cases.

    Edges are first counted within their case, on the exchange that the window already made, so that the number of cases needs no distinct count.
    """
    within = steps(log, case, activity, order).filter(F.col("target").isNotNull()).groupBy(case, "source", "target").agg(F.count(F.lit(1)).alias("n"))
    return within.groupBy("source", "target").agg(F.sum("n").alias("transitions"), F.count(F.lit(1)).alias("cases"))


def variants(log: DataFrame, case: str, activity: str, order: list[str], separator: str = ">") -> DataFrame:
    """Sequences of activities with the number of cases that show them."""
    trace = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, activity))), lambda e: e[activity]), separator)
    return log.groupBy(case).agg(trace.alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("cases"))


def throughput(log: DataFrame, case: str, time: str) -> DataFrame:
    """Each case's events, first and last time, and hours between."""
    span = F.timestamp_diff("MICROSECOND", F.min(time), F.max(time))
    return log.groupBy(case).agg(F.count(F.lit(1)).alias("events"), F.min(time).alias("started"), F.max(time).alias("ended"), (span / 3_600_000_000.0).alias("hours"))


def with_start_end(log: DataFrame, case: str, activity: str, order: list[str], start: str, end: str) -> DataFrame:
    """Edges as of directly_follows, where every case begins at start and finishes at end."""
    w = Window.partitionBy(case).orderBy(*order)
    s = log.select(case, F.col(activity).alias("a"), F.lead(activity).over(w).alias("next"), F.lag(activity).over(w).alias("previous"))
    pairs = F.when(F.col("previous").isNull(), F.array(F.struct(F.lit(start).alias("source"), F.col("a").alias("target")), F.struct(F.col("a").alias("source"), F.coalesce("next", F.lit(end)).alias("target")))).otherwise(F.array(F.struct(F.col("a").alias("source"), F.coalesce("next", F.lit(end)).alias("target"))))
    return s.select(F.inline(pairs)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("transitions"))
