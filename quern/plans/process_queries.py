"""Process-mining queries: case = user_id, activity = event_type, time = ts, ties broken by event_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import process
from ..sources.tables import table
from .catalog import query

ORDER = ["ts", "event_id"]


@query("""
SELECT source, target, count(*) AS transitions, count(DISTINCT user_id) AS cases FROM (
  SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
WHERE target IS NOT NULL GROUP BY source, target""")
def directly_follows(spark, d):
    return process.directly_follows(table(spark, d, "events"), "user_id", "event_type", ORDER)


@query("""
SELECT variant, count(*) AS cases FROM (
  SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS variant FROM events GROUP BY user_id)
GROUP BY variant""")
def variants(spark, d):
    return process.variants(table(spark, d, "events"), "user_id", "event_type", ORDER)


@query("""
SELECT user_id, count(*) AS events, min(ts) AS started, max(ts) AS ended, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE AS hours
FROM events GROUP BY user_id""")
def throughput_time(spark, d):
    return process.throughput(table(spark, d, "events"), "user_id", "ts")


@query("""
WITH s AS (
  SELECT event_type AS a, lead(event_type) OVER w AS n, lag(event_type) OVER w AS p FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT source, target, count(*) AS transitions FROM (
  SELECT a AS source, coalesce(n, 'END') AS target FROM s UNION ALL SELECT 'START', a FROM s WHERE p IS NULL)
GROUP BY source, target""")
def start_end_activities(spark, d):
    return process.with_start_end(table(spark, d, "events"), "user_id", "event_type", ORDER, "START", "END")


@query("""
WITH c AS (SELECT user_id, min(ts) AS started, count(*) AS n FROM events GROUP BY user_id)
SELECT event_type, count(*) AS n_events, avg(n) AS mean_case_size FROM events JOIN c USING (user_id) GROUP BY event_type""")
def activity_by_case(spark, d):
    """Each case's activities are counted first, and its size is the sum of those few counts, so that no event is joined."""
    parts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("size", F.sum("n").over(Window.partitionBy("user_id")))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n_events"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_case_size"))
