"""Queries over functions and features of our own, dictionaries, caches, round trips and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import custom, registry
from ..operators import dictionary
from ..sources import files
from ..sources.tables import table
from ..streaming import batches
from .catalog import query

_ARRAY = "[event_type, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END, NULL, 'view']"


@query("""
SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS hours, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0::DOUBLE AS minutes,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS seconds, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000.0::DOUBLE AS millis,
       CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0) AS BIGINT) AS days
FROM events""")
def date_diff_units(spark, d):
    e, start = table(spark, d, "events"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return e.select("event_id", *(custom.date_diff(u, start, F.col("ts")).alias(n) for u, n in (("HOUR", "hours"), ("MINUTE", "minutes"), ("SECOND", "seconds"), ("MILLISECOND", "millis"), ("DAY", "days"))))


@query(f"""
SELECT event_id, coalesce(h[1], 0) AS first_view, coalesce(h[2], 0) AS second_view, coalesce(h[len(h)], 0) AS last_view, 0 AS none FROM (
  SELECT event_id, list_filter(range(1, 5), lambda i: a[i] IS NOT NULL AND a[i] = 'view') AS h FROM (SELECT event_id, {_ARRAY} AS a FROM events))""")
def array_position_instances(spark, d):
    a = F.array("event_type", F.when(F.col("user_id") % 2 == 0, "view").otherwise("click"), F.lit(None).cast("string"), F.lit("view"))
    e = table(spark, d, "events").select("event_id", a.alias("a"))
    f = lambda n: registry.call("array_position_instance", F.col("a"), F.lit("view"), n).cast("long")
    return e.select("event_id", f(1).alias("first_view"), f(2).alias("second_view"), f(-1).alias("last_view"), f(0).cast("int").alias("none"))


@query(f"""
SELECT event_id, CAST(len(list_filter(a, lambda x: x = 'view')) AS INT) AS views, CAST(nullif(len(list_filter(a, lambda x: x = 'click')), 0) AS INT) AS clicks FROM (SELECT event_id, {_ARRAY} AS a FROM events)""")
def array_frequencies(spark, d):
    a = F.array("event_type", F.when(F.col("user_id") % 2 == 0, "view").otherwise("click"), F.lit(None).cast("string"), F.lit("view"))
    m = table(spark, d, "events").select("event_id", custom.array_frequency(a).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("view")).alias("views"), F.try_element_at("m", F.lit("click")).alias("clicks"))


@query("SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE AS hours FROM events GROUP BY user_id")
def sql_functions(spark, d):
    registry.register_sql(spark)
    spans = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spark.sql("SELECT user_id, hours_between(a, b) AS hours FROM {spans}", spans=spans)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def dictionary_group_by(spark, d):
    e = table(spark, d, "events")
    names = dictionary.Dictionary.of(e, "event_type")
    coded = names.encode(e.select("event_type", "user_id"), "event_type", "code").drop("event_type")
    return dictionary.group_encoded(coded, "code", names, "event_type", F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, upper(event_type) AS shouted FROM events WHERE event_type LIKE '%i%' OR event_type = 'error'")
def dictionary_filter_map(spark, d):
    e = table(spark, d, "events")
    names = dictionary.Dictionary.of(e, "event_type")
    coded = names.encode(e.select("event_id", "event_type"), "event_type", "code").drop("event_type")
    kept = names.filter(coded, "code", lambda v: v.like("%i%") | (v == "error"))
    return names.map(F.upper).decode(kept, "code", "shouted").select("event_id", "shouted")


@query("SELECT upper(event_type) AS shouted, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def dictionary_transparent(spark, d):
    """Filter, function and groups on codes, without a call per step."""
    e = dictionary.Encoded.of(table(spark, d, "events").select("event_type"), "event_type")
    out = e.where("event_type", lambda v: v != "error").group_by("event_type")(F.count(F.lit(1)).alias("n"))
    return out.with_function("shouted", "upper", "event_type").decoded().df.select("shouted", "n")


@query("SELECT user_id, list(event_type ORDER BY ts, event_id) AS trace FROM events GROUP BY user_id")
def dictionary_arrays(spark, d):
    """Arrays to codes and back."""
    e = table(spark, d, "events")
    names = dictionary.Dictionary.of(e, "event_type")
    traces = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("t"))
    coded = names.encode_array(traces, "t", "codes").drop("t")
    return names.decode_array(coded, "codes", "trace").select("user_id", "trace")


@query("""
SELECT user_id, ['START'] || list(event_type ORDER BY ts, event_id) || ['END'] AS trace FROM events GROUP BY user_id""")
def dictionary_start_end(spark, d):
    e = table(spark, d, "events")
    names = dictionary.Dictionary.of(e, "event_type")
    n = names.size()
    coded = names.encode(e, "event_type", "code")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "code"))), lambda x: x["code"])
    traces = coded.groupBy("user_id").agg(F.concat(F.array(F.lit(n)), codes, F.array(F.lit(n + 1))).alias("codes"))
    return names.with_start_end("START", "END").decode_array(traces, "codes", "trace").select("user_id", "trace")


@query("SELECT e1.event_type, count(*) AS n FROM events e1 JOIN (SELECT DISTINCT event_type FROM events WHERE value > 50) e2 ON e1.event_type = e2.event_type GROUP BY e1.event_type")
def dictionary_join(spark, d):
    e = table(spark, d, "events")
    names = dictionary.Dictionary.of(e, "event_type")
    coded = names.encode(e, "event_type", "code")
    high = coded.filter("value > 50").select("code").distinct()
    return dictionary.group_encoded(coded.join(high, "code"), "code", names, "event_type", F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def cached_table(spark, d):
    return files.cached(table(spark, d, "customer").select("c_mktsegment", "c_acctbal")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""
SELECT user_id, min(ts) AS started, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session""")
def sessions(spark, d):
    w = F.session_window("ts", "1 hour")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_daily_totals(spark, d):
    """The same aggregate as a stream over the table's folder, run to its end."""
    return batches.daily_totals(spark, d)


@query("""
SELECT event_type, day, count(*) AS n, sum(value) AS total FROM (
  SELECT event_type, value, time_bucket(INTERVAL '1 day', ts) - k * INTERVAL 1 DAY AS day FROM events, range(2) AS r(k))
GROUP BY 1, 2""")
def stream_sliding_totals(spark, d):
    """Windows of two days that begin every day: each event counts in two."""
    return batches.daily_totals(spark, d, "2 days", "1 day")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id", "value")
