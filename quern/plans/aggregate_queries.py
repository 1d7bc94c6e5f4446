"""Aggregates, grouping sets, pivots and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import custom
from ..operators import bitmap
from ..sources.tables import table
from .catalog import query


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def segment_revenue(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_qty FROM lineitem GROUP BY l_returnflag")
def aggregate_filter(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.expr("count(*) filter (where l_quantity > 25)").alias("big"), F.expr("sum(l_quantity) filter (where l_linestatus = 'O')").alias("open_qty"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, sum(DISTINCT l_quantity) AS quantities, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_returnflag")
def distinct_aggregates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.sum_distinct("l_quantity").alias("quantities"), F.count_distinct("l_linenumber").alias("numbers"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_returnflag")
def bitmap_count_distinct(spark, d):
    return bitmap.count_distinct(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey"), "l_orderkey", ["l_returnflag"])


@query("SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def bitmap_count_distinct_all(spark, d):
    return bitmap.count_distinct(table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def bitmap_contains(spark, d):
    keys = bitmap.bitmaps(table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'"), "c_custkey")
    return bitmap.contains(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keys).select("o_orderkey")


@query("SELECT c_mktsegment, count(*) FILTER (c_nationkey = 3) > 0 AS has_three, count(*) FILTER (c_nationkey = 300) > 0 AS has_other FROM customer GROUP BY c_mktsegment")
def bitmap_contains_value(spark, d):
    sets = bitmap.bitmaps(table(spark, d, "customer"), "c_nationkey", ["c_mktsegment"])
    sets = sets.filter(F.col("bucket") == F.bitmap_bucket_number(F.lit(3).cast("long")))  # 300 is of the same one
    return sets.select("c_mktsegment", bitmap.contains_value(F.col("bitmap"), 3).alias("has_three"), bitmap.contains_value(F.col("bitmap"), 300).alias("has_other"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem GROUP BY l_returnflag")
def bitmap_count_distinct_of_several(spark, d):
    return bitmap.count_distinct_of(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_returnflag"])


@query("""
SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS either,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS both_sets""")
def bitmap_and_or(spark, d):
    o = table(spark, d, "orders")
    f, p = (bitmap.bitmaps(o.filter(F.col("o_orderstatus") == s), "o_custkey") for s in ("F", "O"))
    shared = f.join(p.select("bucket"), "bucket", "left_semi").select(f.columns).unionByName(p.join(f.select("bucket"), "bucket", "left_semi").select(p.columns))
    count = lambda b: F.coalesce(F.sum(F.bitmap_count(b)).cast("long"), F.lit(0))
    either = bitmap.merge(f.unionByName(p)).agg(count("bitmap").alias("either"))
    return either.crossJoin(bitmap.intersect(shared).agg(count("bitmap").alias("both_sets")))  # one row each


@query("SELECT o_orderstatus, count(CASE WHEN o_custkey IS NOT NULL AND o_totalprice IS NOT NULL THEN 1 END) AS n, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs FROM orders GROUP BY o_orderstatus")
def count_several(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(custom.count_all("o_custkey", "o_totalprice").alias("n"), F.count_distinct("o_custkey", "o_orderpriority").alias("pairs"))


@query("SELECT n_regionkey, list_sort(list(n_name)) AS every, list_sort(list(DISTINCT substr(n_name, 1, 1))) AS initials FROM nation GROUP BY n_regionkey")
def collect_list_set(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("every"), F.sort_array(F.collect_set(F.substring("n_name", 1, 1))).alias("initials"))


@query("SELECT c_mktsegment, round(avg(CAST(c_acctbal AS DECIMAL(12, 2))), 4) AS mean FROM customer GROUP BY c_mktsegment")
def avg_decimal(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(F.col("c_acctbal").cast("decimal(12,2)")).cast("double"), 4).alias("mean"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def approx_percentile(spark, d):
    """At this accuracy the sketch holds every one of the 50 quantities, so its answer is the exact one."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 1_000_000).alias("median"), F.percentile_approx("l_quantity", 0.9, 1_000_000).alias("p90"))


@query()
def approx_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("n"))


@query("SELECT c_mktsegment, min(c_name) AS first_name, max(c_name) AS last_name, min(c_acctbal) AS lowest, max(c_acctbal) AS highest FROM customer GROUP BY c_mktsegment")
def min_max(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("first_name"), F.max("c_name").alias("last_name"), F.min("c_acctbal").alias("lowest"), F.max("c_acctbal").alias("highest"))


@query("SELECT c_mktsegment, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_mktsegment")
def max_by_min_by(spark, d):
    """Of equal balances the first row of the table counts, as for arg_max in one thread; rows without a key or a balance don't, and NaN is the highest."""
    bal, at = F.col("c_acctbal"), (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    whole = bal.isNotNull() & F.col("c_custkey").isNotNull()
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.when(whole, F.struct(~F.isnan(bal), -bal, *at)).alias("down"), F.when(whole, F.struct(bal, *at)).alias("up"))
    return c.groupBy("c_mktsegment").agg(F.min_by("c_custkey", "down").alias("richest"), F.min_by("c_custkey", "up").alias("poorest"))


@query("SELECT n_regionkey, min(r) AS arbitrary_name FROM (SELECT n_regionkey, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY n_regionkey")
def arbitrary(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("n_regionkey").agg(F.any_value("r_name").alias("arbitrary_name"))


@query("""
SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_pop(c_acctbal), 6) AS sdp, round(var_samp(c_acctbal), 4) AS v, round(var_pop(c_acctbal), 4) AS vp,
       round(corr(c_acctbal, c_custkey), 9) AS r, round(covar_pop(c_acctbal, c_custkey), 4) AS cp, round(covar_samp(c_acctbal, c_custkey), 4) AS cs
FROM customer GROUP BY c_mktsegment""")
def statistics(spark, d):
    a, k = "c_acctbal", "c_custkey"
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp(a), 6).alias("sd"), F.round(F.stddev_pop(a), 6).alias("sdp"), F.round(F.var_samp(a), 4).alias("v"), F.round(F.var_pop(a), 4).alias("vp"), F.round(F.corr(a, k), 9).alias("r"), F.round(F.covar_pop(a, k), 4).alias("cp"), F.round(F.covar_samp(a, k), 4).alias("cs"))


@query("SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
def bit_aggregates(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.bit_and("n_nationkey").alias("a"), F.bit_or("n_nationkey").alias("o"), F.bit_xor("n_nationkey").alias("x"))


@query("""
SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type, last(event_type ORDER BY ts, event_id) AS last_type FROM events GROUP BY user_id""")
def first_last(spark, d):
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("""
SELECT DISTINCT user_id, first_value(t) OVER w AS opened, last_value(t IGNORE NULLS) OVER w AS last_known, nth_value(t, 2 IGNORE NULLS) OVER w AS second_known
FROM (SELECT user_id, ts, event_id, nullif(event_type, 'click') AS t FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_values_ignoring_nulls(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = table(spark, d, "events").withColumn("t", F.nullif(F.col("event_type"), F.lit("click")))
    return e.select("user_id", F.first("t").over(w).alias("opened"), F.last("t", ignorenulls=True).over(w).alias("last_known"), F.nth_value("t", 2, ignoreNulls=True).over(w).alias("second_known")).distinct()


@query("SELECT event_id, lead(event_id, 2) OVER w AS two_on, lag(event_id, 1, -1) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_negative_offsets(spark, d):
    """lag by -2 looks ahead, lead by -1 back."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id", -2).over(w).alias("two_on"), F.lead("event_id", -1, -1).over(w).alias("before"))


@query("SELECT CASE WHEN k = 1 THEN 'nan' WHEN k = 2 THEN 'zero' ELSE 'one' END AS kind, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 1 WHEN n_nationkey % 4 = 3 THEN 3 ELSE 2 END AS k FROM nation) GROUP BY k")
def float_keys(spark, d):
    """NaN equals itself as a key, and -0.0 equals 0.0."""
    m = F.col("n_nationkey") % 4
    x = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(0.0)).when(m == 2, F.lit(-0.0)).otherwise(F.lit(1.0))
    groups = table(spark, d, "nation").groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return groups.select(F.when(F.isnan("x"), "nan").when(F.col("x") == 0, "zero").otherwise("one").alias("kind"), "n")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    return table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS "view", count(*) FILTER (WHERE event_type = 'purchase') AS purchase
FROM events GROUP BY user_id""")
def pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""
SELECT n_nationkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, cume_dist() OVER w AS cd, percent_rank() OVER w AS pr, ntile(3) OVER w AS nt
FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)""")
def window_ranks(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.cume_dist().over(w).alias("cd"), F.percent_rank().over(w).alias("pr"), F.ntile(3).over(w).cast("long").alias("nt"))


@query("""
SELECT event_id, lead(event_type) OVER w AS next_type, lag(event_type, 2, 'none') OVER w AS before_last, lead(value, 1, -1.0) OVER w AS next_value,
       lag(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_lead_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.expr("CASE WHEN event_type = 'purchase' THEN value END"))
    return e.select("event_id", F.lead("event_type").over(w).alias("next_type"), F.lag("event_type", 2, "none").over(w).alias("before_last"), F.lead("value", 1, -1.0).over(w).alias("next_value"), F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last_purchase"))


@query("""
SELECT event_id, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second_value,
       sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS around,
       count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
       max(value) OVER (PARTITION BY user_id) AS highest
FROM events""")
def window_frames(spark, d):
    p = Window.partitionBy("user_id")
    w = p.orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.nth_value("value", 2).over(w).alias("second_value"), F.sum("value").over(w.rowsBetween(-2, 1)).alias("around"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.max("value").over(p).alias("highest"))


@query("""
SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near,
       min(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least
FROM part""")
def window_range_frames(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select("p_partkey", F.count(F.lit(1)).over(w.rangeBetween(-3, 2)).alias("near"), F.min("p_size").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("least"))


@query("SELECT n_nationkey, list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names FROM nation")
def window_collect(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_name").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "nation").select("n_nationkey", F.collect_list("n_name").over(w).alias("names"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")
