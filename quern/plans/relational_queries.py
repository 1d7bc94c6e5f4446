"""Projection, filters, sorts, limits, joins, set operations, generators and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import custom
from ..operators import joins
from ..sources.tables import table
from .catalog import query


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_shipdate AS shipped FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def project_filter(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_shipdate").alias("shipped"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 10")
def sort_offset_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").offset(10).limit(20)


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, d):
    c, o = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT n_name, count(c_custkey) AS n FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def join_right(spark, d):
    c, n = table(spark, d, "customer").filter("c_acctbal > 9000"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "right").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal < -900) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 500) s ON c_custkey = s_suppkey")
def join_full(spark, d):
    c, s = table(spark, d, "customer").filter("c_acctbal < -900"), table(spark, d, "supplier").filter("s_acctbal < 500")
    return c.join(s, c.c_custkey == s.s_suppkey, "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_left_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def join_null_aware_anti(spark, d):
    """NOT IN without the broadcast that Spark plans for it at any size."""
    return joins.not_in(table(spark, d, "part").select("p_partkey"), "p_partkey", table(spark, d, "lineitem").filter("l_quantity > 49"), "l_partkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey END FROM region)")
def join_not_in_with_null(spark, d):
    keys = table(spark, d, "region").select(F.when(F.col("r_regionkey") > 2, F.col("r_regionkey")).alias("k"))
    return joins.not_in(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", keys, "k")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) OR c_acctbal > 5000 AS active FROM customer")
def join_existence(spark, d):
    return spark.sql("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM {orders}) OR c_acctbal > 5000 AS active FROM {customer}", customer=table(spark, d, "customer"), orders=table(spark, d, "orders"))


@query("SELECT r_name, n_name, count(*) AS n FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey GROUP BY r_name, n_name")
def join_broadcast(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))  # small dimensions: the session's size threshold picks broadcasts
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice > o_totalprice / 2")
def join_hash_residual(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o.hint("shuffle_hash"), (li.l_orderkey == o.o_orderkey) & (li.l_shipdate > o.o_orderdate) & (li.l_extendedprice > o.o_totalprice / 2)).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("SELECT o_orderkey, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_merge(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").hint("merge")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON upper(substr(a.n_name, 1, 1)) = upper(substr(b.n_name, 1, 1)) AND a.n_nationkey < b.n_nationkey")
def join_on_expression(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    key = lambda t: F.upper(F.substring(F.col(f"{t}.n_name"), 1, 1))
    return a.join(b, (key("a") == key("b")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return table(spark, d, "nation").crossJoin(table(spark, d, "region")).select("n_name", "r_name")


@query("SELECT a.r_name AS lower_name, b.r_name AS higher_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def join_theta(spark, d):
    a, b = table(spark, d, "region").alias("a"), table(spark, d, "region").alias("b")
    return a.join(b, F.col("a.r_regionkey") < F.col("b.r_regionkey")).select(F.col("a.r_name").alias("lower_name"), F.col("b.r_name").alias("higher_name"))


@query("""
SELECT e.event_id, w.event_id AS window_id FROM events e
JOIN (SELECT event_id, user_id, value AS lo, value + 2.5 AS hi FROM events WHERE event_type = 'purchase') w
ON e.user_id = w.user_id AND e.value >= w.lo AND e.value < w.hi""")
def range_join(spark, d):
    e = table(spark, d, "events")
    w = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", F.col("value").alias("lo"), (F.col("value") + 2.5).alias("hi"))
    return joins.range_join(e.select("event_id", "user_id", "value"), w, "value", "lo", "hi", 2.5, on=["user_id"]).select("event_id", "window_id")


@query("""
SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark, d):
    e = table(spark, d, "events")
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    v = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return joins.asof_join(v, p, "ts", ["user_id"], ["last_purchase"]).select("event_id", "last_purchase")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("k")).intersect(table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def explode_array(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("x"))


@query("SELECT vec_id, i - 1 AS pos, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def posexplode_array(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


@query("""
SELECT n_nationkey, unnest(w) AS word FROM (SELECT n_nationkey, string_split(n_name, 'A') AS w FROM nation WHERE n_nationkey % 2 = 0)
UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 1""")
def explode_outer(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.split("n_name", "A")).alias("w"))
    return n.select("n_nationkey", F.explode_outer("w").alias("word"))


@query("SELECT r_regionkey, 'key' AS k, CAST(r_regionkey AS VARCHAR) AS v FROM region UNION ALL SELECT r_regionkey, 'name', r_name FROM region")
def explode_map(spark, d):
    m = F.create_map(F.lit("key"), F.col("r_regionkey").cast("string"), F.lit("name"), F.col("r_name"))
    return table(spark, d, "region").select("r_regionkey", F.explode(m).alias("k", "v"))


@query("SELECT r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT r_regionkey + 100, upper(r_name) FROM region")
def inline_structs(spark, d):
    rows = F.array(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label")), F.struct((F.col("r_regionkey") + 100).alias("id"), F.upper("r_name").alias("label")))
    return table(spark, d, "region").select(F.inline(rows))


@query("SELECT p_partkey AS a, p_size AS b FROM part UNION ALL SELECT p_size, NULL FROM part")
def stack_rows(spark, d):
    return table(spark, d, "part").select(F.stack(F.lit(2), F.col("p_partkey"), F.col("p_size"), F.col("p_size").cast("long")).alias("a", "b")).select("a", F.col("b").cast("int").alias("b"))


@query("""
SELECT n_nationkey, i AS pos, CASE WHEN i <= len(a) THEN a[i] END AS left_word, CASE WHEN i <= len(b) THEN b[i] END AS right_word FROM (
  SELECT n_nationkey, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM (SELECT n_nationkey, string_split(n_name, 'A') AS a, string_split(n_name, 'I') AS b FROM nation))""")
def unnest_arrays(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.split("n_name", "A").alias("a"), F.split("n_name", "I").alias("b"))
    n = n.withColumn("i", F.sequence(F.lit(1), F.greatest(F.size("a"), F.size("b"))))
    return n.select("n_nationkey", custom.unnest(F.col("i"), F.col("a"), F.col("b")).alias("pos", "left_word", "right_word")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_tuple(spark, d):
    return table(spark, d, "events").select("event_id", F.json_tuple("props", "k").alias("k"))


@query("SELECT r_regionkey, r_name AS name, lower(r_name) AS low FROM region")
def struct_edits(spark, d):
    s = F.struct("r_regionkey", F.col("r_name").alias("name"), F.lit(1).alias("extra"))
    return table(spark, d, "region").select(s.withField("low", F.lower("r_name")).dropFields("extra").alias("s")).select("s.*")


@query("SELECT n_nationkey, 'nation' AS of_metadata, 'nation' AS of_function, 1 AS rows_of_id FROM nation")
def metadata_columns(spark, d):
    """The table that each row's file belongs to, by either way; ids made for rows are distinct."""
    name = lambda c: F.regexp_extract(c, r"([a-z]+)\.parquet", 1)
    n = table(spark, d, "nation").select("n_nationkey", name(F.col("_metadata.file_path")).alias("of_metadata"), name(F.input_file_name()).alias("of_function"), F.monotonically_increasing_id().alias("i"))
    return n.groupBy("n_nationkey", "of_metadata", "of_function").agg(F.count_distinct("i").cast("int").alias("rows_of_id"))


@query("SELECT o_orderkey, o_totalprice, o_totalprice / (SELECT avg(o_totalprice) FROM orders) AS ratio FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(spark, d):
    o = table(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice")).scalar()
    return o.filter(F.col("o_totalprice") > mean * 1.5).select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / mean).alias("ratio"))


@query("SELECT CAST(range AS BIGINT) AS id FROM range(0, 1000, 7)")
def range_rows(spark, d):
    return spark.range(0, 1000, 7).coalesce(1)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def repartitioned(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_orderkey").repartitionByRange("l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query()
def random_columns(spark, d):
    """Seeded random columns: uniform and normal."""
    return table(spark, d, "orders").select("o_orderkey", F.rand(7).alias("uniform"), F.randn(7).alias("normal"))


@query("SELECT c_custkey, c_name AS checked, true AS held FROM customer")
def assertions(spark, d):
    """assert_true is null where its condition holds; raise_error is reached by no row."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") >= 0, F.col("c_name")).otherwise(F.raise_error(F.lit("no key")).cast("string")).alias("checked"), F.assert_true(F.col("c_custkey") >= 0, "no key").isNull().alias("held"))


@query()
def sampled(spark, d):
    """A sampling operator: about a tenth of the rows, by a fixed seed."""
    return table(spark, d, "orders").sample(fraction=0.1, seed=7).select("o_orderkey")
