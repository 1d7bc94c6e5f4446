"""Cases that the tables can't reach: nulls, negative offsets, empty arrays, NaN."""

from __future__ import annotations

import datetime
import random
import zlib

import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import custom, registry
from quern.operators import bitmap, dictionary, joins, process
from quern.plans import catalog, scalar_queries
from quern.sources import files
from quern.streaming import batches


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    ("array", "value", "n", "expected"),
    [
        (["a", "b", "a"], "a", 1, 1),
        (["a", "b", "a"], "a", 2, 3),
        (["a", "b", "a"], "a", -1, 3),
        (["a", "b", "a"], "a", -2, 1),
        (["a", "b", "a"], "a", 3, 0),
        (["a", "b", "a"], "a", 0, 0),
        (["a", None, "a"], "a", 2, 3),
        ([], "a", 1, 0),
        (None, "a", 1, None),
        (["a"], None, 1, None),
    ],
)
def test_array_position_instance(spark, array, value, n, expected):
    df = spark.createDataFrame([(array, value)], "a array<string>, v string")
    assert one(df.select(custom.array_position_instance("a", F.col("v"), n))) == expected
    registry.register_sql(spark)
    df.createOrReplaceTempView("t")
    assert one(spark.sql(f"select array_position_instance(a, v, {n}) from t")) == expected


@pytest.mark.parametrize(("array", "expected"), [(["x", "y", "x", None], {"x": 2, "y": 1}), ([], {}), ([None], {}), (None, None)])
def test_array_frequency(spark, array, expected):
    df = spark.createDataFrame([(array,)], "a array<string>")
    assert one(df.select(registry.call("array_frequency", "a"))) == expected


@pytest.mark.parametrize(
    ("unit", "a", "b", "expected"),
    [("HOUR", "2024-01-01 00:00:00", "2024-01-01 01:30:00", 1.5), ("MINUTE", "2024-01-01 00:01:00", "2024-01-01 00:00:00", -1.0), ("SECOND", "2024-01-01 00:00:00", "2024-01-01 00:00:00.25", 0.25), ("MILLISECOND", "2024-01-01 00:00:00", "2024-01-01 00:00:00.0005", 0.5), ("DAY", "2024-01-01 12:00:00", "2024-01-03 11:00:00", 1), ("MONTH", "2024-01-31 00:00:00", "2024-03-31 00:00:00", 2)],
)
def test_date_diff(spark, unit, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    found = one(df.select(custom.date_diff(unit, "a", "b")))
    assert found == expected
    assert isinstance(found, type(expected))


def test_counts_of_several_columns(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None)], "a int, b int")
    assert one(df.agg(custom.count_all("a", "b"))) == 1
    assert one(df.filter("false").agg(custom.count_all("a", "b"))) == 0
    assert one(df.agg(F.count_distinct("a", "b"))) == 1


def test_collect_skips_nulls(spark):
    df = spark.createDataFrame([("k", "pear"), ("k", None), ("k", "fig"), ("k", "pear"), ("m", None)], "g string, fruit string")
    found = {r["g"]: (r["l"], r["s"]) for r in df.groupBy("g").agg(F.sort_array(F.collect_list("fruit")).alias("l"), F.sort_array(F.collect_set("fruit")).alias("s")).collect()}
    assert found == {"k": (["fig", "pear", "pear"], ["fig", "pear"]), "m": ([], [])}


def test_lead_lag_and_sliding_means(spark):
    df = spark.createDataFrame([("u", 10), ("u", 20), ("u", 40), ("v", 7)], "who string, t int")
    w = Window.partitionBy("who").orderBy("t")
    found = df.select("who", "t", F.lead("t", 1).over(w).alias("a"), F.lag("t", -1).over(w).alias("b"), F.lead("t", 2, -1).over(w).alias("c"), F.avg("t").over(w.rowsBetween(-1, 1)).alias("m")).collect()
    assert sorted(map(tuple, found)) == [("u", 10, 20, 20, 40, 15.0), ("u", 20, 40, 40, -1, 70 / 3), ("u", 40, None, None, -1, 30.0), ("v", 7, None, None, -1, 7.0)]


def test_stack_pads(spark):
    df = spark.createDataFrame([("p", "q", "r", "s", "t")], "a string, b string, c string, d string, e string")
    assert [tuple(r) for r in df.selectExpr("stack(3, a, b, c, d, e)").collect()] == [("p", "q"), ("r", "s"), ("t", None)]


def test_unnest_pads(spark):
    df = spark.createDataFrame([([1, 2], ["x"])], "a array<int>, b array<string>")
    assert [tuple(r) for r in df.select(custom.unnest(F.col("a"), F.col("b")).alias("l", "r")).collect()] == [(1, "x"), (2, None)]


def test_bitmap_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, None), (None, -5), (None, 40_000)], "a long, b int")
    assert {tuple(r) for r in bitmap.count_distinct(df, "b", ["a"]).collect()} == {(1, 1), (2, 2), (3, 0), (None, 2)}
    assert one(bitmap.count_distinct(df.filter("false"), "b")) == 0
    assert one(bitmap.count_distinct(df, "b")) == 4
    keys = bitmap.bitmaps(df.filter("b in (2, -5, 40000)"), "b")
    assert sorted(r["b"] for r in bitmap.contains(df, "b", keys).collect()) == [-5, 2, 40_000]
    with pytest.raises(TypeError):
        bitmap.bitmaps(df.withColumn("s", F.lit("x")), "s")


def test_range_join_bounds(spark):
    p = spark.createDataFrame([(1, 0.0), (2, 2.5), (3, 5.0), (4, -1.0)], "i int, x double")
    r = spark.createDataFrame([("a", 0.0, 2.5), ("b", 2.5, 9.0), ("c", 3.0, 3.0)], "k string, lo double, hi double")
    found = {(x["i"], x["k"]) for x in joins.range_join(p, r, "x", "lo", "hi", 1.0).collect()}
    assert found == {(1, "a"), (2, "b"), (3, "b")}
    assert {(x["i"], x["k"]) for x in joins.range_join(p, r, "x", "lo", "hi", 1.0, how="left").collect()} == found | {(4, None)}


def test_asof_ties(spark):
    left = spark.createDataFrame([("u", 1, 10), ("u", 2, 20), ("v", 1, 30)], "k string, t int, i int")
    right = spark.createDataFrame([("u", 1, 100), ("u", 3, 300)], "k string, t int, y int")
    assert {(r["i"], r["y"]) for r in joins.asof_join(left, right, "t", ["k"], ["y"]).collect()} == {(10, 100), (20, 100), (30, None)}
    assert {(r["i"], r["y"]) for r in joins.asof_join(left, right, "t", ["k"], ["y"], strict=True).collect()} == {(10, None), (20, 100), (30, None)}


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "Z"), (5, "A")], "id int, v string")
    d = dictionary.Dictionary.of(df.filter("v <> 'Z'"), "v")
    coded = d.encode(df, "v", "c")
    assert {(r["id"], r["c"]) for r in coded.collect()} == {(1, 0), (2, 1), (3, None), (4, -1), (5, 0)}
    assert {(r["id"], r["w"]) for r in d.decode(coded, "c", "w").collect()} == {(1, "A"), (2, "B"), (3, None), (4, None), (5, "A")}
    assert {r["id"] for r in d.filter(coded, "c", lambda v: v == "A").collect()} == {1, 5}
    assert {r["id"] for r in d.filter(coded, "c", lambda v: v.isNull() | (v == "B")).collect()} == {2, 3}
    arrays = spark.createDataFrame([([0, 1, 7, None],)], "a array<int>")
    assert d.with_start_end("S", "E").decode_array(arrays, "a", "names").first()["names"] == ["A", "B", None, None]
    known = dictionary.Dictionaries()
    known.register("t", "v", d)
    assert known.get("t", "v") is d


def test_process_of_one_case(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 2), (2, "a", 1)], "c int, act string, t int").withColumn("e", F.monotonically_increasing_id())
    assert {(r["source"], r["target"], r["transitions"], r["cases"]) for r in process.directly_follows(log, "c", "act", ["t", "e"]).collect()} == {("a", "b", 1, 1), ("b", "a", 1, 1)}
    assert {(r["variant"], r["cases"]) for r in process.variants(log, "c", "act", ["t", "e"]).collect()} == {("a>b>a", 1), ("a", 1)}


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "i int, s string, part string")
    files.write(df, f"{tmp_path}/{kind}", kind, partition_by=["part"], **({"header": "true"} if kind == "csv" else {}))
    back = files.read(spark, f"{tmp_path}/{kind}", kind, schema="i int, s string, part string", **({"header": "true"} if kind == "csv" else {}))
    assert {tuple(r) for r in back.select("i", "s", "part").collect()} == {(1, "x", "p"), (2, "y", "q")}
    assert back.filter("part = 'p'").count() == 1


def test_tables_and_cache(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    files.write_table(df, "quern_bucketed", bucket_by=(4, ["k"]), mode="overwrite")
    t = spark.table("quern_bucketed")
    assert "Exchange hashpartitioning" not in t.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert t.groupBy("k").count().count() == 7
    cached = files.cached(df)
    assert cached.count() == 100
    cached.unpersist()
    spark.sql("DROP TABLE quern_bucketed")


def test_text_source(spark, tmp_path):
    files.write(spark.createDataFrame([("a b",), ("c",)], "value string"), f"{tmp_path}/t", "text")
    assert {r[0] for r in files.read(spark, f"{tmp_path}/t", "text").collect()} == {"a b", "c"}


@pytest.mark.parametrize(("left", "right", "expected"), [([1, 2, None], [2], [1]), ([1, None], [], [1, None]), ([1, 2], [2, None], []), ([], [None], []), ([1, 1, 3], [3, 3], [1, 1])])
def test_not_in(spark, left, right, expected):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in (left, right))
    found = joins.not_in(a, "k", b.withColumnRenamed("k", "o"), "o")
    assert sorted((r["k"] for r in found.collect()), key=str) == sorted(expected, key=str)
    a.createOrReplaceTempView("a__")
    b.createOrReplaceTempView("b__")
    assert sorted((r["k"] for r in spark.sql("select k from a__ where k not in (select k from b__)").collect()), key=str) == sorted(expected, key=str)


def test_not_in_broadcasts_no_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = joins.not_in(spark.range(50), "id", spark.range(20).withColumnRenamed("id", "o"), "o")
        assert found.count() == 30
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bitmap_values_and_several(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 70_000, 1), ("a", None, 2), ("b", -3, None)], "g string, x int, y long")
    sets = bitmap.bitmaps(df, "x")
    for value, expected in ((5, True), (6, False), (70_000, True), (-3, True)):
        one_set = sets.filter(F.col("bucket") == F.bitmap_bucket_number(F.lit(value).cast("long")))
        assert one(one_set.select(bitmap.contains_value(F.col("bitmap"), value))) is expected
    assert one(spark.sql("select cast(null as binary) as m").select(bitmap.contains_value(F.col("m"), 5))) is None
    assert {tuple(r) for r in bitmap.count_distinct_of(df, ["x", "y"], ["g"]).collect()} == {("a", 2, 2), ("b", 1, 0)}


@pytest.mark.parametrize("bound", [dictionary.BROADCAST_ENTRIES, 2])
def test_dictionary_of_any_size(spark, monkeypatch, bound):
    monkeypatch.setattr(dictionary, "BROADCAST_ENTRIES", bound)
    values = [f"v{k}" for k in range(60)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values * 2)] + [(-1, None)], "id int, v string").repartition(3)
    d = dictionary.Dictionary.of(df, "v")
    assert sorted(r["code"] for r in d.entries.collect()) == list(range(60))
    coded = d.encode(df, "v", "c").drop("v")
    assert {(r["id"], r["w"]) for r in d.decode(coded, "c", "w").collect()} == {(k, v) for k, v in enumerate(values * 2)} | {(-1, None)}
    arrays = spark.createDataFrame([(1, ["v3", "v1", None, "no"]), (2, []), (3, None), (1, ["v3", "v1", None, "no"])], "i int, a array<string>")
    back = d.decode_array(d.encode_array(arrays, "a", "codes").drop("a"), "codes", "a")
    assert sorted(((r["i"], r["a"]) for r in back.collect()), key=repr) == sorted([(1, ["v3", "v1", None, None]), (2, []), (3, None), (1, ["v3", "v1", None, None])], key=repr)
    d.release()


def test_encoded_frames(spark):
    df = spark.createDataFrame([("a", 1), ("A", 2), ("b", 3), (None, 4)], "k string, n int")
    e = dictionary.Encoded.of(df, "k")
    assert dict(e.df.dtypes)["k"] == "int"
    upper = e.with_function("u", "upper", "k")
    assert dict(upper.df.dtypes)["u"] == "int"
    totals = upper.group_by("u")(F.sum("n").alias("n")).decoded().df  # entries that map to one value are one group
    assert {tuple(r) for r in totals.collect()} == {("A", 3), ("B", 3), (None, 4)}
    assert {tuple(r) for r in e.where("k", lambda v: v.isNull() | (v == "b")).decoded().df.collect()} == {("b", 3), (None, 4)}
    few = dictionary.Encoded(e.df.filter("n < 3").select("k"), e.dictionaries)
    assert {r["k"] for r in e.join(few, "k").decoded().df.collect()} == {"a", "A"}
    dictionary.register_rewrite("twice", lambda v: F.concat(v, v))
    assert {r["t"] for r in e.with_function("t", "twice", "k").decoded().df.collect()} == {"aa", "AA", "bb", None}
    assert {r["h"] for r in e.with_function("h", "hex", "k").decoded().df.collect()} == {"61", "41", "62", None}


def test_checksums(spark):
    texts = ["", "a", "flag", "five5", "naïve ü", "x" * 37]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.selectExpr("t", "crc32(t) AS c", "hash(t) AS h", "xxhash64(t) AS x").collect():
        raw = r["t"].encode()
        assert (r["c"], r["h"], r["x"] % 2**64) == (zlib.crc32(raw), scalar_queries.murmur3(raw), xxhash.xxh64_intdigest(raw, 42))


def test_sketches_keep_their_bounds(spark):
    r = random.Random(4)
    values = [r.randrange(1_000_000) for _ in range(60_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    n = len(set(values))
    assert abs(one(df.agg(F.approx_count_distinct("v", 0.02))) - n) <= 3 * 0.02 * n
    ranked = sorted(values)
    for share in (0.1, 0.5, 0.9):
        found = one(df.agg(F.percentile_approx("v", share, 200)))
        low, high = (sum(x < found for x in ranked), sum(x <= found for x in ranked))
        assert low - len(values) / 200 <= share * len(values) <= high + len(values) / 200


def test_random_columns(spark):
    df = spark.range(20_000).repartition(4, "id")
    a, b = (df.select("id", F.rand(3).alias("u"), F.randn(3).alias("g")).collect() for _ in range(2))
    assert sorted(a) == sorted(b)
    assert all(0 <= r["u"] < 1 for r in a) and abs(sum(r["u"] for r in a) / len(a) - 0.5) < 0.02
    assert abs(sum(r["g"] for r in a) / len(a)) < 0.05 and abs(sum(r["g"] ** 2 for r in a) / len(a) - 1) < 0.05


def test_errors_are_raised(spark):
    df = spark.range(3)
    with pytest.raises(Exception, match="odd one"):
        df.select(F.assert_true(F.col("id") < 2, "odd one")).collect()
    with pytest.raises(Exception, match="stop here"):
        df.select(F.when(F.col("id") < 2, F.lit("")).otherwise(F.raise_error(F.lit("stop here")).cast("string"))).collect()


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 5, 1, h, m)
    put = lambda rows: spark.createDataFrame(rows, "k string, t timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", at(1), 1.0), ("a", at(1, 30), 2.0)])

    def run():
        stream = spark.readStream.schema("k string, t timestamp, v double").parquet(str(tmp_path / "in"))
        out = batches.run_to_end(spark, batches.windowed_totals(stream, "t", ["k"], "1 hour", "v", "1 hour"), "append", str(tmp_path / "out"))
        return {(r["k"], r["n"], r["total"]) for r in out.collect()}

    put([("a", at(4), 4.0)])
    run()
    put([("a", at(1, 10), 100.0), ("a", at(9), 8.0)])  # the first is later than is waited for
    assert run() == {("a", 2, 3.0), ("a", 1, 4.0)}


def test_max_by_takes_the_first_of_ties(spark, tmp_path):
    """As its SQL in one thread: ties, nulls on either side, NaN, zeros of both signs, a group of which nothing counts."""
    import duckdb

    nan = float("nan")
    rows = [(7, 1.0, "a"), (3, 5.0, "a"), (1, 5.0, "a"), (9, 1.0, "a"), (None, 9.0, "a"), (None, -9.0, "a"), (2, None, "a"), (6, nan, "b"), (5, 0.0, "b"), (4, nan, "b"), (8, -0.0, "b"), (None, nan, "c"), (1, None, "c"), (2, 4.0, None), (1, 4.0, None)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    found = {tuple(r) for r in catalog.QUERIES["max_by_min_by"](spark, str(tmp_path)).collect()}
    assert found == set(duck.sql(catalog.ORACLE_SQL["max_by_min_by"]).fetchall()) == {("a", 3, 7), ("b", 6, 5), ("c", None, None), (None, 2, 2)}
