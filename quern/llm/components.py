"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (large) or its smaller ones and itself (small) to the least of them.

    The leasts are stored, so that the join meets two plain exchanges, of which adaptive execution splits a hub's edges.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least)
        out = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = stored(down.groupBy("a").agg(F.min("b").alias("m")))
        out = down.join(least.hint("merge"), "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("a").alias("hi"), F.col("m").alias("lo")))
    out = stored(out.filter("hi <> lo").select(F.greatest("hi", "lo").alias("a"), F.least("hi", "lo").alias("b")).distinct())
    dropped(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the least node that node reaches; nodes without an edge are absent."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signed = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = signed(now)
    while mark[0]:
        large = _star(now, True)
        after = _star(large, False)
        dropped(now)
        dropped(large)
        now, last, mark = after, mark, signed(after)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
