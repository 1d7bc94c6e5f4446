"""Exact distinct counts and key sets by bitmaps: a relation (keys, bucket, bitmap) of fixed-size blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _checked(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegerType | T.LongType):
        raise TypeError(f"bitmaps hold INT or BIGINT, not {kind.simpleString()}")


def bitmaps(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, bucket, bitmap) of the column's values; nulls are left out."""
    _checked(df, column)
    x = F.col(column).cast("long")
    return df.filter(F.col(column).isNotNull()).groupBy(*(keys or []), F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bitmap"))


def count_distinct(df: DataFrame, column: str, keys: list[str] | None = None, name: str = "n") -> DataFrame:
    """Exact count of distinct values for each key: never null, 0 where all are null.

    Nulls fall into a block of their own, whose bitmap stays empty, so that keys without values keep their row.
    """
    _checked(df, column)
    x = F.col(column).cast("long")
    blocks = df.groupBy(*(keys or []), F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bitmap"))
    return blocks.groupBy(*(keys or [])).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias(name))


def merge(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The union of stored bitmaps of the same bucket."""
    return parts.groupBy(*(keys or []), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersect(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What all stored bitmaps of a bucket share. Every set must have a row for the bucket."""
    return parts.groupBy(*(keys or []), "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))


def contains_value(bitmap: Column, value: Column | int) -> Column:
    """Whether a stored bitmap has the value's bit; the bitmap must be of the value's bucket. Null if either is null."""
    bit = F.bitmap_bit_position(F.lit(value).cast("long") if isinstance(value, int) else value.cast("long"))
    byte = F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")), (bit % 8).cast("int")) == 1


def contains(df: DataFrame, column: str, key_set: DataFrame) -> DataFrame:
    """Rows of df whose value is in the set (bucket, bitmap); null is in none.

    The set is cut into its bytes, those that have a bit, so that the join has a key for every eight values.
    """
    _checked(df, column)
    at = lambda i: F.substring(F.col("bitmap"), i + 1, F.lit(1))
    parts = key_set.select("bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.length("bitmap") - 1)).alias("i"))
    parts = parts.select(F.col("bucket").alias("bucket__"), F.col("i").cast("long").alias("i__"), F.ascii(F.decode(at(F.col("i")), "ISO-8859-1")).alias("byte__")).filter("byte__ <> 0")
    x = F.col(column).cast("long")
    bit = F.bitmap_bit_position(x)
    keyed = df.withColumn("bucket__", F.bitmap_bucket_number(x)).withColumn("i__", F.floor(bit / 8).cast("long")).withColumn("bit__", (bit % 8).cast("int"))
    return keyed.join(parts, ["bucket__", "i__"]).filter(F.getbit("byte__", F.col("bit__")) == 1).select(*df.columns)


def count_distinct_of(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys and n_<column> for each column, in one pass: what count(DISTINCT ..) of several columns gives, without a row per combination."""
    for c in columns:
        _checked(df, c)
    keys = keys or []
    values = df.select(*keys, F.posexplode(F.array(*[F.col(c).cast("long") for c in columns])).alias("of__", "x__"))
    blocks = values.groupBy(*keys, "of__", F.bitmap_bucket_number("x__").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x__")).alias("bitmap"))
    count = lambda k: F.coalesce(F.sum(F.when(F.col("of__") == k, F.bitmap_count("bitmap"))), F.lit(0)).cast("long")
    return blocks.groupBy(*keys).agg(*[count(k).alias(f"n_{c}") for k, c in enumerate(columns)])
