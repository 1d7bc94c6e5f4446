"""Dictionary execution: a column as integer codes, filters and expressions evaluated once for each dictionary entry, values decoded last.

A dictionary is a DataFrame (code INT, value). Joins with it broadcast only if
its size is under a checked bound; larger ones shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries up to which a dictionary is broadcast.
BROADCAST_ENTRIES = 100_000


class Dictionary:
    def __init__(self, entries: DataFrame, size: int | None = None) -> None:
        self.entries = entries.select("code", "value")
        self._size = size

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Dictionary:
        """Codes 0, 1, .. of the distinct values; null has none. The values are found once and kept until release().

        Up to BROADCAST_ENTRIES codes follow the order of the values. Beyond, they follow the values' hashes: buckets are
        numbered on their own, and start where the counts of those before them end, so no task sees all values.
        """
        values = df.select(F.col(column).alias("value")).filter("value is not null").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        size = values.count()
        if size <= BROADCAST_ENTRIES:
            entries = values.select((F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("code"), "value")
        else:
            entries = numbered(values)
        out = cls(entries, size)
        out._kept = values
        return out

    def release(self) -> None:
        """Frees the values that of() keeps."""
        if (kept := getattr(self, "_kept", None)) is not None:
            kept.unpersist()

    def size(self) -> int:
        if self._size is None:
            self._size = self.entries.count()
        return self._size

    def _side(self, entries: DataFrame) -> DataFrame:
        return F.broadcast(entries) if self.size() <= BROADCAST_ENTRIES else entries

    def with_start_end(self, start: str, end: str) -> Dictionary:
        """Codes n and n + 1 for two virtual activities."""
        n, spark = self.size(), self.entries.sparkSession
        more = spark.createDataFrame([(n, start), (n + 1, end)], "code int, value string")
        return Dictionary(self.entries.unionByName(more), n + 2)

    def encode(self, df: DataFrame, column: str, code: str, unknown: int = -1) -> DataFrame:
        """df with the code of column: unknown for a value without one, null for null."""
        found = df.join(self._side(self.entries.select(F.col("code").alias("code__"), F.col("value").alias("value__"))), F.col(column) == F.col("value__"), "left")
        return found.withColumn(code, F.when(F.col(column).isNotNull(), F.coalesce("code__", F.lit(unknown)))).drop("code__", "value__")

    def decode(self, df: DataFrame, code: str, column: str) -> DataFrame:
        """df with the value of code, or null."""
        return df.join(self._side(self.entries.select(F.col("code").alias("code__"), F.col("value").alias(f"{column}__"))), F.col(code) == F.col("code__"), "left").withColumn(column, F.col(f"{column}__")).drop("code__", f"{column}__")

    def encode_array(self, df: DataFrame, arrays: str, codes: str, unknown: int = -1) -> DataFrame:
        """Elementwise: unknown for an element without a code, null for a null element or array."""
        return _elementwise(df, arrays, codes, lambda x: self.encode(x, "item__", "new__", unknown))

    def decode_array(self, df: DataFrame, codes: str, column: str) -> DataFrame:
        """Elementwise; an unknown code gives null. A dictionary under the bound goes along as one array; elements are joined with a larger one."""
        if self.size() > BROADCAST_ENTRIES:
            return _elementwise(df, codes, column, lambda x: self.decode(x, "item__", "new__"))
        values = F.transform(F.array_sort(F.collect_list(F.struct("code", "value"))), lambda e: e["value"])
        return df.crossJoin(F.broadcast(self.entries.agg(values.alias("values__")))).withColumn(column, F.transform(codes, lambda i: F.get(F.col("values__"), i))).drop("values__")  # one row beside each

    def filter(self, df: DataFrame, code: str, condition: Callable[[Column], Column]) -> DataFrame:
        """Rows whose value meets a condition, evaluated once for each entry; a null code counts as a null value."""
        hits = self.entries.filter(condition(F.col("value"))).select(F.col("code").alias("code__"))
        kept = df.join(self._side(hits), F.col(code) == F.col("code__"), "left_semi")
        for_null = df.filter(F.col(code).isNull() & condition(F.lit(None).cast("string")))
        return kept.unionByName(for_null)

    def map(self, expression: Callable[[Column], Column]) -> Dictionary:
        """An execution dictionary: the expression's value for each code."""
        out = Dictionary(self.entries.select("code", expression(F.col("value")).alias("value")), self._size)
        out._mapped = True
        return out


def numbered(values: DataFrame, buckets: int = 1024) -> DataFrame:
    """Distinct values to (code, value), numbered in hash buckets of their own; the counts of all buckets are a small table."""
    dealt = values.withColumn("bucket__", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    before = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket__").agg(F.count(F.lit(1)).alias("n__")).select("bucket__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    own = F.row_number().over(Window.partitionBy("bucket__").orderBy("value"))
    return dealt.withColumn("own__", own).join(F.broadcast(starts), "bucket__").select((F.col("start__") + F.col("own__") - 1).cast("int").alias("code"), "value")  # a row per bucket is broadcast


def _elementwise(df: DataFrame, arrays: str, out: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the array out of what change() adds as new__ beside each element item__.

    Rows are numbered once and not read again: a row's columns travel with its first element.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row__"), F.struct(*df.columns).alias("kept__"))
    items = rows.select("row__", "kept__", F.posexplode_outer(F.col("kept__")[arrays]).alias("at__", "item__"))
    items = change(items.withColumn("kept__", F.when(F.coalesce("at__", F.lit(0)) == 0, F.col("kept__"))))
    item = F.when(F.col("at__").isNotNull(), F.struct("at__", "new__"))
    rows = items.groupBy("row__").agg(F.first("kept__", ignorenulls=True).alias("kept__"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["new__"]).alias("list__"))
    return rows.select(*[F.col("kept__")[c].alias(c) for c in df.columns], F.when(F.col("kept__")[arrays].isNotNull(), F.col("list__")).alias(out))


class Dictionaries:
    """Dictionaries by (table, column)."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Dictionary] = {}

    def register(self, table: str, column: str, dictionary: Dictionary) -> None:
        self._known[table, column] = dictionary

    def get(self, table: str, column: str) -> Dictionary:
        return self._known[table, column]

    def release(self, table: str, column: str) -> None:
        self._known.pop((table, column), None)


def group_encoded(df: DataFrame, code: str, dictionary: Dictionary, column: str, *aggregates: Column) -> DataFrame:
    """Groups by code and decodes the groups last."""
    return dictionary.decode(df.groupBy(code).agg(*aggregates), code, column).drop(code)


#: Functions of one value that may be evaluated on dictionary entries, by name: each gives the same for equal values.
_REWRITES: dict[str, Callable[..., Column]] = {
    name: (lambda f: lambda value, *args: F.call_function(f, value, *[F.lit(a) for a in args]))(name)
    for name in ("upper", "lower", "trim", "ltrim", "rtrim", "reverse", "initcap", "length", "substring", "concat", "replace", "regexp_replace", "regexp_extract", "lpad", "rpad", "repeat", "translate", "md5", "sha1", "startswith", "endswith", "contains", "like", "rlike")
}


def register_rewrite(name: str, builder: Callable[..., Column]) -> None:
    """Offers a deterministic function of a value (and constants) to Encoded.with_function; the last one of a name holds."""
    _REWRITES[name.lower()] = builder


class Encoded:
    """A DataFrame of which some columns are held as codes. Conditions and functions of such a column are evaluated once for each entry of its dictionary, groups and joins use the codes, and values come back in decoded(), last of all."""

    def __init__(self, df: DataFrame, dictionaries: dict[str, Dictionary]) -> None:
        self.df, self.dictionaries = df, dictionaries

    @classmethod
    def of(cls, df: DataFrame, *columns: str) -> Encoded:
        dictionaries = {c: Dictionary.of(df, c) for c in columns}
        for c, x in dictionaries.items():
            order = df.columns
            df = x.encode(df, c, "code__new").drop(c).withColumnRenamed("code__new", c).select(*order)
        return cls(df, dictionaries)

    def where(self, column: str, condition: Callable[[Column], Column]) -> Encoded:
        if column not in self.dictionaries:
            return Encoded(self.df.filter(condition(F.col(column))), self.dictionaries)
        return Encoded(self.dictionaries[column].filter(self.df, column, condition), self.dictionaries)

    def with_function(self, out: str, name: str, column: str, *constants) -> Encoded:
        """A column of function name: on the entries if it is registered and column is encoded, else row by row."""
        builder = _REWRITES.get(name.lower())
        if column in self.dictionaries and builder:
            return Encoded(self.df.withColumn(out, F.col(column)), self.dictionaries | {out: self.dictionaries[column].map(lambda v: builder(v, *constants))})
        rows = self.decoded(column) if column in self.dictionaries else self
        call = builder or (lambda v, *args: F.call_function(name, v, *[F.lit(a) for a in args]))
        return Encoded(rows.df.withColumn(out, call(F.col(column), *constants)), rows.dictionaries)

    def group_by(self, *keys: str) -> Callable[..., Encoded]:
        """encoded.group_by("a")(F.count("b")): codes stay codes. A mapped column, whose entries may share a value, is decoded first."""
        mapped = [k for k in keys if k in self.dictionaries and getattr(self.dictionaries[k], "_mapped", False)]
        rows = self.decoded(*mapped) if mapped else self
        return lambda *aggregates: Encoded(rows.df.groupBy(*keys).agg(*aggregates), {k: v for k, v in rows.dictionaries.items() if k in keys})

    def join(self, other: Encoded, column: str, how: str = "inner") -> Encoded:
        """By codes if both sides share the column's dictionary, else by values."""
        if self.dictionaries.get(column) is not other.dictionaries.get(column):
            a, b = (x.decoded(column) if column in x.dictionaries else x for x in (self, other))
            return Encoded(a.df.join(b.df, column, how), b.dictionaries | a.dictionaries)
        return Encoded(self.df.join(other.df, column, how), other.dictionaries | self.dictionaries)

    def decoded(self, *columns: str) -> Encoded:
        df, rest = self.df, dict(self.dictionaries)
        for c in columns or list(rest):
            order = df.columns
            df = rest.pop(c).decode(df, c, "value__new").drop(c).withColumnRenamed("value__new", c).select(*order)
        return Encoded(df, rest)
