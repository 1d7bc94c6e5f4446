"""Column builders for functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of the units whose difference is fractional.
FRACTIONAL = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """end - start in unit: a double with its fraction for hours and smaller units, whole units as bigint above."""
    unit = unit.upper().rstrip("S") if unit.upper() != "S" else unit
    start, end = _col(start), _col(end)
    if unit in FRACTIONAL:
        return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(FRACTIONAL[unit]))
    return F.timestamp_diff(unit, start, end)


def array_position_instance(array: Column | str, value: Column, n: Column | int) -> Column:
    """1-based place of the n-th element equal to value: from the left for n > 0, from the right by abs(n) for n < 0; 0 if absent or n = 0; null if an argument is null."""
    array = _col(array)
    n = F.lit(n) if isinstance(n, int) else n
    hits = F.filter(F.transform(array, lambda x, i: F.when(x == value, i + 1)), lambda p: p.isNotNull())
    at = F.when(n > 0, F.get(hits, n - 1)).when(n < 0, F.get(hits, F.size(hits) + n)).otherwise(F.lit(0))
    return F.when(array.isNull() | value.isNull() | n.isNull(), F.lit(None)).otherwise(F.coalesce(at, F.lit(0))).cast("int")


def array_frequency(array: Column | str) -> Column:
    """Map of element to its count; nulls don't count; null for a null array."""
    there = F.filter(_col(array), lambda x: x.isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(there), lambda v: F.struct(v, F.size(F.filter(there, lambda x: x == v)))))


def unnest(*arrays: Column) -> Column:
    """A generator that zips arrays into rows, padding with nulls; name its columns with alias()."""
    return F.inline(F.arrays_zip(*arrays))


def count_all(*columns: Column | str) -> Column:
    """Rows in which no column is null; 0 over no rows."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & _col(c).isNotNull()
    return F.count(F.when(whole, F.lit(1)))
