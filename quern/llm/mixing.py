"""Mixing sources to target weights with DataFrame functions only.

Every document gets a hash-random key. Keys are cut into ranges within each
source; range totals give each range its offset, and a running sum within the
range completes the distributed prefix sum, so no source is ever gathered in
one task. Each source is cut at its exact budget of words: whole epochs first,
then documents in key order, the last of them in part.

Defined results: a null text has size 0; null is a source of its own and comes
last; documents of size 0 take nothing; rows repeated with one doc_id are mixed
as separate documents; very long texts are counted whole; an empty table gives an
empty result. Only doc_id, text and source are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, least_row, partitions, restored, row_key, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Key ranges of each source, at least; twice the shuffle partitions if that is more. The result is the same for any number.
RANGES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _source_key(source: Column) -> Column:
    """Never null, in the order of code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix_key(doc_id: Column, text: Column) -> Column:
    """Hash-random, and in DuckDB the same; rows of one id or without any are told apart by their texts."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix:"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(src, source_size) to the same with target: share of all sizes dealt by weight, none above most times its source, the excess dealt again.

    With sources in the order of size to weight, filling those before one of them leaves a level for it and the rest; the levels rise until one fits and then fall, so the largest holds.
    The table has one row per source.
    """
    by_name, everything = Window.orderBy("src"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.select("*", F.sum("cap").over(everything).alias("caps"), F.sum("w").over(everything).alias("ws"), F.sum("cap").over(rising).alias("cap_to"), F.sum("w").over(rising).alias("w_to"))
    left = F.col("caps") / most * share - (F.col("cap_to") - F.col("cap"))
    full = full.withColumn("level", left / (F.col("ws") - (F.col("w_to") - F.col("w"))))
    full = full.withColumn("level", F.max("level").over(everything))
    return full.select("src", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, version: xxhash64 of its text, size, source_size, target, taken)."""
    ranges = ranges or max(RANGES, 2 * partitions(docs.sparkSession))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), _source_key(F.col("source")).alias("src"), n_words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("mix_key"))
    rows = stored(rows.withColumn("mix_range", F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")))  # texts are read once
    totals = rows.groupBy("src", "mix_range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("src").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("src", "mix_range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before_range"))
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    offsets = offsets.join(targets(sizes, weights, share, most), "src")
    within = Window.partitionBy("src", "mix_range").orderBy("mix_key", "doc_id", "size", "version").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["src", "mix_range"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1))).cast("long")).otherwise(F.lit(0))
    placed = placed.withColumn("budget", budget).withColumn("epochs", epochs)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before_range") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select("doc_id", "version", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of docs: a document once for each epoch that takes it whole, and once more cut after the words that its last epoch takes.

    Rows that repeat a doc_id and its text stand for one document that takes what they take together, with the least of their other columns.
    """
    taken = mix(docs).filter("taken > 0").groupBy(row_key(F.col("doc_id").cast("long"), F.col("version"))).agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    out = keyed(docs).join(taken, "row_key").groupBy("row_key").agg(least_row(docs), F.max("taken").alias("taken"), F.max("size").alias("size"))
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    text = F.col("row")[f"c{docs.columns.index('text')}"]
    cut = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words.cast("int")), "")
    out = out.withColumn("is_cut", words < F.col("size")).withColumn("cut", F.when(F.col("is_cut"), cut).otherwise(text))
    changed = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("is_cut"), F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")[f"c{docs.columns.index('n_chars')}"])
    return restored(out, docs, **changed)


ORACLE_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix:' || md5(coalesce(text, ''))) AS k,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src
  FROM documents),
s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * CAST(sum(size) AS DOUBLE) AS cap,
         CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM r GROUP BY src),
a AS (
  SELECT *, sum(cap) OVER () AS caps, sum(w) OVER () AS ws,
         sum(cap) OVER (ORDER BY cap / w, src ROWS UNBOUNDED PRECEDING) AS cap_to,
         sum(w) OVER (ORDER BY cap / w, src ROWS UNBOUNDED PRECEDING) AS w_to
  FROM s),
b AS (SELECT *, (caps / 2.0::DOUBLE * 1.5::DOUBLE - (cap_to - cap)) / (ws - (w_to - w)) AS level FROM a),
c AS (SELECT *, max(level) OVER () AS final_level FROM b),
t AS (SELECT src, source_size, least(cap, final_level * w) AS target FROM c),
p AS (
  SELECT r.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r JOIN t USING (src)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM q
"""
