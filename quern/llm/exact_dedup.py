"""Exact dedup by distributed MSD radix partitioning.

A text's digits are its length, then its bytes. Each round splits every open
group by its next digits (count and least row are combined before the shuffle,
so a hot group costs one row per map task); groups that are singleton or ended
leave, the others go on with what follows of their texts. Digits themselves are
the keys: equality needs no digest.

Defined results: null counts as the empty text; of rows repeated with one doc_id
one stays; a null doc_id is the smallest; an empty table gives an empty result;
very long texts are compared whole, round after round; columns other than doc_id
and text are ignored and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, least_row, restored, row_key, slices, stored, texts_of

#: Bytes that the first round reads beside the length.
HEAD = 24
#: Bytes that later rounds read: this many, then GROWTH times as many each.
STEP, GROWTH = 4096, 16


def _reader(with_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in slices(batches):
            names = b.schema.names
            norm = [x.lower() for x in texts_of(b)]  # bytes: A-Z only
            cols = {"n_bytes": pa.array([len(x) for x in norm], pa.int64()), "head": pa.array([x[:HEAD] for x in norm], pa.binary())}
            if with_digest:
                cols |= {c: b.column(names.index(c)) for c in ("doc_id", "version")}
                cols |= {"text_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string()), "rest": pa.array([x[HEAD:] for x in norm], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


_KEYS = "n_bytes long, head binary"


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row per row: doc_id, version (xxhash64 of its text), keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    heads = rows.select("text").mapInArrow(_reader(False), _KEYS).groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("group_size"))
    heads = stored(heads.filter("group_size > 1"))  # as a table, so that the join below can split a hot group's rows
    full = rows.mapInArrow(_reader(True), _KEYS + ", doc_id long, version long, text_sha256 string, rest binary")
    first = full.join(heads.hint("merge"), ["n_bytes", "head"], "left")  # the plan of large tables at every size
    shared = F.col("group_size").isNotNull()
    first = stored(first.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "version", "text_sha256", shared.alias("open"), *[F.when(shared, F.col(c)).alias(c) for c in ("n_bytes", "head", "rest")]))
    parts = [first.filter("not open").select("doc_id", "version", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")]
    step, node = STEP, ["n_bytes", "head"]
    rows = first.filter("open")
    while True:
        rows = rows.withColumn("digits", F.expr(f"substring(rest, 1, {step})"))
        rows = rows.withColumn("rest", F.expr(f"substring(rest, {step + 1})"))
        keys = [*node, "digits"]
        groups = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min("rid").alias("next"), F.max(F.struct("doc_id", "rid")).alias("best")))
        split = rows.select("rid", "doc_id", "version", "text_sha256", "rest", *keys).join(groups.hint("merge"), keys)
        ended = (F.col("group_size") == 1) | (F.length("rest") == 0)
        split = stored(split.select("rid", "doc_id", "version", "text_sha256", F.col("next").alias("node"), "group_size", "best", (~ended).alias("open"), F.when(~ended, F.col("rest")).alias("rest")))
        parts.append(split.filter("not open").select("doc_id", "version", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept"), "text_sha256"))
        rows = split.filter("open").select("rid", "doc_id", "version", "text_sha256", "node", "rest")
        if rows.isEmpty():
            break
        node, step = ["node"], step * GROWTH
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, in the columns of docs. Of rows that share doc_id and text, the least by all columns stays."""
    stay = exact_groups(docs).filter("kept").select(row_key(F.col("doc_id"), F.col("version")))
    return restored(keyed(docs).join(stay, "row_key", "left_semi").groupBy("row_key").agg(least_row(docs)), docs)


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
