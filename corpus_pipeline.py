"""A training-data pipeline: toxic documents go, then exact and near copies, then sources are mixed to target weights, then the mix is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage
returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from quern.llm.common import documents, folders, labels, release, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that toxicity's model, learned from the labels of sf_dir, scores at its threshold or above. Null and empty texts stay; without labels all do."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id; null counts as empty, a null doc_id as smallest."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links within its radius, the one with the smallest doc_id."""
    return simhash_dedup.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, the last time perhaps in part; documents without words go."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in windows of tokens, with their ids."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Stages such as SimHash linking and packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. What a stage leaves in the shared folder goes as soon as the next one has been written; an empty table gives none."""
    docs, last = documents(spark, sf_dir), []
    for k, (name, stage) in enumerate(STAGES):
        at = shared_path(spark, f"{k}-{name}")
        with folders() as made:
            stage(spark, docs, sf_dir).write.parquet(at)
        release(made + last)
        docs, last = spark.read.parquet(at), [at]
    return docs
