"""What several operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python patterns of a word: anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, only a session on this machine alone has one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/quern-shared"
    return at.rstrip("/")


#: Folders that stored() has written and nothing has deleted, by session.
_left: dict[str, SparkSession] = {}
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What lies there is deleted by dropped() or release(), or else when the driver ends."""
    at = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _left[at] = spark
    if (made := _made.get()) is not None:
        made.append(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends here, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    at = shared_path(spark, "table")
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._quern_path = at
    return out


def _delete(at: str, spark: SparkSession) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote for df."""
    at = getattr(df, "_quern_path", None)
    if at in _left:
        _delete(at, _left.pop(at))


@contextlib.contextmanager
def folders() -> Iterator[list[str]]:
    """The shared paths that are made within, for release() once the results that need them have been written."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def release(paths: list[str]) -> None:
    for at in paths:
        if at in _left:
            _delete(at, _left.pop(at))


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        release(list(_left))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 512):
    """Record batches of a bounded number of rows, so that few texts are unpacked at a time.

    What Arrow has freed goes back to the system after each batch: else an idle worker holds it beside its executor.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() cuts at exactly the ASCII white space of WORD."""
    return text.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising bijection of 64-bit values, applied elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def reuse_memory() -> None:
    """From now on this Python worker's large arrays are cut from its own heap again, not mapped anew each time; at most 256 MB that are free stay with it."""
    import ctypes

    try:
        put = ctypes.CDLL(None).mallopt
    except AttributeError:  # another C library
        return
    put(-3, 32 << 20)  # M_MMAP_THRESHOLD, its greatest value
    put(-1, 256 << 20)  # M_TRIM_THRESHOLD


def kept(name: str, make):
    """What make() gave under this name in this Python worker: it outlives a task."""
    store = sys.modules.setdefault("_quern_kept", types.ModuleType("_quern_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound and then forgotten as a whole."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 17)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def renamed(docs: DataFrame, prefix: str) -> DataFrame:
    """docs with its columns numbered after a prefix, so that no column of the user's clashes with an operator's."""
    return docs.toDF(*[f"{prefix}{k}" for k in range(len(docs.columns))])


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any columns) to (row_key: doc_id and a hash of the text, nulls alike; row: a struct of all columns)."""
    inner = renamed(docs, "c")
    at = {c: inner[f"c{k}"] for k, c in reversed(list(enumerate(docs.columns)))}
    return inner.select(row_key(at["doc_id"].cast("long"), F.xxhash64(at["text"])), F.struct(*inner.columns).alias("row"))


def row_key(doc_id: Column, version: Column) -> Column:
    return F.struct(doc_id.alias("id"), version.alias("version")).alias("row_key")


def least_row(docs: DataFrame) -> Column:
    """Of keyed rows with one key, the least by all columns, so that reruns agree; columns without an order are compared as JSON."""
    ordered = not any(x in f.dataType.simpleString() for f in docs.schema for x in ("map<", "variant", "interval"))
    return (F.min("row") if ordered else F.min_by("row", F.to_json("row"))).alias("row")


def restored(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """rows (row, ..) of keyed(docs) in the columns of docs; changed: other values by name."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])


def md5_key(column, salt: str):
    """A hash-random text key that DuckDB's md5() gives too."""
    return F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), F.lit(f":{salt}")))


def runs(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive runs of the given lengths."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
