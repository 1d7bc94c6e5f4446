"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Each map task turns chunks of documents into rolling window hashes (80 bits),
and sends them packed, dealt by hash, to the task that counts that hash. A
window that already repeats within its chunk is sent once, without a place, so
that no hash gathers more entries than there are chunks. Places of repeated
windows return to their chunk and from there to their document, where
overlapping windows merge into maximal removal intervals.

Defined results: a null text has no words; a document shorter than the window
loses nothing; repeated rows (same doc_id and text) count as two places, so each
loses all its windows; rows with a null doc_id are processed like any other; very
long texts are read whole; an empty table gives an empty result; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, partitions, runs, slices, texts_of, words_of

WINDOW = 35
#: Windows that a map task hashes at a time; bounds its memory.
CHUNK = 1 << 20
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

#: Hash places that a range holds on average; a task counts range after range, so its memory doesn't grow with the corpus.
RANGE = 8 << 20

_ENTRY = pa.schema([("part", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary()), ("places", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("places", pa.binary())])
_PLACE = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("places", pa.binary())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of all windows of a word sequence: differences of prefix sums of word * base**place, divided by base**start, mod 2**64."""

    def __init__(self, window: int) -> None:
        self.window, self.size = window, 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.up = [_powers(b, self.size) for b in BASES]
            self.down = [_powers(pow(b, -1, 1 << 64), self.size) for b in BASES]

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(words) - self.window + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.uint16)
        self._grow(len(words))
        out = []
        for k in range(2):
            w = words if k == 0 else mix64(words ^ np.uint64(0x5851F42D4C957F2D))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * self.up[k][: len(w)], dtype=np.uint64)])
            out.append(mix64((sums[self.window :] - sums[:n]) * self.down[k][:n]))
        return out[0], (out[1] >> np.uint64(48)).astype(np.uint16)


def _repeats(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and for each place of it whether a neighbour has the same hash."""
    order = np.argsort(hi)
    h, x = hi[order], lo[order]
    same = h[1:] == h[:-1]
    if np.any(same & (x[1:] != x[:-1])):
        order = np.lexsort((lo, hi))
        h, x = hi[order], lo[order]
        same = h[1:] == h[:-1]
    same &= x[1:] == x[:-1]
    return order, same


def _either(same: np.ndarray) -> np.ndarray:
    out = np.zeros(len(same) + 1, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _gaps(places: np.ndarray) -> bytes:
    """Ascending places as gaps of one or two bytes, longer ones after them."""
    gaps = np.diff(places, prepend=0)
    kind, most = ("<u1", 255) if len(gaps) and gaps.mean() < 60 else ("<u2", 65535)
    return b"12"[most > 255 :][:1] + len(gaps).to_bytes(4, "little") + np.minimum(gaps, most).astype(kind).tobytes() + gaps[gaps >= most].astype("<u4").tobytes()


def _ungapped(raw: bytes) -> np.ndarray:
    kind, most = ("<u1", 255) if raw[:1] == b"1" else ("<u2", 65535)
    n = int.from_bytes(raw[1:5], "little")
    gaps = np.frombuffer(raw, kind, n, 5).astype(np.int64)
    gaps[gaps == most] = np.frombuffer(raw, "<u4", -1, 5 + n * np.dtype(kind).itemsize)
    return np.cumsum(gaps)


def _batches(rows: list[tuple], schema: pa.Schema, step: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), step):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + step], strict=True), schema, strict=True)], schema=schema)


def _mapper(window: int, parts: int, each: int):
    """Rows of two kinds: of each chunk, its documents and the places known to repeat; and for each range of hashes, each of them to a part, hashes with their places in the chunk (none if known)."""
    ranges = parts * each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        hashes, roll, z = WordHashes(), _Rolling(window), zstandard.ZstdCompressor(level=3)
        held: list = []

        def flush():
            docs = np.array([(*x[:3], len(x[3])) for x in held], np.int64).tobytes()
            chunk = int(np.uint64(xxhash.xxh64_intdigest(docs)).view(np.int64))  # the same if the task runs again
            hi, lo = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
            held.clear()
            order, same = _repeats(hi, lo)
            known = np.zeros(len(hi), bool)
            known[order] = _either(same)
            first = np.zeros(len(hi), bool)  # one of each hash that repeats here
            first[order[~np.concatenate([[False], same])]] = True
            first &= known
            yield from _batches([(chunk % parts, -1, chunk, z.compress(docs), None, None, z.compress(_gaps(np.flatnonzero(known))))], _ENTRY, 1)
            part = ((hi >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            for plain in (True, False):
                pick = np.flatnonzero(~known if plain else first)
                pick = pick[np.argsort(part[pick], kind="stable")]
                cuts = np.searchsorted(part[pick], np.arange(ranges + 1))
                rows = []
                for k in range(ranges):
                    own = pick[cuts[k] : cuts[k + 1]]
                    if len(own):
                        rows.append((k // each, k, chunk, None, hi[own].tobytes(), lo[own].tobytes(), _gaps(own) if plain else None))
                yield from _batches(rows, _ENTRY, 64)

        total = 0
        for batch in slices(batches):
            names = batch.schema.names
            for d, v, text in zip(batch.column(names.index("doc_id")).to_pylist(), batch.column(names.index("version")).to_pylist(), texts_of(batch), strict=True):
                hi, lo = roll(hashes.array(words_of(text)))
                if not len(hi):
                    continue
                if total + len(hi) > CHUNK and held:
                    yield from flush()
                    total = 0
                held.append((d or 0, d is None, v, hi, lo))
                total += len(hi)
        if held:
            yield from flush()

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of hashes after another: the places of those met more than once, by chunk. Rows about a chunk's documents, which come first, pass."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    now, held = None, ([], [], [], [], [])
    for batch in batches:
        for r in batch.select(["range", "chunk", "docs", "hi", "lo", "places"]).to_pylist():
            if r["hi"] is None:
                yield from _batches([(r["chunk"], r["docs"], r["places"])], _REPLY, 1)
                continue
            if r["range"] != now:
                yield from _counted(z, *held)
                now, held = r["range"], ([], [], [], [], [])
            chunks, sizes, his, los, ats = held
            his.append(np.frombuffer(r["hi"], np.uint64))
            los.append(np.frombuffer(r["lo"], np.uint16))
            ats.append(np.full(len(his[-1]), -1, np.int32) if r["places"] is None else _ungapped(r["places"]).astype(np.int32))
            chunks.append(r["chunk"])
            sizes.append(len(his[-1]))
    yield from _counted(z, *held)


def _counted(z, chunks: list, sizes: list, his: list, los: list, ats: list) -> Iterator[pa.RecordBatch]:
    if not his:
        return
    hi, lo, at = np.concatenate(his), np.concatenate(los), np.concatenate(ats)
    his.clear(), los.clear(), ats.clear()
    order, same = _repeats(hi, lo)
    hit = np.zeros(len(hi), bool)
    hit[order] = _either(same)
    hit &= at >= 0
    starts = runs(np.array(sizes))
    for k, chunk in enumerate(chunks):
        own = slice(starts[k], starts[k + 1])
        found = at[own][hit[own]]
        if len(found):
            yield from _batches([(chunk, None, z.compress(_gaps(found)))], _REPLY, 1)


def _collector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to the places of each document that has any."""
    import zstandard

    z = zstandard.ZstdDecompressor()

    def finish(docs, places):
        if docs is None or not places:
            return
        docs = np.frombuffer(docs, np.int64).reshape(-1, 4)
        at = np.unique(np.concatenate(places))
        starts = runs(docs[:, 3])
        cuts = np.searchsorted(at, starts)
        rows = [(None if docs[k, 1] else int(docs[k, 0]), int(docs[k, 2]), (at[cuts[k] : cuts[k + 1]] - starts[k]).astype("<i4").tobytes()) for k in np.flatnonzero(np.diff(cuts))]
        yield from _batches(rows, _PLACE, 1000)

    now, docs, places = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != now:
                yield from finish(docs, places)
                now, docs, places = r["chunk"], None, []
            docs = z.decompress(r["docs"]) if r["docs"] is not None else docs
            found = _ungapped(z.decompress(r["places"]))
            if len(found):
                places.append(found)
    yield from finish(docs, places)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("version")), pa.array([z.compress(t) for t in texts_of(batch)], pa.binary())], ["doc_id", "version", "packed"])


def _finisher(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from itertools import compress

        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                words = words_of(z.decompress(r["packed"]))
                kept, spans = words, []
                if r["places"]:
                    starts = np.unique(np.concatenate([np.frombuffer(p, "<i4") for p in r["places"]]))
                    cut = np.flatnonzero(np.diff(starts) > window)
                    spans = list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + window).tolist(), strict=True))
                    keep = np.ones(len(words), bool)
                    for a, b in spans:
                        keep[a:b] = False
                    kept = list(compress(words, keep))
                text = b" ".join(kept)
                rows.append((r["doc_id"], len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace"), [{"start": a, "end": b} for a, b in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, n_removed, kept_sha256, kept_text, removed: word intervals, end exclusive)."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # roughly
    each = max(1, -(-words // (RANGE * parts)))
    entries = rows.mapInArrow(_mapper(window, parts, each), "part int, range int, chunk long, docs binary, hi binary, lo binary, places binary")
    replies = entries.repartitionById(parts, F.col("part")).sortWithinPartitions("range").mapInArrow(_counter, "chunk long, docs binary, places binary")
    replies = replies.repartitionById(parts, F.pmod("chunk", F.lit(parts)).cast("int")).sortWithinPartitions("chunk")
    found = replies.mapInArrow(_collector, "doc_id long, version long, places binary")
    found = found.groupBy("doc_id", "version").agg(F.collect_set("places").alias("places")).select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "places")  # one each, but for repeated rows
    packed = rows.mapInArrow(_packed, "doc_id long, version long, packed binary")
    joined = packed.join(found, packed.doc_id.eqNullSafe(found.d) & (packed.version == found.v), "left")
    return joined.select("doc_id", "packed", "places").mapInArrow(_finisher(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:long,end:long>>")
