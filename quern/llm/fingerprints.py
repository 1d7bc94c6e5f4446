"""Document fingerprints: SimHash over weighted terms, and permuted block tables that find all fingerprints within a Hamming radius.

Terms are lower-cased words and 5-word shingles (fewer words: the whole
sequence); a term's weight grows with the logarithm of its count, and words
weigh a fraction of a shingle, so that common words don't make unrelated texts
alike. Each term's 128 hash bits vote its weight up or down. The tables hold every
document's fingerprint; those asked for are looked up in all of them.

Defined results: a null text is empty; an empty text has fingerprint zero;
equal texts have equal fingerprints; rows with one doc_id follow each other in
descending order of text; null ids come after all others and aren't asked for; the only row of a table is
its own next one; repeated rows are each other's neighbours; very long texts are read whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, partitions, slices, stored, texts_of, words_of

BITS = 128
SHINGLE = 5
WORD_WEIGHT = 0.2
#: Documents whose terms vote at a time.
CHUNK = 512
#: Bits in which fingerprints that the block tables find may differ.
RADIUS = 3
#: Neighbours are searched for documents whose id is divisible by this.
ASKED = 50


class Fingerprinter:
    def __init__(self, bits: int = BITS, shingle: int = SHINGLE, word_weight: float = WORD_WEIGHT) -> None:
        self.bits, self.shingle, self.word_weight, self.hashes = bits, shingle, word_weight, WordHashes()
        self.votes = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        w = self.hashes.array(words_of(text.lower()))
        if not len(w):
            return w, np.empty(0)
        n = min(self.shingle, len(w))
        grams = np.full(len(w) - n + 1, np.uint64(n))
        for i in range(n):
            grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
        g, gc = np.unique(grams, return_counts=True)
        u, uc = np.unique(w, return_counts=True)
        return np.concatenate([g, u]), np.concatenate([1 + np.log(gc), self.word_weight * (1 + np.log(uc))])

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Rows of bits / 8 bytes."""
        out = np.zeros((len(texts), self.bits // 8), np.uint8)
        for at in range(0, len(texts), CHUNK):
            found = [self.terms(t) for t in texts[at : at + CHUNK]]
            n = len(found)
            doc = np.repeat(np.arange(n), [len(h) for h, _ in found]) * 256
            h, w = np.concatenate([h for h, _ in found]), np.concatenate([w for _, w in found])
            for word in range(self.bits // 64):
                lanes = mix64(h ^ np.uint64(0xA0761D6478BD642F * (word + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
                for k in range(8):
                    mass = np.bincount(doc + lanes[:, k], weights=w, minlength=n * 256).reshape(n, 256)
                    out[at : at + n, 8 * word + k] = np.packbits(mass @ self.votes > 0, axis=1).ravel()
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 1 (same) to 0 (half of the bits or more differ): the cosine that the differing bits estimate."""
    bits = 8 * a.shape[1]
    differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return np.clip(np.cos(np.pi * differ / bits), 0, 1)


def _dealer(bounds: np.ndarray, tops: dict[int, int | None], parts: int, with_text: bool):
    """Deals rows by ranges of doc_id; the topmost document of a range goes to the range above too, where it is the last one's next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        above = {below: p for p, below in tops.items()}
        for b in slices(batches):
            ids = b.column(b.schema.names.index("doc_id")).to_pylist()
            part = [0 if d is None else int(np.searchsorted(bounds, d, "left")) for d in ids]
            if not with_text:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64())], ["part", "doc_id"])
                continue
            texts = [z.compress(t) for t in texts_of(b)]
            ghost = [k for k, d in enumerate(ids) if d in above]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part + [above[ids[k]] for k in ghost], pa.int32()),
                    pa.array(ids + [ids[k] for k in ghost], pa.int64()),
                    pa.array([False] * len(ids) + [True] * len(ghost)),
                    pa.array(texts + [texts[k] for k in ghost], pa.binary()),
                ],
                ["part", "doc_id", "ghost", "packed"],
            )

    return run


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        z, prints = zstandard.ZstdDecompressor(), Fingerprinter(bits)

        def rows():
            """(part, doc_id, is a ghost, text), equal ids by descending text."""
            held: list = []
            for b in slices(batches):
                for r in b.to_pylist():
                    key = (r["part"], r["ghost"], r["doc_id"])
                    if held and held[-1][0] != key:
                        yield from sorted(held, key=lambda x: x[2], reverse=True)
                        held = []
                    held.append((key, r["doc_id"], z.decompress(r["packed"]).decode("utf-8", "surrogatepass")))
            yield from sorted(held, key=lambda x: x[2], reverse=True)

        def flush(chunk, ahead):
            texts = [x[2] for x in chunk] + [ahead[2]]
            edited = []
            for t, after in zip(texts[:-1], texts[1:], strict=True):
                cut = len(t) // 3
                edited.append((t[: len(t) - cut] + after[:cut]).encode("utf-8", "surrogatepass"))
            own, ed = prints([t.encode("utf-8", "surrogatepass") for t in texts]), prints(edited)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([x[1] for x in chunk], pa.int64()),
                    "n_chars": pa.array([len(x[2]) for x in chunk], pa.int64()),
                    "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                    "fingerprint": [x.tobytes().hex() for x in own[:-1]],
                    "edited_fingerprint": [x.tobytes().hex() for x in ed],
                    "near_edited": likeness(own[:-1], ed),
                    "near_next": likeness(own[:-1], own[1:]),
                }
            )

        chunk, size = [], 0
        for x in rows():
            (part, ghost, _), _, _ = x
            if chunk and (size > 8_000_000 or ghost and not chunk[-1][0][1]):
                yield from flush(chunk, x)
                chunk, size = [], 0
            if not ghost:
                chunk.append(x)
                size += len(x[2])

    return run


def edited_fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) to each document's fingerprint, that of its text with its last third replaced from the next document (descending doc_id, circular), and how alike they are.

    Only the bounds of the ranges and each range's highest id come to the driver.
    """
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [(k + 1) / parts for k in range(parts - 1)] or [1.0], F.lit(max(10_000, 20 * parts))).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(cuts[: parts - 1], np.int64))
    ids = rows.select("doc_id").mapInArrow(_dealer(bounds, {}, parts, False), "part int, doc_id long")
    tops = {r["part"]: r["top"] for r in ids.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    there = sorted(tops)
    below = {p: tops[there[k - 1]] for k, p in enumerate(there)}  # the first range wraps around to the last
    dealt = rows.mapInArrow(_dealer(bounds, below, parts, True), "part int, doc_id long, ghost boolean, packed binary")
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last())
    return dealt.mapInArrow(_in_order(bits), _RESULT)


def table_masks(bits: int, radius: int) -> list[list[int]]:
    """Of each table, the bits that it permutes to the front, as signed 64-bit words.

    Of radius + 1 blocks, one is alike in two fingerprints within the radius, and so is one of radius + 1 blocks of what is left;
    a table stands for each choice of the two (3 bits of 128: 16 tables of 56 bits).
    """
    digits = np.arange(bits // 4)
    masks = []
    for block in np.array_split(digits, radius + 1):
        for inner in np.array_split(np.setdiff1d(digits, block), radius + 1):
            front = sum(0xF << (bits - 4 - 4 * int(d)) for d in (*block, *inner))
            masks.append([(front >> at & (1 << 64) - 1 ^ 1 << 63) - (1 << 63) for at in range(bits - 64, -1, -64)])
    return masks


def _filed(fps: DataFrame, name: str, masks: list[list[int]]) -> DataFrame:
    """fps (fingerprint, other columns) once under its key in every table."""
    words = [F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("long") for k in range(len(masks[0]))]
    fps = fps.withColumn(name, F.array(*words))
    keys = [F.xxhash64(*[F.col(name)[k].bitwiseAND(F.lit(m)) for k, m in enumerate(mask)]) for mask in masks]
    return fps.select("*", F.posexplode(F.array(*keys)).alias("t", "block_key"))


def _within(index: DataFrame, queries: DataFrame, radius: int, bits: int) -> DataFrame:
    """Each pair of fingerprints within the radius, the same included, from the first table that holds both under one key.

    Both sides meet as plain exchanges, so that adaptive execution splits crowded keys; pairs are tested as they are formed.
    """
    masks = table_masks(bits, radius)
    a = _filed(queries.select("fingerprint"), "x", masks).withColumnRenamed("fingerprint", "query")
    b = _filed(index, "y", masks).withColumnRenamed("fingerprint", "found")
    differ = [F.col("x")[k].bitwiseXOR(F.col("y")[k]) for k in range(bits // 64)]
    distance = sum((F.bit_count(d) for d in differ), F.lit(0))
    alike = [sum((F.bit_count(d.bitwiseAND(F.lit(m))) for d, m in zip(differ, mask, strict=True)), F.lit(0)) == 0 for mask in masks]
    first = F.coalesce(*[F.when(same, F.lit(t)) for t, same in enumerate(alike)])
    pairs = a.join(b.hint("merge"), ["t", "block_key"]).filter(distance <= radius).filter(first == F.col("t"))
    return pairs.select("query", "found", distance.alias("distance"), *[c for c in index.columns if c != "fingerprint"])


def find_near(index: DataFrame, queries: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """index, queries (fingerprint: bits in hex) to (query, found, distance): each pair of different fingerprints within the radius, once."""
    return _within(index.select("fingerprint").distinct(), queries.select("fingerprint").distinct(), radius, bits).filter("query <> found")


def with_neighbours(prints: DataFrame, radius: int = RADIUS, bits: int = BITS, every: int = ASKED) -> DataFrame:
    """prints (doc_id, fingerprint, other columns) with n_near: how many other rows have a fingerprint within the radius.

    Asked for each doc_id divisible by every, against all rows; null elsewhere, so for null ids too. Rows with one fingerprint are
    counted before they are filed, so copies cost nothing.
    """
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    known = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = _within(known, prints.filter(asked).select("fingerprint").distinct(), radius, bits)
    near = near.groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    found = prints.filter(asked).join(near, F.col("fingerprint") == F.col("query")).drop("query")
    return prints.filter(~asked).withColumn("n_near", F.lit(None).cast("long")).unionByName(found)


def fingerprinted(docs: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) to edited_fingerprints() and with_neighbours() of them."""
    return with_neighbours(stored(edited_fingerprints(docs, bits)), radius, bits)
