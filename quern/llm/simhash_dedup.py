"""SimHash near-dedup by multi-index hashing.

Fingerprints have 64 bits, one for each bit set in over half of the XXH64 of a
document's 3-word shingles. A fingerprint is cut into two segments of 32 bits:
two fingerprints at 3 or fewer differing bits differ by at most one bit in one
of them. Each distinct fingerprint is filed under both segments and looks up the
Hamming ball of radius 1 about each (only clearing bits: of two segments that
differ in one bit, one has it set). Matches are verified over all 64 bits. A
table slot that many fingerprints share yields a spanning forest of its links,
not all pairs; components follow from the links.

The pipeline's stage compares whole texts by wider fingerprints (see
distinct_documents): 256 bits of five-word shingles, 16 segments of 16 bits, balls
of radius 2 about them, which miss no pair within 44 bits, and distances over all
256 bits.

Defined results: a null text is empty; no words give fingerprint zero, linked
like any other; a null doc_id is never the smallest of a component unless alone;
rows repeated with one doc_id each give a row; very long texts are read whole; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, least_row, mix64, partitions, restored, row_key, slices, stored, texts_of, words_of
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Slots of at most so many fingerprints compare all pairs; larger ones grow a forest.
SMALL = 12
#: Slots above this are split by the bytes of the other segment first. Like SMALL it changes the cost only: links within
#: 3 bits keep one of 4 bytes alike, so each is found in some part, and a forest connects what all pairs would.
LARGE = 4096
#: Table rows that a task holds at a time, besides those of a slot that has more.
HELD = 500_000


def fingerprint_array(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts."""
    from xxhash import xxh64_intdigest

    counts, hashes = np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        w = words_of(t.lower())
        grams = [b" ".join(g) for g in zip(*[w[i:] for i in range(shingle)], strict=False)] if len(w) >= shingle else [b" ".join(w)] if w else []
        counts[k] = len(grams)
        hashes += [xxh64_intdigest(g, SEED) for g in grams]
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        h = np.array(hashes, np.uint64)
        starts = np.concatenate([[0], np.cumsum(counts[full])])
        at = 0
        while at < len(full):  # a bounded number of unpacked bits at a time
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 500_000, "right")) - 1)
            to = min(to, len(full))
            bits = np.unpackbits(h[starts[at] : starts[to]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts[at:to] - starts[at], axis=0, dtype=np.int32)
            out[full[at:to]] = np.packbits(ones * 2 > counts[full[at:to], None], axis=1, bitorder="little").view(np.uint64).ravel()
            at = to
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        names, texts = b.schema.names, texts_of(b)
        yield pa.RecordBatch.from_arrays([b.column(names.index("doc_id")), b.column(names.index("version")), pa.array(fingerprint_array(texts).view(np.int64))], ["doc_id", "version", "fp"])


def _filed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp = np.unique(b.column(b.schema.names.index("fp")).slice(k, 4096).to_numpy(zero_copy_only=False).view(np.uint64))
                keys, fps = [], []
                for half in range(2):
                    seg = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                    top = np.uint64(half << 32)
                    keys.append(seg | top)
                    fps.append(fp)
                    for bit in range(32):
                        one = np.uint64(1 << bit)
                        on = (seg & one) != 0
                        keys.append((seg[on] ^ one) | top)
                        fps.append(fp[on])
                key, fps = np.concatenate(keys), np.concatenate(fps)
                part = ((mix64(key) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], ["part", "key", "fp"])

    return run


def _forest(fps: np.ndarray, other: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links of the given radius connect; other: the segment in which fps may differ freely."""
    if len(fps) > LARGE:
        for k in range(4):  # 3 differing bits leave one of 4 bytes alike
            byte = (fps >> np.uint64(32 * other + 8 * k)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(byte[order])) + 1):
                yield from _grown(part, radius)
    else:
        yield from _grown(fps, radius)


def _grown(left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                yield np.full(len(found), x), found
                todo += list(found)
                left = left[~near]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints that share a slot. Rows come sorted by slot; some whole slots at a time are in memory."""
    keys, fps, held = [], [], 0
    for b in batches:
        key = b.column(b.schema.names.index("key")).to_numpy(zero_copy_only=False).view(np.uint64)
        fp = b.column(b.schema.names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
        if keys and len(key) and held + len(key) > HELD and keys[0][0] != key[-1]:
            key, fp = np.concatenate([*keys, key]), np.concatenate([*fps, fp])
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last slot may go on
            yield from _slots(key[:cut], fp[:cut])
            key, fp, keys, fps, held = key[cut:], fp[cut:], [], [], 0
        keys.append(key.copy())
        fps.append(fp.copy())
        held += len(key)
    if held:
        yield from _slots(np.concatenate(keys), np.concatenate(fps))


def _slots(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within each of some whole slots, sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    key_few, fp_few = key[few], fp[few]
    for d in range(1, SMALL):
        if len(key_few) <= d:
            break
        x, y = fp_few[:-d], fp_few[d:]
        hit = (key_few[:-d] == key_few[d:]) & (x != y)
        hit[hit] = np.bitwise_count(x[hit] ^ y[hit]) <= RADIUS
        a.append(x[hit])
        b.append(y[hit])
    for k in np.flatnonzero(sizes > SMALL):
        half = int(key[starts[k]] >> np.uint64(32))
        for x, y in _forest(np.unique(fp[starts[k] : starts[k] + sizes[k]]), 1 - half):
            a.append(x)
            b.append(y)
    if a:
        pairs = np.stack([np.concatenate(a), np.concatenate(b)])
        pairs = np.unique(np.stack([pairs.max(0), pairs.min(0)]), axis=1) if pairs.shape[1] else pairs
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[1]).view(np.int64))], ["a", "b"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """fps (fp long) to links (a, b) that connect all fingerprints within the radius of each other."""
    parts = partitions(fps.sparkSession)
    filed = fps.select("fp").repartition(parts, "fp").mapInArrow(_filed(parts), "part int, key long, fp long")
    return filed.repartitionById(parts, F.col("part")).sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to a row per row: doc_id, version (xxhash64 of its text), fp, component_id, kept (one row's doc_id and version of each component)."""
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(_fingerprints, "doc_id long, version long, fp long"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "version")))
    distinct = rows.groupBy("fp").agg(first.alias("first"), F.min(F.struct("doc_id", "version")).alias("any"))
    found = components(fingerprint_links(distinct))
    labelled = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "any", "first", F.coalesce("root", "fp").alias("label"))
    labelled = stored(labelled)
    least = stored(labelled.groupBy("label").agg(F.coalesce(F.min("first"), F.min("any")).alias("best")))  # tables, so that adaptive execution splits a crowded label or fingerprint
    by_fp = stored(labelled.join(least.hint("merge"), "label").select("fp", "best"))
    out = rows.join(by_fp.hint("merge"), "fp")
    kept = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.version") == F.col("version"))
    return out.select("doc_id", "version", "fp", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


#: Of the wide fingerprints: words of a shingle, bits in which they may differ, and segments of two bytes: of 16 segments one has at most two of 44 differing bits.
#: Texts whose five-word shingles have a Jaccard likeness of 0.8 differ in 39 of the 256 bits on average, with a standard deviation of 6.
WIDE_SHINGLE, WIDE_RADIUS = 5, 44
WIDE_SEGMENTS = tuple((k, k + 1) for k in range(0, 32, 2))
#: Bits by which the two segments of each of the eight 32-bit words may differ. If all words differed by more than their two numbers and one,
#: 5 times 6 and 3 times 5 bits would, which is 45; in a word that doesn't, one segment differs by its number at most. So no pair within the radius is missed.
WIDE_WORDS = ((2, 2),) * 5 + ((2, 1),) * 3
#: Fingerprints of a block, on average at most, and of one that isn't cut further. A task compares two blocks.
WIDE_RANGE, WIDE_LEAST = 1 << 18, 1 << 12
#: Pairs of fingerprints that a task looks at in one step, and links that it holds before they are joined.
WIDE_STEP, WIDE_HELD = 1 << 15, 1 << 14


def wide_fingerprints(texts: list[bytes], shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """256-bit fingerprints of UTF-8 texts, as four words each; no words give zero. Of a shingle's bits, 128 are its XXH3 and 128 are mixed from them."""
    from xxhash import xxh3_128_digest

    out = np.zeros((len(texts), 32), np.uint8)
    for k, t in enumerate(texts):
        w = words_of(t.lower())
        if w:
            n = min(shingle, len(w))
            grams = zip(*[w[i:] for i in range(n)], strict=False)
            raw = b"".join([xxh3_128_digest(b" ".join(g)) for g in grams])
            ones, total = np.zeros(256, np.int64), len(raw) // 16
            for at in range(0, len(raw), 16 << 13):  # a bounded number of unpacked bits at a time
                h = np.frombuffer(raw[at : at + (16 << 13)], "<u8").reshape(-1, 2)
                h = np.concatenate([h, mix64(h ^ np.uint64(0xA0761D6478BD642F))], axis=1)
                ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > total)
    return out.view(np.uint64)


def node_of(fp: np.ndarray) -> np.ndarray:
    """A 64-bit name of each wide fingerprint."""
    name = np.zeros(len(fp), np.uint64)
    for k in range(4):
        name = mix64(name ^ fp[:, k])
    return name.view(np.int64)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fp = wide_fingerprints(texts_of(b))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("row_key")), pa.array(node_of(fp)), pa.array([x.tobytes() for x in fp], pa.binary())], ["row_key", "node", "fp"])


def _wide_dealt(blocks: int):
    """Fingerprints in blocks by hash, each sent to all pairs of blocks that have it; packed by pair and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            fp = np.frombuffer(b"".join(b.column(b.schema.names.index("fp")).to_pylist()), np.uint64).reshape(-1, 4)
            at = (mix64(node_of(fp)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
            for k in np.unique(at).tolist():
                pairs = [i * blocks - i * (i - 1) // 2 + j - i for i, j in ((min(k, x), max(k, x)) for x in range(blocks))]
                rows = fp[at == k].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array([k] * blocks, pa.int32()), pa.array([rows] * blocks, pa.binary())], ["pair", "block", "rows"])

    return run


def _wide_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one pair of blocks after another; rows come sorted by pair and block."""
    now, held = None, {}
    for b in batches:
        for r in b.to_pylist():
            if r["pair"] != now:
                yield from _wide_blocks(held)
                now, held = r["pair"], {}
            held.setdefault(r["block"], []).append(r["rows"])
    yield from _wide_blocks(held)


def _wide_blocks(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Links that connect what all links between two blocks, or in a single one, connect: of each group, its first member to all others."""
    blocks = [np.frombuffer(b"".join(x), np.uint64).reshape(-1, 4) for x in held.values()]
    if not blocks:
        return
    x, y, shift = blocks[0], blocks[-1], len(blocks[0]) if len(blocks) > 1 else 0
    fp = np.concatenate(blocks)
    label = np.arange(len(fp))
    a, b, n = [], [], 0
    for i, j in _wide_near(x, y):
        new = label[i] != label[j + shift]  # what earlier links connect needs no more
        i, j = i[new], j[new]
        near = np.bitwise_count(x[i] ^ y[j]).sum(1, dtype=np.int64) <= WIDE_RADIUS
        a.append(i[near])
        b.append(j[near] + shift)
        n += len(a[-1])
        if n >= WIDE_HELD:
            label, a, b, n = _united(label, np.concatenate(a), np.concatenate(b)), [], [], 0
    if n:
        label = _united(label, np.concatenate(a), np.concatenate(b))
    other = np.flatnonzero(label != np.arange(len(label)))
    if len(other):
        yield pa.RecordBatch.from_arrays([pa.array(node_of(fp[other])), pa.array(node_of(fp[label[other]]))], ["a", "b"])


def _wide_near(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y that WIDE_WORDS lets through, among them all within the radius; some come repeatedly."""
    for word, most in enumerate(WIDE_WORDS):
        px, py = (np.ascontiguousarray(z.view(np.uint32)[:, word]) for z in (x, y))
        for half in range(2):
            kx, ky = ((z >> np.uint32(16 * half)).astype(np.uint16) for z in (px, py))
            ox, oy = np.argsort(kx, kind="stable"), np.argsort(ky, kind="stable")
            slot, wx, wy = kx[ox].astype(np.int64), px[ox], py[oy]
            sizes = np.bincount(ky, minlength=1 << 16)
            starts = np.cumsum(sizes) - sizes
            flips = [f for f in range(1 << 16) if f.bit_count() <= most[half]]
            rows = max(1024, (WIDE_STEP << 16) // max(len(y), 1 << 16))
            for k in range(0, len(slot), rows):
                for f in flips:
                    other = slot[k : k + rows] ^ f
                    n = sizes[other]
                    to, lo = np.cumsum(n), 0
                    while lo < len(n):  # once, unless slots are crowded
                        done = int(to[lo - 1]) if lo else 0
                        hi = len(n) if to[-1] - done <= 4 * WIDE_STEP else max(lo + 1, int(np.searchsorted(to, done + 4 * WIDE_STEP, "right")))
                        m, end = n[lo:hi], to[lo:hi] - done
                        at = np.repeat(starts[other[lo:hi]] - end + m, m)
                        at += np.arange(len(at))
                        hit = np.flatnonzero(np.bitwise_count(wy[at] ^ np.repeat(wx[k + lo : k + hi], m)) <= sum(most) + 1)
                        if len(hit):
                            yield ox[k + lo + np.searchsorted(end, hit, "right")], oy[at[hit]]
                        lo = hi


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, by which each place has the first of its group, after the groups of a and b have become one, pair by pair."""
    roots, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(roots))
    while (least[x] != least[y]).any():
        lx, ly = least[x], least[y]
        low = np.minimum(lx, ly)
        np.minimum.at(least, lx, low)
        np.minimum.at(least, ly, low)
        while (least != least[least]).any():
            least = least[least]
    to = np.arange(len(label))
    to[roots] = roots[least]
    return to[label]


def wide_links(distinct: DataFrame) -> DataFrame:
    """distinct (node, fp of 32 bytes) to links (a, b) of nodes that connect all fingerprints within the radius of each other.

    Every pair of blocks is searched, so that work grows with the square of distinct fingerprints, of which pairs about a fortieth are looked at.
    """
    parts, count = partitions(distinct.sparkSession), distinct.count()
    blocks = max(1, -(-count // WIDE_RANGE), min(-(-count // WIDE_LEAST), math.ceil(math.sqrt(2 * parts))))
    dealt = distinct.select("node", "fp").repartition(parts, "node").select("fp").mapInArrow(_wide_dealt(blocks), "pair int, block int, rows binary")
    return dealt.repartitionById(blocks * (blocks + 1) // 2, F.col("pair")).sortWithinPartitions("pair", "block").mapInArrow(_wide_linked, "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to a row per row: row_key, fp (32 bytes), kept: whether it is the row that stays of its group of like texts."""
    rows = docs.select(row_key(F.col("doc_id").cast("long"), F.xxhash64("text")), "text")
    rows = stored(rows.mapInArrow(_wide, "row_key struct<id: long, version: long>, node long, fp binary"))
    named = F.min(F.when(F.col("row_key.id").isNotNull(), F.col("row_key")))
    distinct = stored(rows.groupBy("node").agg(F.first("fp").alias("fp"), named.alias("first"), F.min("row_key").alias("any")))
    found = components(wide_links(distinct)).withColumnRenamed("node", "found")
    labelled = stored(distinct.join(found, F.col("node") == F.col("found"), "left").select("node", "first", "any", F.coalesce("root", "node").alias("label")))
    least = stored(labelled.groupBy("label").agg(F.coalesce(F.min("first"), F.min("any")).alias("best")))
    by_node = stored(labelled.join(least.hint("merge"), "label").select("node", "best"))
    return rows.join(by_node.hint("merge"), "node").select("row_key", "fp", (F.col("row_key") == F.col("best")).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs without near copies: of texts that wide fingerprints link, directly or by others, the row with the smallest doc_id, in the columns of docs.

    Texts are compared by five-word shingles; the radius takes in a Jaccard likeness of 0.8 and more. Of rows that share doc_id and text, the least by all columns stands for them.
    """
    stay = similar_groups(docs).filter("kept").select("row_key").distinct()
    return restored(keyed(docs).join(stay, "row_key", "left_semi").groupBy("row_key").agg(least_row(docs)), docs)
