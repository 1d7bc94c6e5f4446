"""Lexical retrieval packing with a sharded BM25 inverted index.

Map tasks tokenize whole texts. Each full window of a long document is a
sequence of its own; what is left goes to one of many shards of about equal
size by content: documents are ordered by weighted MinHash samples of their
terms, weighed as BM25 does over the whole corpus, and cut into ranges. A shard
builds a BM25 inverted index over its documents' tokens; each unused document in
turn seeds a sequence, and its best unused neighbours by all of its terms fill
the window, the last one cut, its rest staying in the pool. When a shard runs
out, its last tokens are cut into sequences of a power of two, which need no
padding.

Defined results: a null text is empty, and its only id is the end; every id of
every row lies in exactly one piece, so rows repeated with one doc_id are packed
as often as they occur, and texts of one doc_id in the order of their hashes, so
that a task run again gives the same pieces; an empty table gives an empty
result; columns other than doc_id and text are ignored and may have any names.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, partitions, slices, stored, texts_of

LENGTH = 4096
END = 2
#: Documents of a shard, on average: the pool from which neighbours come.
SHARD = 1024
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Of so many documents, one is looked at for the bounds of shards.
BOUNDS = 16

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_MARKS = rb"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
#: Marks that end a chunk after a letter or digit, of ASCII or with an accent: the tokenizer cuts there too, and takes them as one.
_ENDING = re.compile(_MARKS + rb"(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))" + _MARKS + rb"*(?=[\x20\x09-\x0D]|$)")
#: Small letters of Latin-1, which are their own normal form.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Characters that are words of their own to the tokenizer; the first with one id parts chunks that are encoded together.
_PARTING = "\u00b2\u00b3\u00b9\u00bd\u00bc\u00be"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class Encoder(dict):
    """Ids of white-space-free chunks, lower-cased and without an ending mark: this tokenizer drops white space and case before it merges, so chunks are encoded alone.

    Chunks of Latin letters in normal form are what the tokenizer would look up anyway, so they skip its normalising and cutting, those of Latin-1 as soon as they are met.
    The other chunks of some texts that aren't remembered are encoded together, parted by a character that none of them holds.
    A chunk is remembered from its second sight on, as most are seen once only. All memories are bounded: chunks have two
    generations, of which a full one becomes the old one; those of one sight lie apart, and these and the marks of first sights
    are wiped once they are many.
    """

    LIMIT = 250_000
    MARKS = 1 << 22
    #: Chunks encoded together.
    TOGETHER = 4096

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.once: dict[bytes, bytes] = {}
        self.marks, self.marked = bytearray(self.MARKS), 0
        self.merged, self.deferred = self.tokenizer.model.tokenize, []
        self.letters = _byte_letters()
        alone = {x: self._encoded(x) for x in _PARTING}
        self.parting, self.parting_id = next(((x, ids[0]) for x, ids in alone.items() if len(ids) == 1), (None, None))

    def _encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _chunks_encoded(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        from unicodedata import is_normalized

        together = []
        for c in chunks:
            t = c.decode("utf-8", "replace")
            if t.isalpha() and max(t) < "\u0180" and t == t.lower() and is_normalized("NFC", t):
                yield c, self._merged(c)
            elif self.parting is None or self.parting in t:
                yield c, array("H", self._encoded(t)).tobytes()
            else:
                together.append((c, t))
        for at in range(0, len(together), self.TOGETHER):
            part = together[at : at + self.TOGETHER]
            ids = np.array(self._encoded(f" {self.parting} ".join([t for _, t in part])), "<u2")
            cuts = (2 * np.flatnonzero(ids == self.parting_id)).tolist()
            raw = ids.tobytes()
            yield from zip([c for c, _ in part], [raw[a:b] for a, b in zip([0, *(x + 2 for x in cuts)], [*cuts, len(raw)], strict=True)], strict=True)

    def _merged(self, chunk: bytes) -> bytes:
        letters = chunk.decode() if chunk.isascii() else chunk.decode("latin-1").translate(self.letters)
        return array("H", [x.id for x in self.merged(letters)]).tobytes()

    def __missing__(self, chunk: bytes) -> bytes | None:
        """The ids of a chunk of Latin-1 letters, or of one in the old generation; else None, and the chunk is deferred."""
        ids = self.old.get(chunk) or self.once.pop(chunk, None)
        if ids is not None:
            self._remember(chunk, ids)
        elif chunk.isalpha() and chunk.islower() or _LETTERS.fullmatch(chunk):
            ids = self._merged(chunk)
            self._met(chunk, ids)
        else:
            self.deferred.append(chunk)
        return ids

    def _met(self, chunk: bytes, ids: bytes) -> None:
        if self._seen_before(chunk):
            self._remember(chunk, ids)
            return
        if len(self.once) >= self.LIMIT:
            self.once.clear()
        self.once[chunk] = ids

    def _remember(self, chunk: bytes, ids: bytes) -> None:
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids

    def _seen_before(self, chunk: bytes) -> bool:
        at = hash(chunk) % self.MARKS
        if self.marks[at]:
            return True
        if self.marked >= self.MARKS // 4:
            self.marks, self.marked = bytearray(self.MARKS), 0
        self.marks[at] = 1
        self.marked += 1
        return False

    def all_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. The collector of cycles rests meanwhile: there are none, and many small objects."""
        gc.disable()
        try:
            return self._all_ids(texts)
        finally:
            gc.enable()

    def _all_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found, holes = [], []
        for text in texts:
            if b"<|" not in text:  # else it may hold a special token, which is told by case
                text = _ENDING.sub(rb" \g<0>", text.lower())
            self.deferred = []
            ids, at = list(map(self.__getitem__, text.split())), -1
            for chunk in self.deferred:
                at = ids.index(None, at + 1)
                holes.append((ids, at, chunk))
            found.append(ids)
        known: dict[bytes, bytes] = {}
        for chunk, ids in self._chunks_encoded(list({x[2] for x in holes})):
            known[chunk] = ids
            self._met(chunk, ids)
        for ids, at, chunk in holes:
            ids[at] = known[chunk]
        return [np.frombuffer(b"".join(x), "<u2") for x in found]

    def ids(self, text: bytes) -> np.ndarray:
        return self.all_ids([text])[0]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenized(path: str, length: int, end: int):
    schema = pa.schema([("version", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(f"encoder of {path}", lambda: Encoder(path))
        for b in slices(batches, 256):
            names = b.schema.names
            out = []
            for d, version, own in zip(b.column(names.index("doc_id")).to_pylist(), b.column(names.index("version")).to_pylist(), encode.all_ids(texts_of(b)), strict=True):
                ids = np.append(own, np.uint16(end)).astype("<u2")
                for k in range(0, len(ids), length):
                    out.append((version, d, k, len(ids), ids[k : k + length].tobytes()))
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2000], strict=True), schema, strict=True)], schema=schema)

    return run


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms in order, and how often each occurs. A stable sort of 16 bits goes by digits."""
    x = np.sort(ids, kind="stable")
    ends = np.flatnonzero(np.append(x[1:] != x[:-1], True)) if len(x) else np.empty(0, np.int64)
    return x[ends], np.diff(ends, prepend=-1)


def _tallied(length: int):
    """(term, n): documents of the pool that have the term; term -1: documents, -2: tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(65536, np.int64), 0, 0
        for b in slices(batches):
            for x in b.column(b.schema.names.index("ids")).to_pylist():
                if len(x) < 2 * length:
                    df[_terms(np.frombuffer(x, "<u2"))[0]] += 1
                    n, tokens = n + 1, tokens + len(x) // 2
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [n, tokens]))], ["term", "n"])

    return run


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def content_key(ids: np.ndarray, draws: np.ndarray) -> int:
    """A term for each column of draws (exponential variates by term, over its idf), 16 bits each: two documents have a term in common as often as their weighted Jaccard likeness says."""
    terms, tf = _terms(ids)
    least = np.take(draws, terms, axis=0) * (1 + K1 / tf)[:, None]
    out = 0
    for t in terms[least.argmin(0)].tolist():
        out = out << 16 | t
    return out


def _coded(length: int, df: np.ndarray, n: int):
    """Adds code, by which documents are ordered: 48 bits of content, then 15 of the version, so that crowds of one content can be cut. None for full windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = np.where(df > 1, _idf(n, df), 1e-9)  # a term of one document can't bring it to another
        draws = np.ascontiguousarray((np.random.default_rng(11).exponential(size=(3, 65536)) / idf).T)
        for b in slices(batches):
            names = b.schema.names
            codes = []
            for version, x in zip(b.column(names.index("version")).to_pylist(), b.column(names.index("ids")).to_pylist(), strict=True):
                codes.append(content_key(np.frombuffer(x, "<u2"), draws) << 15 | version >> 32 & 0x7FFF if len(x) < 2 * length else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.int64())], [*names, "code"])

    return run


def _dealt(bounds: np.ndarray, coded):
    """Rows coded in the same Python worker, by code to shard; full windows of a long document needn't stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in coded(batches):
            names = b.schema.names
            get = lambda name: b.column(names.index(name))  # noqa: E731, B023
            codes = get("code")
            spread = (get("version").to_numpy() + get("start").to_numpy()) % (len(bounds) + 1)
            shard = np.where(codes.is_null().to_numpy(zero_copy_only=False), spread, np.searchsorted(bounds, codes.fill_null(0).to_numpy(), "right"))
            kept_names = ["doc_id", "version", "start", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *map(get, kept_names)], ["shard", *kept_names])

    return run


class Index:
    """BM25 over the tokens of a shard's documents; idf and mean length are the whole corpus's where given."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None) -> None:
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        pairs, tf = np.unique(np.repeat(np.arange(n), sizes) << 16 | np.concatenate(docs), return_counts=True) if n else (np.empty(0, np.int64), np.empty(0))
        self.n, doc, term = n, pairs >> 16, pairs & 0xFFFF
        df = np.bincount(term, minlength=65536)
        self.idf = _idf(n, df) if idf is None else idf
        mean = max(1.0, sizes.mean() if mean is None else mean) if n else 1.0
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        self.terms, self.weights = term, weight
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.of_term = np.searchsorted(term[order], np.arange(65537))
        self.df = df

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with seed, best first."""
        own = slice(self.of_doc[seed], self.of_doc[seed + 1])
        terms = self.terms[own]
        terms = terms[self.df[terms] > 1]
        spans = [slice(self.of_term[t], self.of_term[t + 1]) for t in terms]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        score[used] = 0
        score[seed] = 0
        best = np.flatnonzero(score > 0)
        return best[np.lexsort((best, -score[best]))]


def pack_shard(items: list[tuple], length: int = LENGTH, idf: np.ndarray | None = None, mean: float | None = None) -> Iterator[tuple]:
    """items (doc_id, start, doc_tokens, ids) to pieces (doc_id, start, length, crc, doc_tokens, sequence, offset, ids)."""
    sequence = 0
    piece = lambda x, a, n, s, o: (x[0], x[1] + a, n, _crc(x[3][a : a + n]), x[2], s, o, x[3][a : a + n].tobytes())
    pool = []
    for x in items:
        if len(x[3]) == length:
            yield piece(x, 0, length, sequence, 0)
            sequence += 1
        else:
            pool.append(x)
    if not pool:
        return
    index = Index([x[3] for x in pool], idf, mean)
    used, at, left = np.zeros(len(pool), bool), [0] * len(pool), sum(len(x[3]) for x in pool)
    first = 0  # every document before this one is used

    def candidates(seed):
        yield seed
        yield from index.neighbours(seed, used)
        k = first
        while k < len(pool):  # no neighbour is left: any document
            if not used[k]:
                yield k
            k += 1

    while left:
        room = length if left >= length else 1 << (left.bit_length() - 1)
        while used[first]:
            first += 1
        offset = 0
        for k in candidates(first):
            if used[k]:
                continue
            n = min(len(pool[k][3]) - at[k], room - offset)
            yield piece(pool[k], at[k], n, sequence, offset)
            at[k] += n
            offset += n
            used[k] = at[k] == len(pool[k][3])
            if offset == room:
                break
        left -= offset
        sequence += 1


def _packed(length: int, with_ids: bool, df: np.ndarray, n: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards():
            now, held = None, []
            for b in slices(batches):
                for r in b.to_pylist():
                    if r["shard"] != now and held:
                        yield now, held
                        held = []
                    now = r["shard"]
                    held.append((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u2")))
            if held:
                yield now, held

        idf = _idf(n, df)
        for shard, items in shards():
            out = [(d, s, m, c, t, (shard << 32) + q, o, ids if with_ids else None) for d, s, m, c, t, q, o, ids in pack_shard(items, length, idf, tokens / max(1, n))]
            for k in range(0, len(out), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 4000], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, shard: int = SHARD, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) to pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids: little-endian 16-bit)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("version"))
    ids = stored(rows.mapInArrow(_tokenized(path or tokenizer_path(), length, end), "version long, doc_id long, start long, doc_tokens long, ids binary"))
    tally = {r["term"]: r["n"] for r in ids.select("ids").mapInArrow(_tallied(length), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most 65538 rows
    n, tokens = tally.pop(-1, 0), tally.pop(-2, 0)
    df = np.zeros(65536, np.int64)
    df[list(tally.keys())] = list(tally.values())
    coded = _coded(length, df, n)
    shards, bounds = max(1, -(-n // shard)), np.empty(0, np.int64)
    if shards > 1:
        some = ids.filter(F.pmod("version", F.lit(BOUNDS)) == 0)
        seen = some.mapInArrow(coded, "version long, doc_id long, start long, doc_tokens long, ids binary, code long").filter("code is not null").select("code")
        seen = np.sort(np.array([r["code"] for r in seen.collect()], np.int64))  # eight bytes of each BOUNDS-th document
        bounds = np.unique(seen[len(seen) * np.arange(1, shards) // shards]) if len(seen) else bounds
    dealt = ids.mapInArrow(_dealt(bounds, coded), "shard int, doc_id long, version long, start long, doc_tokens long, ids binary")
    dealt = dealt.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "doc_id", "version", "start")
    return dealt.mapInArrow(_packed(length, with_ids, df, n, tokens), _RESULT)
