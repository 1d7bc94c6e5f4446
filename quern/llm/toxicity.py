"""Toxicity by maximum-scoring segment search.

A token's score is its log-odds between toxic and other labelled documents under
an informative Dirichlet prior (a token too rare for that takes the log-odds of
its longest known beginning), less a drift that makes the expected score
negative. A linear scan finds every maximal-scoring segment of a text (Ruzzo and
Tompa, 1999); the extreme-value law of such scores (Karlin and Altschul, 1990)
turns each into a significance for a text of its length; a logistic curve fitted
on the labelled documents turns the summed significance into a probability.

Labels are learned from a bounded sample: at most FIT_ROWS labelled rows outside
the held-out fold, chosen by a hash of doc_id, one of those whose least shingle
hash is the same (copies would count as so many independent texts). Three
quarters of them give the log-odds, the rest the curve.

Defined results: a null or empty text has no segment; rows repeated are scored
alike; without any labelled row every score is DEFAULT; labels that are null are
ignored; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, slices, stored, texts_of

#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 20_000
#: Tokens with a score: those with the largest |z|, at least Z.
VOCABULARY, Z = 50_000, 4.0
#: Beginnings of tokens that count as features, in characters.
STEMS = (6, 5, 4)
#: Words of a shingle by which copies are found.
SHINGLE = 8
#: Weight of the prior, in tokens.
PRIOR = 10_000.0
DRIFT = 0.05
THRESHOLD = 0.3
DEFAULT = 0.0
FOLDS, HELD_OUT = 4, 2

_TOKEN = re.compile(rb"[a-z0-9'\x80-\xff]+")


def tokens_of(text: bytes) -> list[bytes]:
    return _TOKEN.findall(text.lower())


def stems_of(token: bytes) -> list[bytes]:
    """The token's beginnings that are shorter than itself, longest first, marked."""
    t = token.decode("utf-8", "ignore")
    return [t[:n].encode() + b"*" for n in STEMS if len(t) > n]


class _Scores(dict):
    """Token to score, filled as tokens come, forgotten as a whole at a bound."""

    LIMIT = 300_000

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, token: bytes) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        known = self.model.scores
        s = next((known[f] for f in (token, *stems_of(token)) if f in known), -self.model.drift)
        self[token] = s
        return s


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (-20.0, 0.0)

    def significance(self, score: np.ndarray, n: int) -> np.ndarray:
        """Nats of a segment's score above what chance gives in n tokens."""
        return self.lam * score - np.log(max(self.k * n, 1e-9))

    def statistic(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum of the significance of every significant segment."""
        if not segments:
            return 0.0
        s = self.significance(np.array([x[2] for x in segments]), n)
        return float(np.sum(s[s > 0]))

    def probability(self, statistic: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(statistic), -30, 30))))


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score) of a sequence, by one scan over its runs of positive scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    cut = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.concatenate([[0], cut + 1])], positive[np.concatenate([cut, [len(positive) - 1]])] + 1
    found: list[list] = []  # [start, end, sum before, sum after, index of the last one with a smaller sum before]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        item = [a, b, sums[a], sums[b], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                item[4] = j
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3], -1]
            del found[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in found]


def _scored(score_of: _Scores, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
    words = tokens_of(text)
    scores = list(map(score_of.__getitem__, words))
    if not words or max(scores) <= 0:
        return [], len(words)
    return segments_of(np.array(scores)), len(words)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of each class, combined within the task."""
    from collections import Counter

    counts, features = (Counter(), Counter()), {}
    for b in slices(batches):
        for toxic, text in zip(b.column(b.schema.names.index("toxic")).to_pylist(), texts_of(b), strict=True):
            for token in set(tokens_of(text)):
                counts[int(toxic)][token] += 1
    for c in counts:  # a token counts once for a document, and so does each of its stems
        for token, n in list(c.items()):
            for f in features.setdefault(token, stems_of(token)):
                c[f] += n
    for c in (0, 1):
        items = list(counts[c].items())
        for k in range(0, len(items), 50_000):
            part = items[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] * (c == 0) for x in part], pa.int64()), pa.array([x[1] * (c == 1) for x in part], pa.int64())], ["token", "other", "toxic"])


def _least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in slices(batches):
        least = []
        for text in texts_of(b):
            w = hashes.array(tokens_of(text))
            n = min(SHINGLE, len(w))
            h = np.full(max(1, len(w) - n + 1), np.uint64(n))
            for i in range(n):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
            least.append(int(h.min().view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("doc_id")), b.column(b.schema.names.index("toxic")), pa.array(least, pa.int64())], ["doc_id", "toxic", "least"])


def _gathered(model: Model):
    """Per labelled document what calibration needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _Scores(model)
        for b in slices(batches):
            toxic = b.column(b.schema.names.index("toxic")).to_pylist()
            out = [(t, n, max((x[2] for x in s), default=0.0), [x[2] for x in s]) for t, (s, n) in zip(toxic, (_scored(score_of, x) for x in texts_of(b)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.list_(pa.float64()))], ["toxic", "n", "top", "segments"])

    return run


def _lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of the sum of shares * exp(lambda * values) = 1."""
    if not np.any(values > 0) or float(values @ shares) >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while np.sum(shares * np.exp(np.clip(hi * values, -700, 700))) < 1 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.sum(shares * np.exp(np.clip(mid * values, -700, 700))) < 1 else (lo, mid)
    return max(lo, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from labels (doc_id, toxic) outside the held-out fold. Only a bounded vocabulary and a row per fitted document come to the driver."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text_of = docs.select(F.col("doc_id").cast("long"), "text")
    near = text_of.join(F.broadcast(ids), "doc_id").mapInArrow(_least_shingle, "doc_id long, toxic int, least long")
    unlike = near.groupBy("least").agg(F.min(F.struct("doc_id", "toxic")).alias("one")).select("one.*")
    chosen = unlike.sparkSession.createDataFrame(unlike.collect(), "doc_id long, toxic int")  # at most FIT_ROWS ids
    sample = text_of.join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(4)) == 0).alias("calibrate"))
    counts = stored(sample.filter("not calibrate").mapInArrow(_counted, "token binary, other long, toxic long").groupBy("token").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t")))
    total = counts.filter("not endswith(token, X'2A')").agg(F.sum("o"), F.sum("t")).first()
    no, nt = float(total[0] or 0), float(total[1] or 0)
    model = Model()
    if not no or not nt:
        return model
    prior = F.lit(PRIOR) * (F.col("o") + F.col("t")) / (no + nt)
    odds = lambda c, n: F.log((F.col(c) + prior) / (n + PRIOR - F.col(c) - prior))
    scored = counts.select("token", (odds("t", nt) - odds("o", no)).alias("delta"), (1 / (F.col("t") + prior) + 1 / (F.col("o") + prior)).alias("var"), (F.col("o") / no).alias("share"))
    scored = scored.withColumn("z", F.col("delta") / F.sqrt("var")).filter(F.abs("z") >= Z).orderBy(F.abs("z").desc(), "token").limit(VOCABULARY)
    table = scored.select("token", "delta", "share").collect()
    if not table:
        return model
    delta, share = np.array([r["delta"] for r in table]), np.array([r["share"] for r in table])
    while True:  # the law needs a negative expected score on ordinary text
        values = np.append(delta - model.drift, -model.drift)
        shares = np.append(share, max(0.0, 1 - share.sum()))
        if values @ shares < 0:
            break
        model.drift *= 2
    model.scores = {bytes(r["token"]): float(d) for r, d in zip(table, values[:-1], strict=True)}
    model.lam = _lambda(values, shares)
    seen = sample.filter("calibrate").mapInArrow(_gathered(model), "toxic int, n long, top double, segments array<double>").collect()
    plain = [r for r in seen if not r["toxic"] and r["n"]]
    if plain:  # a Gumbel law's mean is (ln(K n) + Euler's constant) / lambda
        model.k = float(np.exp(np.mean([model.lam * r["top"] - np.log(r["n"]) for r in plain]) - np.euler_gamma))
    x = np.log1p([model.statistic([(0, 0, s) for s in r["segments"]], r["n"]) for r in seen])
    model.curve = _logistic(x, np.array([float(r["toxic"]) for r in seen]))
    return model


_RESULT = "doc_id long, held_out boolean, score double, predicted int, n_segments long, segments array<struct<start:long,end:long,significance:double>>"


def _judged(model: Model, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_segments", pa.int64()), ("segments", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _Scores(model)
        for b in slices(batches):
            names = b.schema.names
            rows = []
            for d, h, text in zip(b.column(names.index("doc_id")).to_pylist(), b.column(names.index("held_out")).to_pylist(), texts_of(b), strict=True):
                found, n = _scored(score_of, text)
                p = model.probability(model.statistic(found, n)) if model.scores else DEFAULT
                sig = [{"start": s[0], "end": s[1], "significance": float(x)} for s in found if (x := model.significance(np.float64(s[2]), n)) > 0]
                rows.append((d, h, p, int(p >= threshold), len(sig), sig))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, score, predicted, n_segments and the significant segments (in tokens)."""
    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_judged(model, threshold), _RESULT)


def _clean(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _Scores(model)
        for b in slices(batches):
            ok = [not model.scores or model.probability(model.statistic(*_scored(score_of, t))) < threshold for t in texts_of(b)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return run


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the model calls toxic, in the columns of docs."""
    return docs.mapInArrow(_clean(model, threshold), docs.schema)
