"""LM scoring with a gated recurrent network in numpy.

Word counts cover all training documents. The most frequent words form the head,
which is broadcast (HEAD words at most: those whose count passes a cut); counts of all other words reach their
documents by a join. The output softmax is factored by class: head words are cut
by rank into classes, words after the head form the last class. Within the
classes of the TOP words the state decides; within other classes the counts do.
The network learns by truncated backpropagation on all training documents, whole
texts, and starts from the counts' biases: documents are dealt by hash to shards
of about SHARD tokens, each shard is learned in a fixed order from the same
weights, and the shards' weights are averaged by tokens after each of EPOCHS
passes. A document is scored from an empty state that is carried from window to
window to its end.

Defined results: a null or empty text has one token, its end; an empty table gives
an empty result; with no training documents every count is 0 and the network
stays as it starts; very long texts are learned and scored whole, window after
window; rows repeated are learned as often as they occur and scored alike, in any
layout of the table; null ids count as empty text in the fold; words of equal
count are ranked by their bytes; columns other than doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, partitions, reuse_memory, slices, stored, texts_of, words_of

FOLDS, HELD_OUT = 7, 2
#: Words of the head; those of them that have vectors; words of a class among these; classes of the rest.
HEAD, TOP, CLASS, REST = 65_536, 2_048, 64, 31
HIDDEN = 32
#: Training tokens of a shard, on average.
SHARD = 1_000_000
LANES, WINDOW, EPOCHS, RATE = 64, 32, 3, 0.01
#: Lanes that score side by side at most, and steps of so many whose states are kept.
SIDE, STEPS = 512, 32
#: Tokens from which texts are scored together: as lanes don't wait for the longest text, few texts have few lanes, and a step costs as much.
TOGETHER = 4_000_000
#: Stands for the end of a document among the words.
END = b""
#: The largest logit: its exponential is summed in single precision.
LOGIT = 80.0
#: Rows of a matrix product in scoring: in products of 12 or more, the place of a row can change its rounding.
BLOCK = 8
#: Rows of logits, and weights that learn together, that stay in a core's cache.
ROWS, CHUNK = 2_048, 16_384
#: Steps of an octave by which counts are told apart when the head is cut.
OCTAVE = 64


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: Counter = Counter()

    def flush():
        items = list(counts.items())
        counts.clear()
        for k in range(0, len(items), 50_000):
            part = items[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64())], ["word", "c"])

    for b in slices(batches):
        for text in texts_of(b):
            counts.update(words_of(text.lower()))
            counts[END] += 1
            if len(counts) > 2_000_000:
                yield from flush()
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) to (word, c) over whole texts, the end of a document counted as the empty word."""
    return docs.select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What the whole corpus tells: the head's words and counts, and sums over all words."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.rank = {w: k for k, w in enumerate(self.words)}
        n = len(self.words)
        self.top = min(TOP, n)
        self.top_classes = -(-self.top // CLASS)
        rest = n - self.top
        self.rest_size = max(1, -(-rest // REST))
        self.rest_classes = -(-rest // self.rest_size)
        self.classes = self.top_classes + self.rest_classes + 1
        ranks = np.arange(n)
        self.class_of = np.append(np.where(ranks < self.top, ranks // CLASS, self.top_classes + (ranks - self.top) // self.rest_size), self.classes - 1).astype(np.int32)
        self.input_of = np.append(np.where(ranks < self.top, ranks, self.top + self.class_of[:-1] - self.top_classes), self.top + self.rest_classes).astype(np.int32)
        self.inputs = self.top + self.rest_classes + 2  # the last one: the start
        #: A word of each input's class; of the top, the word itself.
        self.target_of = np.concatenate([np.arange(self.top), self.top + self.rest_size * np.arange(self.rest_classes), [n]]).astype(np.int32)
        mass = np.bincount(self.class_of[:-1], weights=self.counts + 1.0, minlength=self.classes)
        tail = self.total - int(self.counts.sum())
        mass[-1] += tail + self.distinct - n + 1  # words never seen are one more
        self.class_mass = mass
        #: log10 of a word within its class by counts, for words after the top; of the tail, only the divisor.
        within = np.log10((self.counts + 1.0) / mass[self.class_of[:-1]])
        within[: self.top] = 0.0
        self.within = np.append(within, -np.log10(mass[-1]))
        self.base = np.append(np.log10((self.counts + 1.0) / (self.total + self.distinct + 1.0)), 0.0)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get, n = self.rank.get, len(self.words)
        return np.fromiter(map(get, itertools.chain(words, (END,)), itertools.repeat(n)), np.int32, len(words) + 1)


def _exp(x: np.ndarray, most: float = np.inf) -> np.ndarray:
    """In place; returns the sums by row. No logit lies beyond most; LOGIT only guards against overflow."""
    if most > LOGIT:
        np.clip(x, -LOGIT, LOGIT, out=x)
    np.exp(x, out=x)
    return np.einsum("ij->i", x)


def _softmax(x: np.ndarray, scale: float, most: float) -> None:
    """In place, times scale."""
    x *= (scale / _exp(x, most))[:, None]


def _most(w: np.ndarray) -> float:
    """Above any logit that weights w (.., states and a bias, words) give: no state lies beyond 1."""
    return 1.001 * float(np.abs(w).sum(-2).max(initial=0.0))


def _gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y by blocks of rows: a library of matrix products is slow where the summed side is by far the longest."""
    whole = len(x) // 128 * 128
    out = x[whole:].T @ y[whole:]
    if whole:
        out += np.matmul(x[:whole].reshape(-1, 128, x.shape[1]).transpose(0, 2, 1), y[:whole].reshape(-1, 128, y.shape[1])).sum(0)
    return out


def _summed(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x (below 65,536) in order, and the sums of their rows."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    x = x[order]
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    pairs = np.take(rows, order, axis=0, mode="clip").view(np.result_type(rows.dtype, np.complex64))  # two numbers at a time
    return x[starts], np.add.reduceat(pairs, starts).view(rows.dtype)


def _padded(n: int, to: int = BLOCK) -> int:
    return -(-n // to) * to


def _product(x: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
    """x @ w by blocks of BLOCK rows: a library of matrix products takes another way, with other roundings, at other sizes, and so a row gets the same result wherever and among however many others it stands."""
    np.matmul(x.reshape(-1, BLOCK, x.shape[-1]), w, out=out.reshape(-1, BLOCK, out.shape[-1]))


def _stepped(h: np.ndarray, zr: np.ndarray, c: np.ndarray, hz: np.ndarray, hc: np.ndarray, both: np.ndarray, u: np.ndarray, after: np.ndarray, product=np.matmul) -> None:
    """One step from h to after. zr (rows, twice the units), c: what inputs take from both gates and give to the new value; become both gates and the new value. hz, hc: the state's weights to these; u: its part of the new value, for backpropagation; both: to write over."""
    n = h.shape[1]
    product(h, hz, out=both)
    zr -= both
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    product(h, hc, out=u)
    np.multiply(zr[:, n:], u, out=after)
    c += after
    np.tanh(c, out=c)
    np.subtract(c, h, out=after)
    after *= zr[:, :n]
    after += h


def _moved(theta: np.ndarray, slope: np.ndarray, m: np.ndarray, v: np.ndarray, x: np.ndarray, go: float, least: float) -> None:
    """One step of Adam. m and v: 10 and 1000 times the moments; x: to write over."""
    m *= 0.9
    m += slope
    np.multiply(slope, slope, out=x)
    v *= 0.999
    v += x
    np.sqrt(v, out=x)
    x += least
    np.divide(m, x, out=x)
    x *= go
    theta -= x


class _Rows:
    """Weights of which each step of Adam has slopes of some rows only.

    The others move on by their moments, which shrink by known factors: when a row is next met, what it has missed is
    one sum. It is the sum that step after step would give, but for least, of which the divisor has the mean over these steps.
    """

    def __init__(self, theta: np.ndarray) -> None:
        self.kept = theta, np.zeros_like(theta), np.zeros_like(theta)  # weights and moments
        #: Of each row since it was last moved: factors of both moments, how far one unit of them has gone, and least times that.
        self.m, self.v, self.gone, self.least = (f(len(theta)) for f in (np.ones, np.ones, np.zeros, np.zeros))

    def met(self, rows: np.ndarray) -> np.ndarray:
        """Rows as they are by now."""
        self.now = theta, m, v = [np.take(y, rows, axis=0, mode="clip") for y in self.kept]
        least = self.least / np.maximum(self.gone, 1e-30) + (self.gone == 0)
        gone, least, of_m, of_v = (np.take(y, rows).astype(theta.dtype)[:, None] for y in (self.gone, least, self.m, self.v))
        x = np.sqrt(v)
        x += least
        np.divide(m, x, out=x)
        x *= gone
        theta -= x
        m *= of_m
        v *= of_v
        return theta

    def moved(self, rows: np.ndarray, slope: np.ndarray, go: float, least: float) -> None:
        """A step of all rows, of which these, the ones met last, have slopes."""
        self.m *= 0.9
        self.v *= 0.999
        root = np.sqrt(self.v)
        of_now = go * self.m / root
        self.gone += of_now
        self.least += of_now * least / root
        theta, m, v = self.now
        _moved(theta, slope, m, v, np.empty_like(slope), go, least)
        for y, now in zip(self.kept, self.now, strict=True):
            y[rows] = now
        self.m[rows] = self.v[rows] = 1
        self.gone[rows] = self.least[rows] = 0

    def all(self) -> np.ndarray:
        return self.met(np.arange(len(self.gone)))


def _parted(joint: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    c, w = joint
    return {"c": c[:-1], "cb": c[-1], "w": w[:, :-1], "wb": w[:, -1]}


def _slopes(joint: tuple[np.ndarray, np.ndarray]) -> dict:
    room = np.zeros_like(joint[0]), np.zeros_like(joint[1])
    return _parted(room) | {"joint": (joint, room)}


class Network:
    """A gated recurrent unit whose state gives logits of classes, and of words within the classes of the top words."""

    def __init__(self, corpus: Corpus, hidden: int = HIDDEN, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        words = np.zeros((corpus.top_classes, CLASS), np.float32) - 30
        words.ravel()[: corpus.top] = np.log(corpus.counts[: corpus.top] + 1.0)
        self.p = {
            "x": (0.3 * r.standard_normal((corpus.inputs, 3 * hidden))).astype(np.float32),
            "h": f(hidden, 3 * hidden),
            "b": np.zeros(3 * hidden, np.float32),
            "c": 0.1 * f(hidden, corpus.classes),
            "cb": np.log(corpus.class_mass / corpus.class_mass.sum()).astype(np.float32),
            "w": 0.1 * f(hidden, corpus.top_classes * CLASS).reshape(hidden, corpus.top_classes, CLASS).transpose(1, 0, 2).copy(),
            "wb": words,
        }

    def _state_weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["h"][:, : 2 * self.hidden].copy(), self.p["h"][:, 2 * self.hidden :].copy()

    def _input_gates(self, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """By input, or by row of x: what it takes from both gates, and gives to the new value."""
        out = (self.p["x"] if x is None else x) + self.p["b"]
        return -out[:, : 2 * self.hidden], out[:, 2 * self.hidden :].copy()

    def step(self, x: np.ndarray, h: np.ndarray):
        """x: input ids; returns the next state and what backpropagation needs."""
        zr, c = (y[x] for y in self._input_gates())
        u, after = np.empty_like(h), np.empty_like(h)
        _stepped(h, zr, c, *self._state_weights(), np.empty_like(zr), u, after)
        return after, (x, h, zr, c, u)

    def _joint(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of logits with the biases as one more state, that of classes and that of words within classes."""
        return np.concatenate([self.p["c"], self.p["cb"][None]]), np.concatenate([self.p["w"], self.p["wb"][:, None]], axis=1)

    def _logits(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        c, w = self._joint()
        return c, w, _most(c), _most(w)

    def _by_class(self, target: np.ndarray, corpus: Corpus):
        """An order of rows by class, their classes, and the cuts between those of the top words."""
        cls = corpus.class_of[target]
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls = cls[order]
        return order, cls, np.searchsorted(cls, np.arange(corpus.top_classes + 1))

    def log_probs(self, h: np.ndarray, target: np.ndarray, corpus: Corpus, logits: tuple | None = None) -> np.ndarray:
        """log10 of each target (ids; the tail's without its words) given its state. logits: _joint() and the most that each gives."""
        n = len(h)
        c, w, most_c, most_w = logits or self._logits()
        order, cls, cuts = self._by_class(target, corpus)
        x = np.zeros((_padded(n), len(c)), h.dtype)
        x[:n, :-1] = np.take(h, order, axis=0, mode="clip")
        x[:, -1] = 1
        own, room = np.empty(n, h.dtype), np.empty((ROWS, corpus.classes), h.dtype)
        for at in range(0, n, ROWS):
            part = x[at : at + ROWS]
            now = room[: len(part)]
            _product(part, c, out=now)
            now = now[: n - at]
            said = now[np.arange(len(now)), cls[at : at + ROWS]]
            said -= np.log(_exp(now, most_c))
            own[at : at + ROWS] = said
        top = int(cuts[-1])
        if top:
            sizes = np.diff(cuts)
            starts = np.concatenate([[0], np.cumsum([_padded(k) for k in sizes])])
            at = np.arange(top) + np.repeat(starts[:-1] - cuts[:-1], sizes)
            wide = np.zeros((int(starts[-1]), len(c)), h.dtype)
            wide[at] = x[:top]
            word, total = target[order[:top]] - cls[:top] * CLASS, np.empty(len(wide), h.dtype)
            inner, said = np.empty((_padded(int(sizes.max())), CLASS), h.dtype), np.empty(top, h.dtype)
            for k in np.flatnonzero(sizes).tolist():
                now, own_words = inner[: starts[k + 1] - starts[k]], slice(cuts[k], cuts[k + 1])
                _product(wide[starts[k] : starts[k + 1]], w[k], out=now)
                said[own_words] = now[np.arange(sizes[k]), word[own_words]]
                total[starts[k] : starts[k + 1]] = _exp(now, most_w)
            said -= np.log(total)[at]
            own[:top] += said
        out = np.empty(n)
        out[order] = own
        return out / np.log(10) + corpus.within[target]

    def learn(self, docs: list[np.ndarray], corpus: Corpus, rate: float = RATE, done: int = 0, epochs: int = EPOCHS) -> None:
        """One pass, after done of epochs, of truncated backpropagation over docs (inputs): lanes read document after document, a lane's state going on from window to window."""
        heap, loads = [(0, k) for k in range(min(LANES, len(docs)))], [[] for _ in range(min(LANES, len(docs)))]
        for d in sorted(docs, key=len, reverse=True):
            size, k = heap[0]
            loads[k].append(d)
            heapq.heapreplace(heap, (size + len(d), k))
        loads.sort(key=lambda x: -sum(map(len, x)))
        sizes = np.array([sum(map(len, x)) for x in loads])
        length, start = int(sizes[0]), corpus.inputs - 1
        words = np.full((length, len(loads)), -1, np.int32)
        fresh = np.ones((length, len(loads)), bool)
        for k, own in enumerate(loads):
            words[: sizes[k], k] = np.concatenate(own)
            fresh[: sizes[k], k] = False
            fresh[np.cumsum([0] + [len(d) for d in own[:-1]]), k] = True
        del loads, docs
        #: All weights but the inputs' in one vector, and so their gradients and moments.
        n = self.hidden
        parts = {k: self.p[k] for k in ("h", "b")} | dict(zip(("c", "w"), self._joint(), strict=True))
        theta = np.concatenate([x.ravel() for x in parts.values()])
        slope, m, v, spare = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta), np.empty(CHUNK, theta.dtype)
        inputs, place = _Rows(self.p["x"].copy()), np.empty(corpus.inputs, np.int64)
        g, at = {}, 0
        for k, x in parts.items():
            self.p[k], g[k] = (y[at : at + x.size].reshape(x.shape) for y in (theta, slope))
            at += x.size
        joint = self.p["c"], self.p["w"]
        self.p |= _parted(joint)
        g |= {"joint": (joint, (g["c"], g["w"]))}
        chunks = [tuple(y[at : at + CHUNK] for y in (theta, slope, m, v)) for at in range(0, len(theta), CHUNK)]
        n_updates, t = -(-length // WINDOW), 0
        h = np.zeros((len(sizes), n), theta.dtype)
        for at in range(0, length, WINDOW):
            live = int(np.searchsorted(-sizes, -at, "left"))  # lanes that go on
            steps = min(WINDOW, length - at)
            own, new = words[at : at + steps, :live], fresh[at : at + steps, :live]
            source = np.full((steps, live), start, np.int64)
            source[1:] = own[:-1]
            if at:
                source[0] = words[at - 1, :live]
            source[new] = start
            seen = np.zeros(corpus.inputs, bool)
            seen[source] = True
            seen = np.flatnonzero(seen)
            place[seen] = np.arange(len(seen))
            source = place[source]
            zr, c = (np.take(x, source, axis=0, mode="clip") for x in self._input_gates(inputs.met(seen)))
            g["x"] = np.zeros((len(seen), 3 * n), theta.dtype)
            hz, hc = self._state_weights()
            states, u, both, begins = np.empty((steps + 1, live, n), theta.dtype), np.empty_like(c), np.empty_like(zr[0]), np.flatnonzero(new.any(1)).tolist()
            states[0] = h[:live]
            for s in range(steps):
                h = states[s]
                if s in begins:
                    h = h.copy()
                    h[new[s]] = 0
                _stepped(h, zr[s], c[s], hz, hc, both, u[s], states[s + 1])
            h = states[steps].copy()
            target = np.where(own >= 0, corpus.target_of[own], -1).ravel()
            _, dh = self._output_grads(states[1:].reshape(-1, n), target, corpus, g)
            states[:-1][new] = 0
            self._backward((source, states[:-1], zr, c, u), new, dh.reshape(steps, live, n), g)
            t += 1
            lr = rate * (1 - 0.9 * (done + t / n_updates) / epochs)
            share = min(1.0, 5.0 / (math.sqrt(float(slope @ slope) + float(g["x"].ravel() @ g["x"].ravel())) + 1e-9))
            if share < 1:
                slope *= share
                g["x"] *= share
            root = math.sqrt(0.001 / (1 - 0.999**t))
            go, least = 0.1 * lr / (1 - 0.9**t) / root, 1e-6 / root
            for own in chunks:
                _moved(*own, spare[: len(own[0])], go, least)
            slope[:] = 0
            inputs.moved(seen, g["x"], go, least)
        self.p["x"] = inputs.all()

    def _output_grads(self, h: np.ndarray, target: np.ndarray, corpus: Corpus, g: dict | None = None):
        """Adds to g (zeros at first) the slopes of logits' weights; also returns those of states h. g["joint"]: _joint() and room for its slopes, of which c, cb, w and wb are parts."""
        live, n = np.flatnonzero(target >= 0), h.shape[1]
        if g is None:
            g = {k: np.zeros_like(self.p[k]) for k in ("x", "h", "b")} | _slopes(self._joint())
        dh = np.zeros_like(h)
        if not len(live):
            return g, dh
        order, cls, cuts = self._by_class(target[live], corpus)
        live = live[order]
        x, y, scale = np.ones((len(live), n + 1), h.dtype), target[live], h.dtype.type(1 / len(live))
        x[:, :n] = np.take(h, live, axis=0, mode="clip")
        (c, w), (of_c, of_w) = g["joint"]
        p = x @ c
        _softmax(p, scale, _most(c))
        p[np.arange(len(x)), cls] -= scale
        of_c[:] = _gram(x, p)
        d = p @ c[:n].T
        top, used = int(cuts[-1]), np.flatnonzero(np.diff(cuts))
        if top:
            q, inner = np.empty((top, CLASS), h.dtype), np.empty((top, n), h.dtype)
            parts = [(k, slice(a, b)) for k, a, b in zip(used.tolist(), cuts[used].tolist(), cuts[used + 1].tolist(), strict=True)]
            for k, part in parts:
                np.matmul(x[part], w[k], out=q[part])
            _softmax(q, scale, _most(w))
            q[np.arange(top), y[:top] - cls[:top] * CLASS] -= scale
            for k, part in parts:
                np.matmul(x[part].T, q[part], out=of_w[k])
                np.matmul(q[part], w[k, :n].T, out=inner[part])
            d[:top] += inner
        dh[live] = d
        return g, dh

    def _backward(self, kept: list | tuple, fresh: np.ndarray, dh: np.ndarray, g: dict) -> None:
        """kept: what step() returned, step by step, or for all steps at once; dh: slopes of the states, written over."""
        source, before, zr, c, u = kept if isinstance(kept, tuple) else map(np.stack, zip(*kept, strict=True))
        n, back, begins = self.hidden, self.p["h"].T.copy(), set(np.flatnonzero(fresh.any(1)).tolist())
        z, r = zr[:, :, :n], zr[:, :, n:]
        # what a unit of the state's slope adds to the slopes of both gates and of the state's part of the new value, and leaves to the step before
        of_new, leaves = c * c, 1 - z
        np.subtract(1, of_new, out=of_new)
        of_new *= z
        each = np.empty((*c.shape[:2], 3, n), c.dtype)
        x, y = c - before, of_new * r
        x *= z
        np.multiply(x, leaves, out=each[:, :, 0])
        each[:, :, 2] = y
        np.subtract(1, r, out=x)
        x *= u
        np.multiply(x, y, out=each[:, :, 1])
        last, left = np.zeros_like(dh[0]), np.empty_like(dh[0])
        for s in range(len(c) - 1, -1, -1):
            own, du = dh[s], each[s]
            own += last
            du *= own[:, None]
            np.matmul(du.reshape(len(own), 3 * n), back, out=last)
            np.multiply(leaves[s], own, out=left)
            last += left
            if s in begins:
                last[fresh[s]] = 0
        du = each.reshape(-1, 3 * n)
        g["h"] += _gram(before.reshape(-1, n), du)
        of_new *= dh
        each[:, :, 2] = of_new  # from here on of what comes in by the word
        words, sums = _summed(source.ravel(), du)
        if len(words) == len(g["x"]):
            g["x"] += sums
        else:
            g["x"][words] += sums
        g["b"] += np.ones(len(sums), sums.dtype) @ sums

    def score(self, docs: list[np.ndarray], corpus: Corpus) -> np.ndarray:
        """log10 probability of each document (ids), the words of the tail left to their counts. Lanes read document after document, as few as make no lane wait for the longest document."""
        out, n, start = np.zeros(len(docs)), self.hidden, corpus.inputs - 1
        if not len(docs):
            return out
        lengths = [len(d) for d in docs]
        lanes = min(SIDE, -(-sum(lengths) // max(lengths)))
        heap, loads = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: -lengths[d]):
            size, k = heap[0]
            loads[k].append(d)
            heapq.heapreplace(heap, (size + lengths[d], k))
        loads.sort(key=lambda x: -sum(lengths[d] for d in x))
        sizes = np.array([sum(lengths[d] for d in x) for x in loads])
        words = [np.concatenate([docs[d] for d in x]) for x in loads]
        whose = [np.repeat(np.array(x, np.int32), [lengths[d] for d in x]) for x in loads]
        (of_zr, of_c), logits, (hz, hc) = self._input_gates(), self._logits(), self._state_weights()
        h = np.zeros((_padded(lanes), n), of_c.dtype)
        both, u = np.empty((len(h), 2 * n), h.dtype), np.empty_like(h)
        at = 0
        while at < sizes[0]:
            live = int(np.searchsorted(-sizes, -at, "left"))  # lanes that go on
            wide = _padded(live)
            steps = min(max(STEPS, SIDE * STEPS // wide), int(sizes[0]) - at)
            block, owner = (np.full((steps + 1, wide), -1, np.int32) for _ in range(2))  # from the step before on
            before = min(at, 1)
            for k in range(live):
                part = slice(at - before, at + steps)
                cells = slice(1 - before, 1 - before + len(words[k][part]))
                block[cells, k], owner[cells, k] = words[k][part], whose[k][part]
            goes_on = (block[:-1] >= 0) & (owner[1:] == owner[:-1])
            source = np.where(goes_on, corpus.input_of[block[:-1]], start)
            block, owner = block[1:], owner[1:]
            read = block >= 0
            new = read & ~goes_on
            states, h = np.empty((steps, wide, n), h.dtype), h[:wide]
            for s, begins in enumerate(new.any(1).tolist()):
                if begins:
                    h = h.copy()
                    h[new[s]] = 0
                _stepped(h, np.take(of_zr, source[s], axis=0, mode="clip"), np.take(of_c, source[s], axis=0, mode="clip"), hz, hc, both[:wide], u[:wide], states[s], _product)
                h = states[s]
            np.add.at(out, owner[read], self.log_probs(states[read], block[read], corpus, logits))  # one after another, whatever stands beside
            at += steps
        return out


def _read(corpus: Corpus):
    """Training documents as inputs, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names = b.schema.names
            ids = [corpus.input_of[corpus.ids(words_of(text.lower()))].astype("<u2").tobytes() for text in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(names.index(x)) for x in ("shard", "doc_id", "version")] + [pa.array(ids, pa.binary())], ["shard", "doc_id", "version", "ids"])

    return run


_WEIGHTS = "part long, tokens long, model binary"


class _Mean:
    """Weights averaged by tokens."""

    def __init__(self) -> None:
        self.tokens, self.sums = 0, {}

    def add(self, p: dict[str, np.ndarray], tokens: int) -> None:
        self.tokens += tokens
        for k, x in p.items():
            self.sums[k] = self.sums.get(k, 0) + x.astype(np.float64) * tokens

    def row(self, part: int) -> pa.RecordBatch:
        p = {k: (x / self.tokens).astype(np.float32) for k, x in self.sums.items()}
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([self.tokens], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())], ["part", "tokens", "model"])


def _trainer(corpus: Corpus, p: dict[str, np.ndarray], done: int):
    """Learns shard after shard, each from p; gives the mean of a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards():
            now, held = None, []
            for b in slices(batches):
                names = b.schema.names
                for shard, ids in zip(b.column(names.index("shard")).to_pylist(), b.column(names.index("ids")).to_pylist(), strict=True):
                    if shard != now and held:
                        yield now, held
                        held = []
                    now = shard
                    held.append(np.frombuffer(ids, "<u2"))
            if held:
                yield now, held

        reuse_memory()
        mean, least = _Mean(), None
        for shard, docs in shards():
            net = Network(corpus)
            net.p = {k: x.copy() for k, x in p.items()}
            net.learn(docs, corpus, done=done)
            mean.add(net.p, sum(map(len, docs)))
            least = shard if least is None else least
        if mean.tokens:
            yield mean.row(least)

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mean = _Mean()
    for b in slices(batches, 8):
        for r in b.to_pylist():
            mean.add(pickle.loads(r["model"]), r["tokens"])
    if mean.tokens:
        yield mean.row(0)


def learned(train: DataFrame, corpus: Corpus, shard: int = SHARD) -> tuple[dict[str, np.ndarray], int]:
    """The network's weights after all passes over train (doc_id, text), and the tokens of a pass. Only one model a pass comes to the driver."""
    parts = partitions(train.sparkSession)
    shards = max(1, -(-corpus.total // shard))
    version = F.xxhash64("doc_id", "text")
    rows = train.select("doc_id", "text", version.alias("version"), F.pmod(version, F.lit(shards)).alias("shard"))
    read = stored(rows.mapInArrow(_read(corpus), "shard long, doc_id long, version long, ids binary"))
    p, tokens = Network(corpus).p, 0
    for done in range(EPOCHS):
        dealt = read.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "doc_id", "version")
        means = dealt.mapInArrow(_trainer(corpus, p, done), _WEIGHTS)
        mean = means.repartition(1).sortWithinPartitions("part").mapInArrow(_averaged, _WEIGHTS).first()
        p, tokens = pickle.loads(mean["model"]), mean["tokens"]
    dropped(read)
    return p, tokens


_ROWS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail_words", pa.list_(pa.binary())), ("tail_counts", pa.list_(pa.int32()))])


def _scorer(corpus: Corpus, net: Network):
    """Scores texts of TOGETHER tokens and more at once, whatever batches they come in."""
    n, known = len(corpus.words), np.append(corpus.counts > 0, False)

    def read(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[pa.Array]]:
        """The ids of a batch's texts, and its columns but for the score."""
        ids, tails = [], []
        for text in texts_of(b):
            words = words_of(text.lower())
            x = corpus.ids(words)
            ids.append(x)
            words.append(END)
            tail: dict[bytes, int] = {}
            for k in np.flatnonzero(x == n).tolist():
                tail[words[k]] = tail.get(words[k], 0) + 1
            tails.append(tail)
        return ids, [
            b.column(b.schema.names.index("doc_id")),
            b.column(b.schema.names.index("held_out")),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([int(known[x].sum()) for x in ids], pa.int64()),
            pa.array([float(corpus.base[x].sum()) for x in ids], pa.float64()),
            pa.array([list(t.keys()) for t in tails], pa.list_(pa.binary())),
            pa.array([list(t.values()) for t in tails], pa.list_(pa.int32())),
        ]

    def scored(held: list[tuple[list[np.ndarray], list[pa.Array]]]) -> Iterator[pa.RecordBatch]:
        scores, at = net.score([x for ids, _ in held for x in ids], corpus), 0
        for ids, columns in held:
            columns.insert(5, pa.array(scores[at : at + len(ids)], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)
            at += len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        held, size = [], 0
        for b in slices(batches):
            if b.num_rows:
                held.append(read(b))
                size += sum(map(len, held[-1][0]))
                if size >= TOGETHER:
                    yield from scored(held)
                    held, size = [], 0
        if held:
            yield from scored(held)

    return run


def frequent(counts: DataFrame, head: int) -> list:
    """The rows of counts (word, c) whose count lies above a cut that at most head words pass, most frequent first.

    The cut is one of OCTAVE steps of each doubling, so only some thousands of rows and then the head come to the driver, whatever the vocabulary.
    """
    step = F.floor(F.log2(F.col("c")) * OCTAVE).cast("int")
    steps = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    passed, cut = 0, None
    for at, n in steps:
        passed += n
        if passed > head:
            break
        cut = at
    found = counts.filter(step >= cut).collect() if cut is not None else []
    return sorted(found, key=lambda r: (-r["c"], bytes(r["word"])))


def score_documents(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Counts and network learn from the rows that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    train = rows.filter("not held_out")
    counts = stored(word_counts(train))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = frequent(counts, head)
    corpus = Corpus([bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.int64), int(sums["n"] or 0), int(sums["v"]))
    net = Network(corpus)
    if corpus.total:
        net.p, _ = learned(train, corpus)
    scored = rows.mapInArrow(_scorer(corpus, net), "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail_words array<binary>, tail_counts array<int>")
    scored = stored(scored.withColumn("rid", F.monotonically_increasing_id()))
    tail = scored.select("rid", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("t")).select("rid", F.col("t.tail_words").alias("word"), F.col("t.tail_counts").alias("tf"))
    joined = tail.join(counts, "word", "left").select("rid", "tf", F.coalesce("c", F.lit(0)).alias("c"))
    per_doc = joined.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("mass"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum("tf").alias("tail_n"))
    out = scored.drop("tail_words", "tail_counts").join(per_doc, "rid", "left").na.fill(0, ["mass", "tail_known", "tail_n"])
    whole = float(np.log10(corpus.total + corpus.distinct + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("tail_known")).alias("n_known"),
        F.lit(corpus.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("mass") - F.col("tail_n") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.col("mass")).alias("score"),
    )
