"""Personal data by patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. The
field adds spans: its nodes are the mentions of a document, that is the base
spans (observed) and every other group of digits or address-like token. Chain
edges link neighbouring mentions; skip edges link each mention with the previous
one of the same content, whatever its punctuation, and with the previous one of
similar content (numbers of up to 15 digits that end alike), however far. Loopy
sum-product message passing lets mentions that repeat take one label all over
the document; a mention is named where its belief is high and it has a skip edge.

Weights of nodes, of chain edges (a table of label pairs) and of both kinds of
skip edges are learned together by pseudo-likelihood under a Gaussian prior, on
a sample of about SAMPLE documents by a hash: base spans give labels, and each
base phone also stands for its form without prefix; other mentions count as
other, but those that resemble a base span, whose label is unknown, are left out.

Defined results: a null text is empty and has no spans; offsets count code
points, end exclusive; rows repeated or without doc_id are read like any other;
very long texts are read whole, in time proportional to their length; spans of
one place and different kinds are all kept; an empty table gives an empty
result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "other")
#: Documents that the field's weights are fitted on, on average.
SAMPLE = 4_000
#: Rounds and damping of message passing; the belief that a new span needs.
ROUNDS, DAMPING, BELIEF = 30, 0.3, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?", re.I)
_BEFORE_AT, _AFTER_AT = re.compile(r"[^\s@()\[\]<>,;]*"), re.compile(r"[^\s@()\[\]<>,;]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @, all the local characters before it (back to the last match), and a domain after it."""
    free, at = 0, t.find("@")
    while at >= 0:
        a = at
        while a > free and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        free = at + 1  # a later local part can't hold this @
        if m:
            yield a, m.end()
            free = m.end()
        at = t.find("@", free)


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(t)] if "@" in t else []
    if not re.search("[0-9]", t):
        return out
    if "." in t:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in t:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    """A token on either side of an @, (at) or [at], perhaps with a space between. Tokens hold no such mark, so each is read once."""
    if "@" not in t and "at)" not in (low := t.lower()) and "at]" not in low:
        return
    turned, free = None, 0
    for m in _AT.finditer(t):
        after = _AFTER_AT.match(t, m.end())
        turned = t[::-1] if turned is None else turned
        before = _BEFORE_AT.match(turned, len(t) - m.start())
        a = max(free, m.start() - (before.end() - before.start()))
        if after and a < m.start():
            free = after.end()
            yield a, free


def _mentions(t: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label or -1) of the document's mentions in order; others don't overlap base spans."""
    taken = sorted((a, b) for _, a, b in base)
    nodes = [(a, b, KINDS.index(k)) for k, a, b in base]
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    for found in ((m.span() for m in _NUMBER.finditer(t)), _addresses(t)):
        for a, b in found:
            k = int(np.searchsorted(starts, b, "left"))
            if not k or ends[k - 1] <= a:
                nodes.append((a, b, -1))
    return sorted(nodes)


def _keys(s: str) -> tuple[str, str]:
    """What mentions of the same content share, and what similar ones do (empty: nothing)."""
    if "@" in s or "at)" in s.lower() or "at]" in s.lower():
        return "a:" + "".join(c for c in re.sub(r"(?i)[(\[]at[)\]]", "@", s).lower() if c.isalnum()), ""
    digits = "".join(c for c in s if "0" <= c <= "9")
    if s.count(".") == 3 and len(digits) <= 12 and all(x.isdigit() for x in s.split(".")):
        return "i:" + s, ""
    return ("d:" + digits if len(digits) >= 7 else ""), ("e:" + digits[-9:] if 9 <= len(digits) <= 15 else "")


def skips(texts: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Edges between each mention and the previous one of the same content, and the previous one of similar but other content."""
    same, similar, last = [], [], {}
    for k, s in enumerate(texts):
        full, end = _keys(s)
        j = last.get(full) if full else None
        if j is not None:
            same.append((j, k))
        i = last.get(end) if end else None
        if i is not None and i != j:
            similar.append((i, k))
        for key in (full, end):
            if key:
                last[key] = k
    return same, similar


def features(s: str) -> np.ndarray:
    d = sum("0" <= c <= "9" for c in s)
    return np.array([1, s[:1] == "+", "@" in s, s.count(".") == 3, " " in s, "-" in s, "(" in s, 7 <= d <= 8, 9 <= d <= 12, 13 <= d <= 15, d == 16, d > 16, d >= 13 and luhn("".join(c for c in s if "0" <= c <= "9")), s[-1:].isalpha()], np.float64)


@dataclass
class Field:
    """Log-potentials: nodes (features by labels), chain (label before by label after), same and similar (for equal labels)."""

    nodes: np.ndarray
    chain: np.ndarray
    same: float
    similar: float


#: The prior's mean, which also stands where the sample shows nothing: everything is other, and repeats agree.
PRIOR = Field(np.zeros((14, len(LABELS))), np.zeros((len(LABELS), len(LABELS))), 4.0, 3.0)
PRIOR.nodes[0, -1] = 2.0
#: How much the prior counts, in mentions.
PRIOR_MENTIONS = 1.0


def fit_field(rows: list[tuple], counts: np.ndarray, rounds: int = 400) -> Field:
    """The field of greatest pseudo-likelihood. rows: (features, label, label counts before, after, of the same, of similar content); counts: how often each occurs."""
    if not rows:
        return PRIOR
    x, before, after, same, similar = (np.array([r[k] for r in rows], np.float64) for k in (0, 2, 3, 4, 5))
    y, share = np.eye(len(LABELS))[[r[1] for r in rows]], counts / counts.sum()
    pull = PRIOR_MENTIONS / counts.sum()
    w = [PRIOR.nodes.copy(), PRIOR.chain.copy(), PRIOR.same, PRIOR.similar]
    start, speed = [np.copy(v) for v in w], [np.zeros_like(np.asarray(v, np.float64)) for v in w]
    for _ in range(rounds):
        p = x @ w[0] + before @ w[1] + after @ w[1].T + same * w[2] + similar * w[3]
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (p - y) * share[:, None]
        slopes = [x.T @ off, before.T @ off + off.T @ after, (same * off).sum(), (similar * off).sum()]
        for k, g in enumerate(slopes):
            speed[k] = 0.9 * speed[k] - 0.3 * (g + pull * (w[k] - start[k]))
            w[k] = w[k] + speed[k]
    return Field(w[0], w[1], float(w[2]), float(w[3]))


def beliefs(unary: np.ndarray, edges: list[tuple[int, int, float | np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy sum-product. An edge's log-potential is a table of label pairs, or a number for equal labels."""
    n = unary.shape[1]
    messages, source, target = np.zeros((2 * len(edges), n)), np.empty(0, np.int64), np.empty(0, np.int64)
    if edges:
        a, b = (np.array([e[k] for e in edges]) for k in (0, 1))
        table = np.exp(np.array([np.eye(n) * e[2] if np.isscalar(e[2]) else e[2] for e in edges]))
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, messages)
            into = total[source] - messages[back]
            p = np.exp(into - into.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", p, table) + 1e-300)
            new -= new.max(1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * new
            if change < 1e-4:
                break
    total = unary.copy()
    np.add.at(total, target, messages)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def graph(t: str, nodes: list[tuple[int, int, int]], field: Field) -> tuple[np.ndarray, list[tuple], set[int]]:
    """The document's field: node potentials (base spans observed), edges, and the nodes with a skip edge."""
    texts = [t[a:b] for a, b, _ in nodes]
    same, similar = skips(texts)
    unary = np.array([features(s) for s in texts]) @ field.nodes
    for k, (_, _, y) in enumerate(nodes):
        if y >= 0:
            unary[k] = np.where(np.arange(len(LABELS)) == y, 0.0, -50.0)
    edges = [(k - 1, k, field.chain) for k in range(1, len(nodes))] + [(i, k, field.same) for i, k in same] + [(i, k, field.similar) for i, k in similar]
    return unary, edges, {k for e in same + similar for k in e}


def added_spans(t: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The spans that the field adds."""
    nodes = _mentions(t, base)
    if len(nodes) < 2 or all(y >= 0 for _, _, y in nodes):
        return []  # nothing repeats, or nothing is open
    unary, edges, repeated = graph(t, nodes, field)
    if not any(nodes[k][2] < 0 for k in repeated):
        return []
    p = beliefs(unary, edges)
    best = p.argmax(1)
    return [(KINDS[best[k]], a, b) for k, (a, b, y) in enumerate(nodes) if y < 0 and k in repeated and best[k] < len(KINDS) and p[k, best[k]] >= BELIEF]


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def training_rows(t: str) -> Iterator[tuple]:
    """A document's mentions of known label as fit_field() takes them; mentions of unknown label are nobody's neighbours."""
    nodes = _mentions(t, base_spans(t))
    texts = [t[a:b] for a, b, _ in nodes]
    sure = {key for s, (_, _, y) in zip(texts, nodes, strict=True) if y >= 0 for key in _keys(s) if key}
    label = [y if y >= 0 else len(KINDS) if not sure & set(_keys(s)) else -1 for s, (_, _, y) in zip(texts, nodes, strict=True)]
    near = np.zeros((len(nodes), 4, len(LABELS)))  # before, after, same, similar
    same, similar = skips(texts)
    chain = [(k - 1, k) for k in range(1, len(nodes))]
    for kinds, pairs in (((0, 1), chain), ((2, 2), same), ((3, 3), similar)):
        for i, k in pairs:
            if label[i] >= 0 and label[k] >= 0:
                near[k, kinds[0], label[i]] += 1
                near[i, kinds[1], label[k]] += 1
    for k, s in enumerate(texts):
        if label[k] >= 0:
            yield features(s).tolist(), label[k], *near[k].tolist()
            if label[k] == KINDS.index("phone"):  # the same number as it is written at home
                home = re.sub(r"^\+[0-9]{1,3}\x20?", "", s)
                yield features(home).tolist(), label[k], *near[k].tolist()


_ROWS = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32()), *((c, pa.list_(pa.float64())) for c in ("before", "after", "same", "similar"))])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [r for t in b.column(b.schema.names.index("text")).to_pylist() for r in training_rows(t or "")]
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 5000], strict=True), _ROWS, strict=True)], schema=_ROWS)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field learned on a sample of documents. Its rows are counted by value, of which there are few: features are flags, and a mention has at most two neighbours of a sort."""
    n, span = docs.count(), 1 << 30
    if not n:
        return PRIOR
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) < min(span, span * sample // n)).filter(F.col("text").rlike("[0-9@]"))
    keys = [f.name for f in _ROWS]
    rows = chosen.select("text").mapInArrow(_sampled, "x array<double>, y int, before array<double>, after array<double>, same array<double>, similar array<double>").groupBy(*keys).count().collect()
    rows = sorted((tuple(r[k] for k in keys), r["count"]) for r in rows)
    return fit_field([r for r, _ in rows], np.array([c for _, c in rows], np.float64))


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _found(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in slices(batches):
            rows = []
            for d, t in zip(b.column(b.schema.names.index("doc_id")).to_pylist(), b.column(b.schema.names.index("text")).to_pylist(), strict=True):
                t = t or ""
                base = base_spans(t)
                more = added_spans(t, base, field)
                n = [sum(x[0] == k for x in base) for k in KINDS]
                text = _listed(base)
                rows.append((d, *n, hashlib.sha256(text.encode()).hexdigest(), _listed(base + more) if more else text, len(more)))
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs (doc_id, text) to counts, digest and spans of personal data in each text; n_added of the spans are the field's."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_found(fit(rows) if field is None else field), _RESULT)
