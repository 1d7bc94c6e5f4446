"""Each operator against brute force on a small corpus of hard cases, and on an empty table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import corpus, frame, words
from pyspark.sql import functions as F

from quern.llm import common, components, exact_dedup, fingerprints, fixity, language_model, mixing, packing, pii, simhash_dedup, substring_dedup, toxicity

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def multiset(rows):
    return Counter(map(repr, rows))


def test_substring_dedup(docs, nothing, monkeypatch):
    n = 35
    seqs = [words(r[1]) for r in ROWS]
    seen = Counter(tuple(w[i : i + n]) for w in seqs for i in range(len(w) - n + 1))
    expected = []
    for r, w in zip(ROWS, seqs, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                keep[i : i + n] = [False] * n
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        expected.append((r[0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    found = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert multiset(tuple(r) for r in found) == multiset(expected)
    assert sum(r["n_removed"] for r in found) > 9000
    assert substring_dedup.remove_repeats(nothing).count() == 0
    for size in (2000, 300):  # more ranges than parts
        monkeypatch.setattr(substring_dedup, "RANGE", size)
        monkeypatch.setattr(substring_dedup, "CHUNK", 3000)
        again = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert multiset(tuple(r) for r in again) == multiset(expected)


def test_substring_counting_holds_one_range_at_a_time(monkeypatch):
    """Rows of a part, counted range by range: what is in memory at once doesn't grow with the number of ranges."""
    most = []
    real = substring_dedup._counted

    def watched(z, chunks, sizes, *rest):
        most.append(sum(sizes))
        return real(z, chunks, sizes, *rest)

    monkeypatch.setattr(substring_dedup, "_counted", watched)
    r = np.random.default_rng(0)
    for ranges in (2, 20):
        most.clear()
        rows = [(0, k, c, None, r.integers(0, 1 << 62, 500).astype(np.uint64).tobytes(), r.integers(0, 9, 500).astype(np.uint16).tobytes(), substring_dedup._gaps(np.arange(500))) for k in range(ranges) for c in range(3)]
        list(substring_dedup._counter(substring_dedup._batches(rows, substring_dedup._ENTRY, 7)))
        assert max(most) == 1500


def test_substring_intervals(spark):
    words35 = " ".join(f"q{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"a {words35} b"), (2, words35)], "doc_id int, text string")
    r = {x["doc_id"]: x for x in substring_dedup.remove_repeats(df).collect()}
    assert r[1]["kept_text"] == "a b"
    assert [(s["start"], s["end"]) for s in r[1]["removed"]] == [(1, 41)]
    assert r[2]["kept_text"] == ""


def test_window_hash_finds_equal_windows():
    roll = substring_dedup._Rolling(3)
    w = np.array([5, 6, 7, 9, 5, 6, 7, 8], np.uint64)
    hi, lo = roll(w)
    assert hi[0] == hi[4] and lo[0] == lo[4]
    assert len(set(hi.tolist())) == 5


@pytest.mark.parametrize("places", [[], [0], [3, 70_000, 70_001], list(range(0, 500, 3)), [0, 300, 300_000]])
def test_gaps_round_trip(places):
    assert substring_dedup._ungapped(substring_dedup._gaps(np.array(places, np.int64))).tolist() == places


CASES = [
    "mail a.b+c@x-y.example.org, and d@e, f@g.h@i.j",
    "x@@y.com a@b.c-d.e. @no.such  ..@a.b",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500000000000004 12",
    "+1 (988) 555-2485 x +12 +3 4 +49.30.123456789012345 + 1",
    "é +1 (724) 555-7058 ü a@b.co",
    "1" * 3000 + "." + "2" * 3000,
    "a" * 5000 + "@" + "b" * 5000,
]


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    at = lambda p, ok=lambda m: True: [m.span() for m in re.finditer(p, text) if ok(m[0])]
    value = lambda p: int(p) if len(p.lstrip("0")) <= 3 else 999
    found = [("email", *s) for s in at(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    found += [("ip", *s) for s in at(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(value(p) <= 255 for p in m.split(".")))]
    found += [("card", *s) for s in at(r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)))]
    return found + [("phone", *s) for s in at(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]


@pytest.mark.parametrize("text", CASES)
def test_pii_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


FILL = " word" * 300
PRIVATE = [
    f"call +1 (988) 555-2485 now.{FILL} again 988-555-2485 but not 555-1234567",
    f"write bob@mail.example{FILL} or bob(at)mail.example, bob @ mail . example",
    f"+49 151 23456789 at home{FILL} 0151 23456789",
    f"4111 1111 1111 1111 then{FILL} 4111.1111.1111.1111 and 8066356210390011{FILL} 8066356210390011",
    "only 988-555-2485 here",
    "10.0.0.1 é +1 (724) 555-7058 ü a@b.co " * 3,
    None,
    "",
    "x" * 3000 + "@" + "y" * 3000 + " 1" * 5000,
]


def plain_marginals(unary, edges):
    """Of every labelling, weighed by its potentials."""
    n, m = unary.shape
    p = np.zeros((n, m))
    for labels in np.ndindex(*[m] * n):
        pairs = sum((s[labels[a], labels[b]] if not np.isscalar(s) else s * (labels[a] == labels[b])) for a, b, s in edges)
        w = math.exp(sum(unary[k, y] for k, y in enumerate(labels)) + pairs)
        for k, y in enumerate(labels):
            p[k, y] += w
    return p / p.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def learned_field(spark):
    r = np.random.default_rng(3)
    phone = lambda: f"+1 ({r.integers(200, 999)}) 555-{r.integers(1000, 9999)}"
    texts = []
    for k in range(400):
        p, q = phone(), str(r.integers(10**15, 10**16))
        texts.append(f"a {p} b{FILL[:50]} {p} c user{k}@mail.example d {q} e {q} {r.integers(1, 255)}.2.3.4")
    return pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_pii_field_is_learned(learned_field):
    assert np.abs(learned_field.nodes - pii.PRIOR.nodes).max() > 0.5
    assert np.abs(learned_field.chain).max() > 0.1 and learned_field.same != pii.PRIOR.same
    for x in PRIVATE[:6]:
        for y in pii.training_rows(x):
            assert len(y[0]) == 14 and 0 <= y[1] < 5


def test_pii_gradient_of_pseudo_likelihood_vanishes():
    rows = [r for x in PRIVATE[:4] * 3 for r in pii.training_rows(x)]
    f, counts = pii.fit_field(rows, np.ones(len(rows)), rounds=4000), len(rows)

    def loss(g):
        total = 0.0
        for x, y, before, after, same, similar in rows:
            p = np.array(x) @ g.nodes + np.array(before) @ g.chain + g.chain @ np.array(after) + g.same * np.array(same) + g.similar * np.array(similar)
            total -= p[y] - np.log(np.exp(p).sum())
        far = ((g.nodes - pii.PRIOR.nodes) ** 2).sum() + ((g.chain - pii.PRIOR.chain) ** 2).sum() + (g.same - pii.PRIOR.same) ** 2 + (g.similar - pii.PRIOR.similar) ** 2
        return (total + pii.PRIOR_MENTIONS * far / 2) / counts

    least, r = loss(f), np.random.default_rng(0)
    for _ in range(30):
        g = pii.Field(f.nodes + 0.05 * r.normal(size=f.nodes.shape), f.chain + 0.05 * r.normal(size=f.chain.shape), f.same + 0.05 * r.normal(), f.similar + 0.05 * r.normal())
        assert loss(g) > least


def test_pii_field_names_distant_repeats(learned_field):
    named = lambda x: [(k, x[a:b]) for k, a, b in pii.added_spans(x, pii.base_spans(x), learned_field)]
    assert named(PRIVATE[0]) == [("phone", "988-555-2485")]
    assert ("email", "bob(at)mail.example") in named(PRIVATE[1])
    assert named(PRIVATE[2]) == [("phone", "0151 23456789")]
    assert named(PRIVATE[3]) == [("card", "4111.1111.1111.1111")]  # the repeated number of no kind stays unnamed
    assert named(PRIVATE[4]) == []
    twice = f"ring (988) 555-2485 or{FILL} (988) 555-2485"  # no base span at all: two open mentions agree
    assert named(twice) == [("phone", "(988) 555-2485")] * 2


def test_pii_beliefs_are_the_fields_marginals(learned_field):
    for x in [*PRIVATE[:5], f"(988) 555-2485 4111-1111-1111-1112 (988) 555-2485 u@v.w u @ v . w 9885552485{FILL}"]:
        nodes = pii._mentions(x, pii.base_spans(x))[:6]
        unary, edges, _ = pii.graph(x, nodes, learned_field)
        p, q = pii.beliefs(unary, edges, rounds=300), plain_marginals(unary, edges)
        assert (p.argmax(1) == q.argmax(1)).all() and np.abs(p - q).max() < 0.15  # loops make it approximate
        forest = edges[: max(0, len(nodes) - 1)]  # on the chain alone it is exact
        assert np.allclose(pii.beliefs(unary, forest, rounds=300), plain_marginals(unary, forest), atol=1e-3)


def test_pii_reads_very_long_texts_in_linear_time():
    x = "x" * 1_000_000 + "@" + "y" * 1_000_000 + " 1" * 500_000 + " a(at)b" * 20_000 + ".1" * 100_000
    assert {k for k, _, _ in pii.base_spans(x)} == {"ip"}
    assert len(pii._mentions(x, [])) > 20_000


def test_pii_query(spark, learned_field, nothing):
    rows = [(k if k != 5 else None, x, "s", 1) for k, x in enumerate([*PRIVATE, *CASES])]
    rows += [rows[0], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int").repartition(4)
    expected = []
    for d, x, *_ in rows:
        base = plain_base(x or "")
        more = pii.added_spans(x or "", base, learned_field)
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda y: (pii.KINDS.index(y[0]), y[1])))
        expected.append((d, *(sum(y[0] == k for y in base) for k in pii.KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
    found = pii.find(df, learned_field).collect()
    assert multiset(tuple(r) for r in found) == multiset(expected)
    assert sum(r["n_added"] for r in found) >= 5
    assert [c for c, _ in pii.find(df, learned_field).dtypes][:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert pii.find(nothing).count() == 0


def filled(sizes, weights, share=1.5, most=2):
    """Deals by weight, again and again."""
    left, out = share * sum(sizes), {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in out]
        w = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / w > most * sizes[k]]
        if not over:
            return [out.get(k, left * weights[k] / w) for k in range(len(sizes))]
        for k in over:
            out[k] = most * sizes[k]
        left = share * sum(sizes) - sum(out.values())


def test_mixing(docs, nothing):
    size = lambda r: len(words(r[1]))
    names = sorted({r[3] for r in ROWS if r[3] is not None}) + [None]
    sizes = [sum(size(r) for r in ROWS if r[3] == s) for s in names]
    target = dict(zip(names, filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    found = mixing.mix(docs).collect()
    assert multiset((r["doc_id"], r["size"]) for r in found) == multiset((r[0], size(r)) for r in ROWS)
    source = {r[0]: r[3] for r in ROWS[:-2]}
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_mixed_documents(docs, nothing):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(words(r["text"])) for r in rows) == sum(r["taken"] for r in mixing.mix(docs).collect())
    originals = {r[0]: r[1] for r in ROWS}
    assert all((originals[r["doc_id"]] or "").startswith(r["text"]) and len(r["text"]) == r["n_chars"] for r in rows)
    assert mixing.mixed_documents(nothing).count() == 0


def brute_votes(text):
    """The 128 weighted votes, term by term."""
    mask = (1 << 64) - 1

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    w = [xxhash.xxh64_intdigest(x, 17) for x in words((text or "").encode().lower().decode())]
    n, grams = min(5, len(w)), Counter()
    for k in range(len(w) - n + 1 if w else 0):
        g = n
        for x in w[k : k + n]:
            g = mixed((g * 0x9E3779B97F4A7C15 + x) & mask)
        grams[g] += 1
    terms = [(h, 1 + math.log(c)) for h, c in grams.items()] + [(h, 0.2 * (1 + math.log(c))) for h, c in Counter(w).items()]
    votes = [0.0] * 128
    for h, weight in terms:
        raw = b"".join(mixed(h ^ (0xA0761D6478BD642F * (k + 1) & mask)).to_bytes(8, "little") for k in range(2))
        for i in range(128):
            votes[i] += weight if raw[i // 8] >> (7 - i % 8) & 1 else -weight
    return votes


def test_edited_fingerprints(docs, nothing):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = []
    for k, r in enumerate(order):
        t, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        expected.append((r[0], len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    found = fingerprints.edited_fingerprints(docs).collect()
    assert multiset((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == multiset(expected)  # ties and rows without id as well
    bits = lambda x: int.from_bytes(bytes.fromhex(x), "big")
    like = lambda x, y: max(0.0, math.cos(math.pi * (bits(x) ^ bits(y)).bit_count() / 128))
    prints, by_key = {}, {(r["doc_id"], r["edited_sha256"]): r for r in found}
    for k, (r, e) in enumerate(zip(order, expected, strict=True)):
        got, after = by_key[r[0], e[2]], order[(k + 1) % len(order)]
        t, u = r[1] or "", after[1] or ""
        cut = len(t) // 3
        edited_text = t[: len(t) - cut] + u[:cut]
        for text, hexed in ((t, got["fingerprint"]), (edited_text, got["edited_fingerprint"])):
            if text not in prints:
                prints[text] = hexed
                if len(text) < 3000:
                    votes = brute_votes(text)
                    assert all((v > 0) == bool(bits(hexed) >> (127 - i) & 1) for i, v in enumerate(votes) if abs(v) > 1e-9)
            assert prints[text] == hexed
        assert got["near_edited"] == pytest.approx(like(got["fingerprint"], got["edited_fingerprint"]))
        if u in prints:
            assert got["near_next"] == pytest.approx(like(got["fingerprint"], prints[u]))
    assert len(found) == len(ROWS)
    by_text = {}
    for r in found:
        assert by_text.setdefault(next(x[1] or "" for x in ROWS if x[0] == r["doc_id"]), r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in found if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    assert fingerprints.edited_fingerprints(nothing).count() == 0


def test_edited_fingerprints_alone(spark):
    df = spark.createDataFrame([(3, "abc def ghi")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(df).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest()


@pytest.mark.parametrize("radius", [1, 3])
def test_block_tables(spark, radius):
    r = np.random.default_rng(2)
    base = [int.from_bytes(r.bytes(16), "big") for _ in range(12)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(128, d, replace=False)) for b in base for d in (0, 1, 2, 3, 5)}
    df = spark.createDataFrame([(f"{x:032x}",) for x in fps], "fingerprint string")
    expected = {(f"{x:032x}", f"{y:032x}", (x ^ y).bit_count()) for x in fps for y in fps if x != y and (x ^ y).bit_count() <= radius}
    found = [tuple(x) for x in fingerprints.find_near(df, df, radius).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_table_masks():
    masks = fingerprints.table_masks(128, 3)
    fronts = [sum((w & (1 << 64) - 1) << 64 * (1 - k) for k, w in enumerate(m)) for m in masks]
    assert len(set(fronts)) == 16 and {f.bit_count() for f in fronts} == {56}
    r = np.random.default_rng(3)
    for _ in range(2000):
        x = sum(1 << int(k) for k in r.choice(128, 3, replace=False))
        assert any(x & f == 0 for f in fronts)


def test_neighbours_are_counted_over_all_rows(spark, docs, nothing):
    """n_near against brute force: copies, crowded keys, ids that aren't asked for and null ids."""
    r = np.random.default_rng(4)
    base = [int.from_bytes(r.bytes(16), "big") for _ in range(3)]
    near = lambda d: base[0] ^ sum(1 << int(k) for k in r.choice(40, d, replace=False))
    fps = [near(int(d)) for d in r.integers(0, 5, 300)] + base * 20 + [0, 0, (1 << 128) - 1, (1 << 127) + 1]
    ids = [None if k % 7 == 3 else k % 260 for k in range(len(fps))]
    df = spark.createDataFrame([(d, f"{x:032x}", k) for k, (d, x) in enumerate(zip(ids, fps, strict=True))], "doc_id long, fingerprint string, k long")
    got = {x["k"]: x["n_near"] for x in fingerprints.with_neighbours(df).collect()}
    assert got == {k: sum((x ^ y).bit_count() <= 3 for y in fps) - 1 if d is not None and d % 50 == 0 else None for k, (d, x) in enumerate(zip(ids, fps, strict=True))}
    found = fingerprints.fingerprinted(docs).collect()
    whole = [int(x["fingerprint"], 16) for x in found]
    assert len(found) == len(ROWS)
    for x, fp in zip(found, whole, strict=True):
        asked = x["doc_id"] is not None and x["doc_id"] % 50 == 0
        assert x["n_near"] == (sum((fp ^ y).bit_count() <= 3 for y in whole) - 1 if asked else None)
    assert fingerprints.fingerprinted(nothing).count() == 0


def brute_fingerprint(text):
    w = words((text or "").encode().lower().decode())
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    label = dict(zip(fps, fps, strict=True))
    changed = True
    while changed:
        changed = False
        for x in fps:
            least = min(label[y] for y in fps if (x ^ y).bit_count() <= 3)
            if least < label[x]:
                label[x], changed = least, True
    return label


def test_simhash_groups(docs, nothing):
    fp = [brute_fingerprint(r[1]) for r in ROWS]
    label = brute_components(sorted(set(fp)))
    least = {}
    for r, x in zip(ROWS, fp, strict=True):
        if r[0] is not None:
            least[label[x]] = min(least.get(label[x], r[0]), r[0])
    expected = multiset((r[0], x, least.get(label[x])) for r, x in zip(ROWS, fp, strict=True))
    found = simhash_dedup.near_groups(docs).collect()
    assert multiset((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found) == expected
    assert simhash_dedup.near_groups(nothing).count() == 0


def brute_wide(text):
    w = words((text or "").encode().lower().decode())
    n, mask = min(5, len(w)), (1 << 64) - 1

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    def hashed(gram):
        h = xxhash.xxh3_128_digest(gram)
        return h + b"".join(mixed(int.from_bytes(x, "little") ^ 0xA0761D6478BD642F).to_bytes(8, "little") for x in (h[:8], h[8:]))

    bits = [int.from_bytes(hashed(b" ".join(w[k : k + n])), "big") for k in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(256) if 2 * sum(x >> b & 1 for x in bits) > len(bits)).to_bytes(32, "big")


def wide_label(fps):
    """Of each fingerprint, the least that links lead to: 44 bits at most apart, and at most two in some segment."""
    apart = lambda x, y, at: sum((x[k] ^ y[k]).bit_count() for k in at)
    near = {x: [y for y in fps if apart(x, y, range(32)) <= 44 and any(apart(x, y, t) <= 2 for t in simhash_dedup.WIDE_SEGMENTS)] for x in fps}
    label = {x: x for x in fps}
    while True:
        now = {x: min(label[y] for y in near[x]) for x in fps}
        if now == label:
            return label
        label = now


def edited(r, text, share):
    return " ".join(f"e{r.integers(99)}" if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("small", [simhash_dedup.SMALL, 2])
def test_wide_groups(spark, docs, nothing, monkeypatch, small):
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    monkeypatch.setattr(simhash_dedup, "WIDE_RANGE", 2000)  # many ranges a part
    r = np.random.default_rng(12)
    more = [edited(r, x[1], s) for x in ROWS if x[1] and len(x[1]) > 200 and len(x[1]) < 9000 for s in (0.01, 0.03)][:60] + [edited(r, ROWS[9][1], 0.01) for _ in range(30)]
    rows = ROWS + [(1000 + k, t, *ROWS[0][2:]) for k, t in enumerate(more)]
    both = docs.unionByName(frame(spark, rows[len(ROWS) :]))
    fp = [brute_wide(x[1]) for x in rows]
    label = wide_label(sorted(set(fp)))
    groups = {}
    for x, f in zip(rows, fp, strict=True):
        groups.setdefault(label[f], []).append(x[0])
    found = simhash_dedup.similar_groups(both).collect()
    assert multiset((x["row_key"]["id"], bytes(x["fp"])) for x in found) == multiset((x[0], f) for x, f in zip(rows, fp, strict=True))
    kept = simhash_dedup.distinct_documents(both)
    assert kept.columns == docs.columns
    assert multiset(x["doc_id"] for x in kept.collect()) == multiset(min((d for d in ids if d is not None), default=None) for ids in groups.values())
    assert len(groups) < len({x[1] for x in rows}) - 40
    assert simhash_dedup.distinct_documents(nothing).count() == 0


def test_wide_links_find_likeness_of_four_fifths():
    """Recall of pairs by their Jaccard likeness of five-word shingles; unlike texts never link."""
    r = np.random.default_rng(2)
    hit = Counter()
    for k in range(300):
        text = " ".join(f"v{x}" for x in r.integers(0, 3000, 300))
        share = (0.005, 0.01, 0.02)[k % 3]
        texts = [text, edited(r, text, share)]
        grams = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
        likeness = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        x, y = (f.tobytes() for f in simhash_dedup.wide_fingerprints([t.encode() for t in texts]))
        hit[likeness >= 0.8, len(set(wide_label(sorted({x, y})).values())) == 1] += 1
        z = simhash_dedup.wide_fingerprints([" ".join(f"u{v}" for v in r.integers(0, 3000, 300)).encode()])[0].tobytes()
        assert wide_label(sorted({x, z}))[max(x, z)] == max(x, z)
    assert hit[True, True] >= 0.9 * (hit[True, True] + hit[True, False])


def test_links_of_a_crowded_slot(spark, monkeypatch):
    r = np.random.default_rng(3)
    low = r.integers(0, 1 << 12, 300)  # many in one slot of the upper half
    fps = sorted({int(x) | (0xABCD1234 << 32) for x in low} | {int(x) | (0xABCD1235 << 32) for x in low[:50]} | {int.from_bytes(r.bytes(8), "big") >> 1 for _ in range(200)})
    for large, held in ((simhash_dedup.LARGE, simhash_dedup.HELD), (20, 50)):
        monkeypatch.setattr(simhash_dedup, "LARGE", large)
        monkeypatch.setattr(simhash_dedup, "HELD", held)
        links = simhash_dedup.fingerprint_links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"))
        root = {r["node"] % 2**64: r["root"] for r in components.components(links).collect()}
        label = brute_components(fps)
        assert len({root.get(x, x) for x in fps}) == len(set(label.values()))
        assert all((root.get(x, x) == root.get(label[x], label[x])) for x in fps)


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (-5, 200)]
    root = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[k] == 0 for k in range(51))
    assert {root[100], root[101], root[102]} == {100}
    assert root[200] == -5
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_read_slot_by_slot(monkeypatch):
    """Whole slots arrive together, and no more than some at a time."""
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(simhash_dedup, "HELD", 100)
    monkeypatch.setattr(simhash_dedup, "_slots", lambda key, fp: seen.append(key) or iter(()))
    key = np.sort(np.random.default_rng(5).integers(0, 60, 3000)).astype(np.int64)
    batches = [pa.RecordBatch.from_pydict({"key": key[k : k + 40], "fp": key[k : k + 40]}) for k in range(0, 3000, 40)]
    list(simhash_dedup._linked(iter(batches)))
    assert np.concatenate(seen).tolist() == key.tolist()
    assert all(a[-1] != b[0] for a, b in zip(seen, seen[1:], strict=False)) and max(map(len, seen)) < 250


def test_a_hub_is_split(spark):
    """A star of 100,000 leaves: adaptive execution may split the hub's edges, as both sides of the join are plain exchanges."""
    edges = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    found = components.components(edges)
    assert found.groupBy("root").count().collect()[0]["count"] == 100_001
    plan = edges.join(common.stored(edges.groupBy("b").agg(F.min("a").alias("m"))).hint("merge"), "b")._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    length = 256
    found = packing.pack(docs, length=length, shard=16).collect()
    ids = Counter()
    for r in ROWS:
        x = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        ids.update((r[0], k, y) for k, y in enumerate(x))
    got = Counter()
    for r in found:
        piece = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        got.update((r["doc_id"], r["start"] + k, y) for k, y in enumerate(piece))
    assert got == ids
    sequences = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == length or n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(nothing).count() == 0


def test_encoder_matches_tokenizer():
    from tokenizers import Tokenizer

    encode, tok = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for t in [r[1] or "" for r in ROWS[:60]] + ["it's DON'T we'LL. x<|endoftext|>. <|ENDOFTEXT|> é. É! ' 's 12.5% a1,b2; (İ) ﬁ　x"]:
        assert encode.ids(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_encoder_memories_stay_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.Encoder, "LIMIT", 40)
    monkeypatch.setattr(packing.Encoder, "MARKS", 64)
    encode, tok = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for t in [r[1] or "" for r in ROWS[:60]] * 2:
        assert encode.ids(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(encode) <= 40 and len(encode.old) <= 40 and sum(encode.marks) <= 16
    assert encode.old  # both generations were in use


def test_encoder_merges_a_word_once_whatever_marks_end_it():
    from tokenizers import Tokenizer

    encode, tok = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    merge, merged = tok.model.tokenize, []
    encode.merged = lambda x: merged.append(x) or merge(x)
    names = ["inthedstsh", "enréan", "menteñé", "façà"]
    for end in ("", ".", "###", ".%%%", "&&&", "", "***\n"):
        for t in (" ".join(x + end for x in names), " ".join(x + end for x in reversed(names))):
            assert encode.ids(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(merged) == len(names)
    for t in ("É!? x'$$ a'### it's'. ß--- ¼### …### 漢.) ①%% e\u0301### =\u0338= 5%%% ×** é÷-- ª## ŉ.. ǆ!! ﬁ## x\u0327.. \u0345..", "É### <|x|> AB### <|endoftext|>$$$"):
        for x in (t, *t.split()):
            assert encode.ids(x.encode()).tolist() == tok.encode(x, add_special_tokens=False).ids


def test_neighbours_share_rare_tokens():
    index = packing.Index([np.array(x, np.uint16) for x in ([1, 2, 3], [1, 9, 8], [3, 2, 7], [5, 6, 4])])
    assert index.neighbours(0, np.zeros(4, bool)).tolist() == [2, 1]
    assert index.neighbours(0, np.array([False, False, True, False])).tolist() == [1]
    assert index.neighbours(3, np.zeros(4, bool)).tolist() == []


def test_neighbours_by_all_terms_and_without_end():
    seed = np.arange(100, dtype=np.uint16)
    docs = [seed] + [np.array([k % 100, 200 + k], np.uint16) for k in range(300)]
    found = packing.Index(docs).neighbours(0, np.zeros(301, bool))
    assert sorted(found.tolist()) == list(range(1, 301))  # each shares but one of the seed's terms


def test_related_documents_meet_in_a_shard(spark):
    from tokenizers import Tokenizer

    r = np.random.default_rng(8)
    vocabulary = sorted(w for w in Tokenizer.from_file(packing.tokenizer_path()).get_vocab() if w.isascii() and w.isalpha() and w.islower() and len(w) > 6)
    topics = r.choice(vocabulary, (12, 40), replace=False).tolist()
    rows = [(k, " ".join(r.choice(topics[k % 12], 30))) for k in range(1200)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shard=100, length=1024).collect()
    topics_of = {}
    for x in found:
        topics_of.setdefault(x["sequence_id"] >> 32, []).append(x["doc_id"] % 12)
    assert len(topics_of) > 6
    main = sum(max(Counter(v).values()) for v in topics_of.values()) / len(found)
    assert main > 0.3  # at random about one of seven


def test_fixity(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k} é</p>" * (k % 50)) for k in range(3000)] + [(None, None, None), (5, "http://h/5", "twin")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert fixity.audit(pages, pages).count() == 0
    assert fixity.root(pages) == fixity.root(pages.repartition(7))
    changed = [(a, b, (c or "") + "!" if a in (17, 2048) else c) for a, b, c in rows if a != 1500] + [(9000, "u", "new")]
    found = fixity.audit(pages, spark.createDataFrame(changed, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["damage"]) for r in found} == {(17, "corrupt"), (2048, "corrupt"), (1500, "missing"), (9000, "extra")}
    nothing = pages.filter("false")
    assert fixity.audit(nothing, nothing).count() == 0 and fixity.root(nothing) is None
    assert {r["damage"] for r in fixity.audit(nothing, pages).collect()} == {"extra"}
    assert fixity.audit(pages, nothing).filter("damage = 'missing'").count() == len(rows)


def test_fixity_trees_are_each_replicas_own(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 90)) for k in range(4000)] + [(None, "u", f"unnamed {k}") for k in range(30)] + [(77, "v", f"again {k}") for k in range(3)]
    schema = "page_id long, url string, html string"
    make = lambda x: spark.createDataFrame(x, schema).repartition(3)
    root = fixity.root(make(rows))
    shifted = [(a, b, c.replace("<p>9</p>", "<p>9</p>z", 1) if a == 9 else c) for a, b, c in rows]
    cases = {"extra": [*rows, (2500, "u", "more")], "missing": [r for r in rows if r[0] != 1200], "corrupt": shifted}
    for damage, changed in cases.items():
        _, levels = fixity.trees(make(rows), make(changed))
        roots = {r["replica"]: r["sha"] for r in levels[-1][0].collect()}
        assert roots[0] == root != roots[1]
        _, compared = fixity.descend(levels)
        ranges = levels[0][0].count()
        assert compared[0].count() == 2 and compared[-1].count() < ranges / 2  # one file's ranges of some four
        found = fixity.audit(make(rows), make(changed)).collect()
        assert [r["damage"] for r in found] == [damage]
    long = [(1, "u", "x" * 3_000_000), (2, None, None), (None, None, None), (None, None, None)]
    found = fixity.audit(make(long), make([(1, "u", "x" * 2_999_999 + "y"), *long[1:3]])).collect()
    assert sorted((str(r["page_id"]), r["damage"]) for r in found) == [("1", "corrupt"), ("None", "missing")]


def test_fixity_ignores_other_columns(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "text" * k, "x", "y", "z") for k in range(50)], "page_id int, url string, html string, sha string, node string, replica string")
    found = fixity.audit(pages, fixity.damaged(pages).unionByName(pages.select("page_id", "url", "html").filter("page_id = 3"))).collect()
    assert ("extra", 3) in {(r["damage"], r["page_id"]) for r in found}


def test_language_model(docs, nothing):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = [[*words((r[1] or "").encode().lower().decode()), b""] for r in ROWS]
    c = Counter()
    for r, w in zip(ROWS, tokens, strict=True):
        if not held(r[0]):
            c.update(w)
    n, v = sum(c.values()), len(c)
    expected = {}
    for r, w in zip(ROWS, tokens, strict=True):
        expected[r[0]] = (held(r[0]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    for head in (language_model.HEAD, 100):
        found = language_model.score_documents(docs, head=head).collect()
        assert len(found) == len(ROWS)
        for r in found:
            e = expected[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
            assert r["base_score"] == pytest.approx(e[4])
            assert r["score"] < 0
    assert language_model.score_documents(nothing).count() == 0


def test_language_model_learns_from_all_text(spark):
    r = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in r.integers(0, 60, 9000 if k == 3 else 20))) for k in range(2300)] + [(None, None)]
    rows += [(5000 + k, "left right " * 9000) for k in range(30)]  # with the others over 400,000 tokens
    train = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(x for _, t in rows for x in [*words(t), b""])
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    c = language_model.Corpus([w for w, _ in top], np.array([n for _, n in top], np.int64), sum(counts.values()), len(counts))
    p, tokens = language_model.learned(train.repartition(3), c, shard=150_000)
    assert tokens == sum(counts.values()) > 400_000  # whole texts of all documents
    again, _ = language_model.learned(train.repartition(7), c, shard=150_000)
    assert all(np.array_equal(p[k], again[k]) for k in p)
    net, fitted = language_model.Network(c), language_model.Network(c)
    fitted.p = p
    doc = [c.ids(words("left right " * 50))]
    assert fitted.score(doc, c)[0] > 0.5 * net.score(doc, c)[0]  # both are negative


def test_language_model_gradients():
    counts = np.array([9, 7, 5, 4, 3, 2, 1], np.int64)
    corpus_ = language_model.Corpus([b"", b"a", b"b", b"c", b"d", b"e", b"f"], counts, 40, 12)
    net = language_model.Network(corpus_, hidden=4)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    doc, r = np.array([1, 2, 3, 1, 0]), np.random.default_rng(0)
    net.p["c"] += r.normal(size=net.p["c"].shape)
    net.p["w"] += r.normal(size=net.p["w"].shape)

    def loss():
        return -net.score([doc], corpus_)[0] * math.log(10) / len(doc)

    source = np.concatenate([[corpus_.inputs - 1], corpus_.input_of[doc[:-1]]])
    h, kept, states = np.zeros((1, 4)), [], []
    for x in source:
        h, k = net.step(np.array([x]), h)
        kept.append(k)
        states.append(h)
    g, dh = net._output_grads(np.concatenate(states), doc, corpus_)
    net._backward(kept, np.zeros((5, 1), bool), dh.reshape(5, 1, 4), g)
    for name in ("x", "h", "b", "c", "cb", "w", "wb"):
        flat = net.p[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name].ravel()))[:3]:
            old, eps = flat[k], 1e-4
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[name].ravel()[k], rel=2e-2, abs=2e-4)


def test_language_model_learns_as_by_plain_adam(monkeypatch):
    counts, r = np.array([9, 7, 5, 4, 3, 2, 1], np.int64), np.random.default_rng(3)
    c = language_model.Corpus([b"", b"a", b"b", b"c", b"d", b"e", b"f"], counts, 40, 12)
    net, plain = language_model.Network(c, hidden=4), language_model.Network(c, hidden=4)
    net.p, plain.p = ({k: x.astype(np.float64) for k, x in net.p.items()} for _ in range(2))
    first, docs_ = {k: x.copy() for k, x in net.p.items()}, [r.integers(0, 3, 300), r.integers(0, c.inputs - 1, 200)]
    monkeypatch.setattr(language_model, "LANES", 1)
    net.learn(docs_, c)
    words_, source = np.concatenate(docs_), np.concatenate([[c.inputs - 1], docs_[0][:-1], [c.inputs - 1], docs_[1][:-1]])
    m, v = ({k: np.zeros_like(x) for k, x in plain.p.items()} for _ in range(2))
    h, n = np.zeros((1, 4)), -(-len(words_) // language_model.WINDOW)
    for t in range(1, n + 1):
        at = range((t - 1) * language_model.WINDOW, min(t * language_model.WINDOW, len(words_)))
        kept, states = [], []
        for k in at:
            h, x = plain.step(source[k : k + 1], h * (k != 300))
            kept.append(x)
            states.append(h)
        g, dh = plain._output_grads(np.concatenate(states), c.target_of[words_[at.start : at.stop]], c)
        plain._backward(kept, np.array([[k in (0, 300)] for k in at]), dh.reshape(-1, 1, 4), g)
        share = min(1, 5 / math.sqrt(sum((g[k] ** 2).sum() for k in m)))
        for k in m:
            m[k] = 0.9 * m[k] + 0.1 * share * g[k]
            v[k] = 0.999 * v[k] + 0.001 * (share * g[k]) ** 2
            plain.p[k] -= language_model.RATE * (1 - 0.9 * t / n / language_model.EPOCHS) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-6)
    for k in m:
        assert np.abs(plain.p[k] - first[k]).max() > 0.02
        assert net.p[k] == pytest.approx(plain.p[k], abs=2e-5)


def test_rows_met_late_have_moved_on():
    r = np.random.default_rng(0)
    plain = r.normal(size=(50, 6))
    rows, m, v = language_model._Rows(plain.copy()), np.zeros_like(plain), np.zeros_like(plain)
    for t in range(1, 300):
        seen, g, root = np.flatnonzero(r.random(50) < np.linspace(0.9, 0.005, 50)), np.zeros_like(plain), math.sqrt(0.001 / (1 - 0.999**t))
        assert rows.met(seen) == pytest.approx(plain[seen], abs=1e-3)
        g[seen] = 0.01 * r.normal(size=(len(seen), 6))
        step = 0.001 / (1 - 0.9**t) / root, 1e-6 / root
        language_model._moved(plain, g, m, v, np.empty_like(g), *step)
        rows.moved(seen, g[seen], *step)
    assert rows.all() == pytest.approx(plain, abs=1e-3)


def test_probabilities_sum_to_one():
    counts = np.array([9, 7, 5, 4, 3, 2, 1], np.int64)
    c = language_model.Corpus([b"", b"a", b"b", b"c", b"d", b"e", b"f"], counts, 40, 12)
    net = language_model.Network(c, hidden=4)
    h = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    p = [10 ** float(net.log_probs(h, np.array([k]), c)[0]) for k in range(8)]
    tail = p[7] * (40 - counts.sum() + 12 - 7 + 1)  # each word of the tail has its count plus one; unknown words share one
    assert sum(p[:7]) + tail == pytest.approx(1, abs=1e-4)


def test_exact_groups(docs, nothing, monkeypatch):
    norm = lambda t: (t or "").encode().lower()
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    expected = multiset((r[0], best[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1])).hexdigest()) for r in ROWS)
    for head, step in ((exact_dedup.HEAD, exact_dedup.STEP), (1, 2)):
        monkeypatch.setattr(exact_dedup, "HEAD", head)
        monkeypatch.setattr(exact_dedup, "STEP", step)
        found = exact_dedup.exact_groups(docs).collect()
        assert multiset((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == expected
        assert sum(r["kept"] for r in found) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(nothing).count() == 0


def brute_segments(s):
    """Maximal segments by their recursive definition: the best one, then left and right of it."""
    best = max(((sum(s[a:b]), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = best[2:]
    shift = [(x + b, y + b) for x, y in brute_segments(s[b:])]
    return [*brute_segments(s[:a]), (a, b), *shift]


def test_maximal_segments():
    r = np.random.default_rng(4)
    for _ in range(200):
        s = np.round(r.normal(-0.3, 1, r.integers(0, 12)), 3)
        assert [x[:2] for x in toxicity.segments_of(s)] == brute_segments(s.tolist())


def test_toxicity(spark, docs, nothing):
    many = [(k, *r[1:]) for k, r in enumerate(r for seed in range(12) for r in corpus(seed)[:120])]  # unlike texts: copies count once
    big = frame(spark, many)
    labels = spark.createDataFrame([(k, int(any(x in (r[1] or "") for x in ("idiot", "scum", "moron")))) for k, r in enumerate(many)] + [(None, 1), (5, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(big, labels)
    found = toxicity.score(big, model).collect()
    truth = {k: any(x in (r[1] or "") for x in ("idiot", "scum", "moron")) for k, r in enumerate(many)}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    hits = sum(r["predicted"] and truth[r["doc_id"]] for r in held)
    assert hits >= 0.9 * sum(truth[r["doc_id"]] for r in held)
    assert sum(r["predicted"] for r in held) <= hits + 0.05 * len(held)
    clean = toxicity.clean_documents(big, model)
    assert clean.columns == big.columns and clean.count() == sum(not r["predicted"] for r in found)
    none = toxicity.fit(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {toxicity.DEFAULT}
    assert toxicity.score(nothing, model).count() == 0


def test_language_model_scores_in_any_layout(docs):
    by = lambda n: sorted(((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in language_model.score_documents(docs.repartition(n)).collect()))
    a, b = by(3), by(7)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert max(abs(x[2] - y[2]) for x, y in zip(a, b, strict=True)) < 1e-9


def test_language_model_score_is_a_plain_forward_pass():
    r = np.random.default_rng(9)
    counts = np.sort(r.integers(1, 900, 3000))[::-1].astype(np.int64)
    c = language_model.Corpus([f"w{k}".encode() for k in range(3000)], counts, int(counts.sum()) + 500, 3200)
    net = language_model.Network(c)
    net.p = {k: x + 0.3 * r.standard_normal(x.shape).astype(np.float32) for k, x in net.p.items()}
    docs_ = [r.integers(0, 3001, n).astype(np.int32) for n in (1, 5, 90, 33)]
    p, n = {k: x.astype(np.float64) for k, x in net.p.items()}, net.hidden
    logistic = lambda x: 1 / (1 + np.exp(-x))
    log_share = lambda x, k: x[k] - np.log(np.exp(x).sum())
    for doc, got in zip(docs_, net.score(docs_, c), strict=True):
        h, last, total = np.zeros(n), c.inputs - 1, 0.0
        for w in doc.tolist():
            gx, gh = p["x"][last] + p["b"], h @ p["h"]
            z, q = logistic(gx[:n] + gh[:n]), logistic(gx[n : 2 * n] + gh[n : 2 * n])
            h = (1 - z) * h + z * np.tanh(gx[2 * n :] + q * gh[2 * n :])
            k = c.class_of[w]
            total += log_share(h @ p["c"] + p["cb"], k)
            if w < c.top:
                total += log_share(h @ p["w"][k] + p["wb"][k], w - k * language_model.CLASS)
            total += c.within[w] * math.log(10)
            last = c.input_of[w]
        assert got == pytest.approx(total / math.log(10), rel=1e-4)


def test_language_model_scores_a_text_alone_as_among_others():
    r = np.random.default_rng(10)
    counts = np.sort(r.integers(1, 900, 3000))[::-1].astype(np.int64)
    c = language_model.Corpus([f"w{k}".encode() for k in range(3000)], counts, int(counts.sum()) + 500, 3200)
    net = language_model.Network(c)
    net.p = {k: x + 0.3 * r.standard_normal(x.shape).astype(np.float32) for k, x in net.p.items()}
    docs_ = [r.integers(0, 3001, n).astype(np.int32) for n in r.integers(1, 300, 700)]
    among, turned = net.score(docs_, c), net.score(docs_[::-1], c)
    assert np.array_equal(among, turned[::-1])
    assert all(net.score([docs_[k]], c)[0] == among[k] for k in range(0, 700, 23))


def test_language_model_lanes_dont_wait_for_the_longest_text(monkeypatch):
    r, rows = np.random.default_rng(11), []
    counts = np.sort(r.integers(1, 900, 3000))[::-1].astype(np.int64)
    c = language_model.Corpus([f"w{k}".encode() for k in range(3000)], counts, int(counts.sum()) + 500, 3200)
    net = language_model.Network(c)
    net.p = {k: x + 0.3 * r.standard_normal(x.shape).astype(np.float32) for k, x in net.p.items()}
    docs_ = [r.integers(0, 3001, n).astype(np.int32) for n in [2000, *r.integers(1, 60, 600)]]
    alone = [net.score([d], c)[0] for d in docs_[::60]]
    log_probs = net.log_probs
    monkeypatch.setattr(net, "log_probs", lambda h, *a: (rows.append(len(h)), log_probs(h, *a))[1])
    assert net.score(docs_, c)[::60].tolist() == alone
    assert len(rows) <= 3 and sum(rows) == sum(map(len, docs_))  # in lanes of a text each, 63 calls and more
    assert net.score([], c).tolist() == []


def test_language_model_scores_batches_together(monkeypatch):
    r, calls = np.random.default_rng(12), []
    counts = np.sort(r.integers(1, 900, 3000))[::-1].astype(np.int64)
    c = language_model.Corpus([f"w{k}".encode() for k in range(3000)], counts, int(counts.sum()) + 500, 3200)
    net = language_model.Network(c)
    net.p = {k: x + 0.3 * r.standard_normal(x.shape).astype(np.float32) for k, x in net.p.items()}
    texts = [" ".join(f"w{x}" for x in r.integers(0, 3100, n)) for n in [900, *r.integers(0, 60, 299)]]
    rows = pa.table({"doc_id": range(300), "held_out": [False] * 300, "text": texts}).to_batches(max_chunksize=40)
    alone = [net.score([c.ids(words(t))], c)[0] for t in texts]
    score = net.score
    monkeypatch.setattr(net, "score", lambda ids, *a: (calls.append(sum(map(len, ids))), score(ids, *a))[1])
    for together, least in ((language_model.TOGETHER, 1), (3000, 2)):
        calls.clear()
        monkeypatch.setattr(language_model, "TOGETHER", together)
        found = pa.Table.from_batches(language_model._scorer(c, net)(iter(rows)))
        assert found["doc_id"].to_pylist() == list(range(300)) and found["score"].to_pylist() == alone
        assert least <= len(calls) < len(rows) and min(calls[:-1], default=3000) >= 3000  # before, a call for each batch
        for t, names, n in zip(texts, found["tail_words"].to_pylist(), found["tail_counts"].to_pylist(), strict=True):
            assert dict(zip(names, n, strict=True)) == Counter([w for w in [*words(t), b""] if w not in c.rank])


@pytest.mark.parametrize("head", [language_model.HEAD, 1])
def test_language_model_without_ids_or_training_rows(spark, head):
    schema = "doc_id long, text string, word string, c long"
    rows = [(None, "a b a", "x", 1), (None, "", "x", 1), (None, None, "x", 1)]
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    for table in (rows, [(held, "a b a", "x", 1)]):
        found = language_model.score_documents(spark.createDataFrame(table, schema), head=head).collect()
        assert sorted(r["n_tokens"] for r in found) == sorted(len(words(r[1])) + 1 for r in table)
        assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in found)


def test_frequent_words_by_a_cut_of_counts(spark):
    counts = [(f"w{k}".encode(), n) for k, n in enumerate([900, 900, 500, 40, 40, 40, 7, 1, 1])]
    df = spark.createDataFrame(counts, "word binary, c long")
    found = lambda n: [(bytes(r["word"]), r["c"]) for r in language_model.frequent(df, n)]
    assert found(99) == counts and found(8) == counts[:7] and found(5) == counts[:3] and found(1) == []


def within_radius(fps):
    """Of each wide fingerprint, the least that links lead to, whatever segments they have in common."""
    words = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, 4)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(words ^ x).sum(1) <= 44) for x in words]
    while True:
        now = np.array([label[x].min() for x in near])
        if (now == label).all():
            return {f: fps[k] for f, k in zip(fps, label, strict=True)}
        label = now


def grouped(pairs, names):
    """Sets of names that pairs connect."""
    group = {x: {x} for x in names}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {frozenset(x) for x in group.values()}


@pytest.mark.parametrize(("block", "least", "step"), [(1 << 18, 1 << 12, 1 << 15), (90, 20, 1 << 15), (1 << 18, 1 << 12, 8)])
def test_wide_links_miss_no_pair_within_the_radius(spark, monkeypatch, block, least, step):
    """44 bits apart wherever they lie, also 2 or 3 in every segment; chains, and a crowd that is linked all to all."""
    monkeypatch.setattr(simhash_dedup, "WIDE_RANGE", block)
    monkeypatch.setattr(simhash_dedup, "WIDE_LEAST", least)
    monkeypatch.setattr(simhash_dedup, "WIDE_STEP", step)
    r = np.random.default_rng(21)

    def flipped(x, bits):
        out = bytearray(x)
        for k in bits:
            out[k // 8] ^= 1 << k % 8
        return bytes(out)

    fps = [bytes(32), b"\xff" * 32]
    for k in range(120):
        x = r.bytes(32)
        even = [16 * t + v for t in range(16) for v in r.permutation(16)[: 3 if t % 4 else 2]]  # 12 times 3 and 4 times 2
        fps += [x, flipped(x, even if k % 2 else r.permutation(256)[: 43 + k % 3])]
    for _ in range(6):
        fps.append(flipped(fps[-1], r.permutation(256)[:44]))
    crowd = r.bytes(32)
    fps += [flipped(crowd, r.permutation(256)[:5]) for _ in range(150)]
    fps = sorted(set(fps))
    nodes = simhash_dedup.node_of(np.frombuffer(b"".join(fps), np.uint64).reshape(-1, 4)).tolist()
    expected = grouped([(f, x) for f, x in within_radius(fps).items()], fps)
    assert max(len(x) for x in expected) == 150 and sum(len(x) == 2 for x in expected) >= 90
    name = dict(zip(nodes, fps, strict=True))
    table = spark.createDataFrame(list(name.items()), "node long, fp binary")
    if block < len(fps) or step < 1 << 15:
        dealt = [b for b in simhash_dedup._wide_dealt(5)(iter([pa.record_batch({"fp": pa.array(fps, pa.binary())})]))]
        rows = sorted(((x["pair"], x["block"], x["rows"]) for b in dealt for x in b.to_pylist()), key=lambda x: x[:2])
        ordered = pa.record_batch({k: pa.array(v, t) for k, v, t in zip(("pair", "block", "rows"), zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)})
        here = [(x["a"], x["b"]) for b in simhash_dedup._wide_linked(iter([ordered])) for x in b.to_pylist()]
        assert len({x[0] for x in rows}) == 15 and len(here) < 5 * len(fps)
        assert grouped([(name[a], name[b]) for a, b in here], fps) == expected
    found = [(x["a"], x["b"]) for x in simhash_dedup.wide_links(table).collect()]
    assert grouped([(name[a], name[b]) for a, b in found], fps) == expected
    assert simhash_dedup.wide_links(table.limit(0)).count() == 0


def test_near_copies_are_all_texts_within_the_radius(spark):
    """Edited texts, some of which have no 24 bits of the first 128 in common but for two."""
    r = np.random.default_rng(22)
    texts = [" ".join(f"v{x}" for x in r.integers(0, 3000, 300)) for _ in range(60)]
    texts += [edited(r, t, 0.022) for t in texts]
    fps = [f.tobytes() for f in simhash_dedup.wide_fingerprints([t.encode() for t in texts])]
    label = within_radius(sorted(set(fps)))
    first = {}
    for k, f in enumerate(fps):
        first.setdefault(label[f], k)
    kept = simhash_dedup.distinct_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(first.values())
    assert 65 < len(first) < 115
    assert sum(a + b + 2 for a, b in simhash_dedup.WIDE_WORDS) == simhash_dedup.WIDE_RADIUS + 1
