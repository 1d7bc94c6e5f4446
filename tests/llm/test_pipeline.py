"""The pipeline against a plain version of its stages, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from test_operators import brute_wide, wide_label

from quern.llm import mixing, packing, toxicity
from quern.llm.common import documents, labels

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, FOLDER)
    rows = docs.collect()
    tox = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels(spark, FOLDER))).collect()}
    clean = [r for r in rows if not tox[r["doc_id"]]]
    best = {}
    for r in clean:
        k = (r["text"] or "").encode().lower()
        if k not in best or best[k]["doc_id"] < r["doc_id"]:
            best[k] = r
    exact = list(best.values())
    fp = {r["doc_id"]: brute_wide(r["text"]) for r in exact}
    label = wide_label(sorted(set(fp.values())))
    near = {}
    for r in exact:
        c = label[fp[r["doc_id"]]]
        near[c] = min(near.get(c, r["doc_id"]), r["doc_id"])
    stages = dict(corpus_pipeline.STAGES)
    out, at = docs, {}
    for name, f in stages.items():
        out = at[name] = f(spark, out, FOLDER).cache()
        if name != "packing":
            assert out.columns == docs.columns
    ids = lambda n: sorted(r["doc_id"] for r in at[n].select("doc_id").collect())
    assert ids("toxicity") == sorted(r["doc_id"] for r in clean)
    assert ids("exact_dedup") == sorted(r["doc_id"] for r in exact)
    assert ids("simhash_dedup") == sorted(near.values())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(at["simhash_dedup"]).collect()}
    got = {}
    for r in at["mixing"].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").encode().split())
    assert got == {d: n for d, n in taken.items() if n}
    encode = packing.Encoder(packing.tokenizer_path())
    total = sum(len(encode.ids((r["text"] or "").encode())) + 1 for r in at["mixing"].collect())
    pieces = at["packing"].collect()
    assert sum(r["length"] for r in pieces) == total
    sizes = {}
    for r in pieces:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert np.all([n == 4096 or n & (n - 1) == 0 for n in sizes.values()])


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
