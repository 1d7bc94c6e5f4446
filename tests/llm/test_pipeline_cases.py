"""All stages on hard tables: empty ones, nulls, repeated rows, columns named as operators might name their own."""

from __future__ import annotations

import shutil

import corpus_pipeline
import pytest
from helpers import corpus

from quern.llm import common

NAMES = ("d", "v", "row", "row_key", "row_version", "mix_taken", "mix_key", "taken", "size", "version", "fp", "shard", "C0")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    shutil.copy("/root/testdata/sf0.001/labels.parquet", at / "labels.parquet")
    return str(at)


def through(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {"input": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, folder).cache()
        assert name == "packing" or docs.columns == out["input"].columns
        out[name] = docs
    return out


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_hard_rows(spark, folder, empty):
    rows = [(*r[:5], *(f"{n}{r[0]}" for n in NAMES)) for r in corpus()]
    rows += [(4, rows[4][1], "zz", "z", 0, *("other" for _ in NAMES)), (None, None, None, None, None, *(None for _ in NAMES)), (None, "no id here", "en", "b", 1, *("x" for _ in NAMES))]
    rows = [] if empty else rows
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    at = through(spark, rows, folder)
    if empty:
        assert all(x.count() == 0 for x in at.values())
        return
    exact, near = at["exact_dedup"].collect(), at["simhash_dedup"].collect()
    low = lambda t: (t or "").encode().lower()
    assert len(exact) == len({low(r["text"]) for r in exact}) == len({low(r["text"]) for r in at["toxicity"].collect()})
    assert {repr(r) for r in exact} <= {repr(r) for r in at["input"].collect()}  # rows stay as they were
    assert {repr(r) for r in near} <= {repr(r) for r in exact}
    again = through(spark, rows[::-1], folder)
    assert {repr(r) for r in near} == {repr(r) for r in again["simhash_dedup"].collect()}
    originals = {(r["doc_id"], r["d"]): r["text"] for r in near}
    for r in at["mixing"].collect():
        assert (originals[r["doc_id"], r["d"]] or "").startswith(r["text"])
    assert at["packing"].count() > 0


def test_folders_are_deleted(spark):
    with common.folders() as made:
        a = common.stored(spark.range(3))
        b = common.stored(spark.range(4))
    other = common.stored(spark.range(5))
    assert a.count() == 3 and len(made) == 2
    common.dropped(a)
    common.release(made)
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        b.count()
    assert other.count() == 5
    common.dropped(other)


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session()).startswith("file:")
