"""The stored index against BM25 over the texts."""

from __future__ import annotations

import pytest

from tessera.operators import search as S
from tessera.operators import stored_index as I
from tessera.sources.tables import read


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Documents in two batches and small blocks."""
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "text"), str(tmp_path_factory.mktemp("index"))
    I.append(docs.where("doc_id % 3 = 0"), path, key="doc_id", text="text", chunk=8)
    I.append(docs.where("doc_id % 3 <> 0"), path, key="doc_id", text="text", chunk=8)
    return docs, path


@pytest.mark.parametrize("query", [["the", "and"], ["die"], ["the", "der", "nowhere"], ["nowhere"], []])
def test_scores(spark, stored, query):
    docs, path = stored
    want = {r["doc_id"]: r["score"] for r in S.bm25(docs, query, key="doc_id", text="text").collect()} if query else {}
    got = {r["key"]: r["score"] for r in I.search(spark, path, query).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    top = [(r["key"], r["score"]) for r in I.search(spark, path, query, k=7).collect()]
    assert top == sorted(got.items(), key=lambda x: (-x[1], x[0]))[:7]


def test_what_is_read(spark, stored):
    docs, path = stored
    plan = I.search(spark, path, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "text" not in plan.replace("textfile", "")
    assert "PushedFilters: [" in plan and "term" in plan


def test_blocks_that_cannot_win_are_left_out(spark, tmp_path):
    rows = [(i, "rare word " + "filler " * 30 if i < 5 else "common " + "filler " * (40 + i)) for i in range(200)]
    path = str(tmp_path / "i")
    I.append(spark.createDataFrame(rows, "id long, t string").coalesce(1), path, key="id", text="t", chunk=4)
    assert [r["key"] for r in I.search(spark, path, ["rare", "filler"], k=3).collect()] == [0, 1, 2]
    plan = I.search(spark, path, ["rare", "filler"], k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" in plan  # the bound of blocks


def test_odd_documents(spark, tmp_path):
    path = str(tmp_path / "i")
    I.append(spark.createDataFrame([(1, None), (2, ""), (None, "the cat"), (3, "cat cat")], "id long, t string"), path, key="id", text="t")
    assert [r["key"] for r in I.search(spark, path, ["cat"]).collect()] == [3]
    I.append(spark.createDataFrame([(4, "dog cat")], "id long, t string"), path, key="id", text="t")
    assert sorted(r["key"] for r in I.search(spark, path, ["cat", "dog"]).collect()) == [3, 4]
    empty = str(tmp_path / "e")
    I.append(spark.createDataFrame([], "id long, t string"), empty, key="id", text="t")
    assert I.search(spark, empty, ["cat"]).collect() == []
