"""Ties, pruning, long texts, held-out figures, and stages on odd rows."""

from __future__ import annotations

import itertools
import random
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.llm import fingerprints, neighbours, pii, quality, queries, secrets, toxicity, urls
from tessera.llm.common import table

from .conftest import ODD


def by_hand(rows, asked, k):
    """Largest cosine first, ties to the smaller id; scores by the operator's own formula, as rounding decides among parallel vectors."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in asked:
        score = neighbours.cosines(x, np.broadcast_to(x[int(np.flatnonzero(ids == q)[0])], x.shape))
        out[q] = [(int(ids[j]), float(score[j])) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != q][:k]
    return out


def test_factor_one_is_exact_with_inner_nodes_and_ties(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = [(c + rng.normal(size=16) * 0.2).astype(np.float32) for c in centre for _ in range(120)]  # clustered
    x += [rng.normal(size=16).astype(np.float32) for _ in range(400)]
    x += [(centre[0] * 2.0**p).astype(np.float32) for p in range(-20, 20)]  # parallel
    x += [centre[1].astype(np.float32)] * 300  # equal
    order = rng.permutation(len(x))
    rows = [(i, [float(v) for v in x[j]]) for i, j in enumerate(order)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    asked = [i for i, _ in rows if i % 20 == 0] + [int(np.flatnonzero(order == len(x) - 5)[0]), int(np.flatnonzero(order == len(x) - 310)[0])]
    got = {}
    for r in neighbours.nearest(vectors, vectors.where(F.col("vec_id").isin(asked)), k=5, relax=1.0, shard_rows=300, sample=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == by_hand(rows, asked, 5)


def test_trees_prune_clustered_vectors():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=16) + 0.15 * rng.normal(size=(200, 16)) for _ in range(30)])
    tree = neighbours.Tree(x, [np.array([i]) for i in range(len(x))])
    want = by_hand(list(enumerate(x)), range(0, len(x), 60), 5)
    for relax, most in ((1.0, 0.2), (2.0, 0.1)):
        tree.visited = tree.asked = 0
        best = tree.search(x[::60], np.arange(0, len(x), 60), 5, relax)
        found = sum(len({i for i, _ in want[q]} & set(ids.tolist())) for q, ids in zip(want, best.ids, strict=True)) / (5 * len(want))
        assert found == 1.0 if relax == 1 else found >= 0.9
        assert tree.visited / (tree.asked * tree.leaves) < most


LONG = ["a" + "." * 200_000 + "b", "a.b" * 70_000 + " @x", "@" * 200_000, "a@b" * 70_000, "1." * 100_000, "+1(" * 70_000, "(030) 1234 5678 a@b.co " * 9_000, "-----BEGIN PRIVATE KEY-----\n" * 8_000,
        "MIIB" * 50_000, "eyJ." * 50_000, "password " * 20_000, "a b " * 50_000 + "zz"]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:8])
def test_long_texts_take_linear_time(text):
    """A scan of the quadratic kind takes minutes on these; the bound leaves room for a slow machine."""
    for work in (lambda: [toxicity.fold(w) for w in toxicity.words_of(text)], lambda: pii._apart(list(pii._candidates(text))), lambda: secrets.base_spans(text) + secrets.confirmed_spans(text)):
        began = time.process_time()
        work()
        assert time.process_time() - began < 4


def test_toxicity_is_the_same_however_rows_are_dealt(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(13))]
    assert scores[0].keys() == scores[1].keys() and max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 1e-6


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.fold_of(F.col("doc_id")) == 2
    scored = quality.score(docs, quality.train(docs, labels.where(~held)))
    rows = scored.join(labels.where(held), "doc_id").collect()
    good, bad = ([r["score"] >= 0.5 for r in rows if r["quality"] == q] for q in (1, 0))
    print("quality, held out:", len(rows), np.mean(good), 1 - np.mean(bad))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.15


def test_url_trees_on_held_out_urls(spark):
    """One fold of the URLs that rules fit is kept from the trees."""
    rows = urls.featured(table(spark, "/root/testdata/sf0.1", "pages"), queries.RULES)
    model = urls.train(rows.where("fold <> 4"), sample=20_000)
    held = VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(rows.where("fold = 4 and label is not null"))
    got = model.transform(held).select("label", "prediction").collect()
    right = np.mean([r["label"] == r["prediction"] for r in got])
    print("url, held out:", len(got), right)
    assert len(got) > 50 and right >= 0.95


def test_a_urls_own_label_is_not_among_its_features(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/es/{i}") for i in range(40)] + [(99, "http://a.com/")], "page_id long, url string")
    rows = urls.featured(pages, queries.RULES).where("page_id < 40").select("fold", "f_end_rate").collect()
    inside = {f: sum(r["fold"] == f for r in rows) for f in range(urls.FOLDS)}
    assert all(abs(r["f_end_rate"] - (40 - inside[r["fold"]] + 1) / (40 - inside[r["fold"]] + 2)) < 1e-9 for r in rows)


def test_added_spans_on_planted_documents(spark):
    """True spans with words that ask for them, decoys with words that speak against them; half the documents are only scored."""
    rnd = random.Random(4)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    true = [lambda: f"phone: (0{d(2)}) {d(4)} {d(4)}", lambda: f"please call (0{d(2)}) {d(4)} {d(4)} today", lambda: f"email: {rnd.choice('abcdefgh')}{d(3)} (at) mail{d(2)} (dot) com"]
    false = [lambda: f"version 0{d(2)}-{d(3)}-{d(4)}", lambda: f"part 000-{d(2)}-{d(4)}", lambda: f"order {d(3)}.{d(3)}.{d(4)}"]
    rows = [(i, f"some words here {rnd.choice(true if i % 2 else false)()} and others there mail {d(4)}@example.com") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classifier = pii.train(pii.candidates(docs.where("doc_id < 600")))
    held = [(r["doc_id"] % 2, classifier.accepts(np.array([c["features"] for c in r["found"] if not c["base"]], np.float32)).any()) for r in pii.candidates(docs.where("doc_id >= 600")).collect()]
    caught, false_alarms = np.mean([a for t, a in held if t]), np.mean([a for t, a in held if not t])
    print("added spans, held out:", caught, false_alarms)
    assert caught >= 0.9 and false_alarms <= 0.1


def test_fingerprints_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "A b", 7, 8, "c", "old")], "doc_id long, text string, high int, low int, canon string, fingerprint string")
    got = fingerprints.fingerprints(docs).first().asDict()
    assert {c: got[c] for c in ("doc_id", "text", "high", "low", "canon")} == {"doc_id": 1, "text": "A b", "high": 7, "low": 8, "canon": "c"} and len(got["fingerprint"]) == 32


def test_equal_edited_texts_are_told_apart_in_one_bucket(make_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: (F.length(canon).cast("long"), F.lit(0).cast("long")))
    docs = make_docs([(i, t) for i, t in enumerate(["abcd", "efgh", "abcd", "ijkl"])])
    got = {r["doc_id"]: r for r in fingerprints.edit_report(docs).collect()}
    assert got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"]
    texts = {i: (("abcd", "efgh", "abcd", "ijkl")[i][:2] + ("abcd", "efgh", "abcd", "ijkl")[(i + 1) % 4][:2]) for i in range(4)}
    for i, j in itertools.combinations(range(4), 2):
        assert (got[i]["edited_fingerprint"] == got[j]["edited_fingerprint"]) == (texts[i] == texts[j])


def test_stages_take_odd_rows(spark, sf_dir, make_docs):
    for rows in (ODD, []):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf_dir)
            assert after.columns == docs.columns and after.count() <= len(rows), name
            docs = after
        packed = dict(corpus_pipeline.STAGES)["packing"](spark, make_docs(rows), sf_dir)
        assert packed.where("piece = 0").count() == len(rows)


def test_held_out_marks_follow_the_checksum(spark, make_docs):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for r in toxicity.toxicity(make_docs([(i, "x") for i in range(20)]), labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
