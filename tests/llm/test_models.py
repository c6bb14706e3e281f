"""Joins, searches and classifiers: brute force on small tables, held-out accuracy where there is no other truth."""

from __future__ import annotations

import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, linear, neighbours, quality, queries, toxicity, urls
from tessera.llm.common import table

from .conftest import ODD


def sets_of(docs, k):
    out = {}
    for r in docs.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().lower().split()
        out[r["doc_id"]] = frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()
    return out


def plain_components(sets, part, whole):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * whole >= max(len(x), len(y)) * part and len(x & y) * whole >= part * len(x | y):
            i, j = sorted((find(a), find(b)))
            parent[j] = i
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("k, similarity", [(3, (9, 10)), (5, (4, 5)), (2, (1, 2))])
def test_jaccard_components(spark, sf_dir, k, similarity):
    docs = table(spark, sf_dir, "documents")
    sets = sets_of(docs, k)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs, words=k, similarity=similarity).collect()}
    assert {d: got[d]["n_shingles"] for d in sets} == {d: len(s) for d, s in sets.items()}
    assert {d: got[d]["component_id"] for d in sets} == plain_components(sets, *similarity)


def test_jaccard_of_a_large_group_of_near_copies(spark, make_docs):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # every one differs from the others; links run through the middle of the group
        own = list(words)
        for j in rng.choice(120, rng.integers(0, 4), replace=False):
            own[j] = f"x{i}{j}"
        rows.append((i, " ".join(own)))
    docs = make_docs(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, words=3, similarity=(9, 10)).collect()}
    assert got == plain_components(sets_of(docs, 3), 9, 10)


def test_jaccard_of_many_texts_that_share_a_base_but_are_not_similar(spark, make_docs, monkeypatch):
    """Each has a fifth of its own words, so none of its rarest ones is another's: they don't wait for each other's rounds."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        own = [f"w{j}" for j in range(120)]
        for j in rng.choice(120, 26, replace=False):
            own[j] = f"x{i}_{j}"
        rows.append((i, " ".join(own)))
        if i % 9 == 0:
            rows.append((100 + i, " ".join([*own[:60], f"y{i}", *own[61:]])))
    waiting, plain = [], jaccard.checkpointed

    def counted(df, n=None):
        made = plain(df, n)
        if {"segment", "label"} <= set(made.columns):
            waiting.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "checkpointed", counted)
    docs = make_docs(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, words=1, similarity=(4, 5)).collect()}
    assert got == plain_components(sets_of(docs, 1), 4, 5) and sum(d != c for d, c in got.items()) == 10
    assert sum(waiting) < len(rows)


def test_jaccard_of_a_long_chain(spark, make_docs):
    """The estimated size of a loop's plans was the product of all rounds before: its digits took the driver's memory."""
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(f"w{j}" for j in range(k, k + 60))) for k, i in enumerate(rng.permutation(40))]
    found = jaccard.jaccard_components(make_docs(rows), words=1, similarity=(9, 10))
    assert {r["component_id"] for r in found.collect()} == {0}
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 1000


def test_jaccard_of_many_ids_neither_gathers_them_nor_shuffles_texts(spark, sf_dir, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "FILTER_WORDS", 16)  # far too few bits: many others are let through
    docs = table(spark, sf_dir, "documents")
    for rows in (docs, make_docs([(i, " ".join(f"w{j}" if (i * 7 + j) % 31 else f"x{i}" for j in range(60))) for i in range(40)])):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows, words=3, similarity=(4, 5)).collect()}
        assert got == plain_components(sets_of(rows, 3), 4, 5)
    ids = spark.range(0, 200, 3)
    found = jaccard._segments(docs, ids, "doc_id", "text", 3, 9, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r["id"] for r in found.select("id").distinct().collect()} >= {r["doc_id"] for r in docs.where("doc_id % 3 = 0 and size(split(text, ' ')) > 100").collect()}


def test_jaccard_at_the_threshold(spark, make_docs):
    words = [f"a{i}" for i in range(40)]
    at = [(1, " ".join(words[:20])), (2, " ".join([*words[:18], "z"])), (3, " ".join(words[:19])), (4, "one"), (5, "ONE"), (6, "one two")]
    docs = make_docs(at)
    for k, similarity in ((1, (9, 10)), (3, (4, 5))):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, words=k, similarity=similarity).collect()}
        assert got == plain_components(sets_of(docs, k), *similarity)


def test_jaccard_of_odd_rows(spark, make_docs):
    docs = make_docs(ODD)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()]
    assert len(got) == len(ODD)
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert {g for g in got if g[0] in (4, 5)} == {(4, 1, 4), (5, 1, 4)}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_segments_meet_the_pigeonhole():
    rng = np.random.default_rng(3)
    for part, whole in ((9, 10), (4, 5), (1, 2)):
        bands = jaccard.Bands(part, whole)
        for n in (3, 10, 25, 60, 300, 2000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                b = np.union1d(a[: max(1, int(len(a) * (0.9 + 0.1 * rng.random())))], rng.integers(0, 1 << 62, rng.integers(0, 1 + n // 8)).astype(np.uint64))
                same = len(np.intersect1d(a, b))
                if same * whole < part * (len(a) + len(b) - same) or (len(a) == len(b) == same):
                    continue
                keys = [set(np.concatenate([jaccard.segment_keys(s, *band) for band in bands.segments(len(s))] or [np.zeros(0)]).tolist()) for s in (a, b)]
                assert keys[0] & keys[1]
                band = bands.of(max(len(a), len(b)))
                x, y = (jaccard.sketch(s, band, bands.sketch_words(band)) for s in (a, b))
                assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def nearest_by_hand(rows, queries_, k):
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for q in queries_:
        i = int(np.flatnonzero(ids == q)[0])
        score = x @ x[i] / (norms * norms[i])
        out[q] = [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("relax, least", [(1.0, 1.0), (2.0, 0.9)])
def test_neighbours(spark, sf_dir, relax, least):
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.collect()
    want = nearest_by_hand(rows, [r["vec_id"] for r in rows if r["vec_id"] % 50 == 0], 5)
    got = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, relax=relax, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= least * sum(map(len, want.values()))


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-1.0, 0.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(vectors, vectors.where("vec_id % 5 = 0"), k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, -1.0)]
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(600)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in neighbours.nearest(same, same.where("vec_id = 3"), k=5).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


def test_gapped_and_inserted_words_resemble_the_word():
    marks = toxicity.Landmarks(["idiot", "garden"])
    near = marks.similarities(["idiot", "idxiot", "idi0t", "idot", "garden", "window"])[:, 0]
    assert near[0] >= 0.99 and near[1] > 0.4 and near[3] > 0.2
    assert max(near[4], near[5]) < 0.1
    assert [toxicity.fold(w) for w in ("1d1ot!", "i-d-i-o-t", "2024", "naïve.")] == ["idiot", "idiot", "2024", "naïve"]
    assert "idiot" in toxicity.words_of("you i d i o t there")


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op2_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    hits = sum(r["predicted"] and r["toxic"] for r in scored)
    assert hits / sum(r["predicted"] for r in scored) > 0.9 and hits / sum(r["toxic"] for r in scored) > 0.85


@pytest.mark.parametrize("labels", [[], [(4, 1, 1)], [(4, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 1), (8, 1, 0)]])
def test_classifiers_of_odd_rows(spark, make_docs, labels):
    docs, marked = make_docs(ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, marked).count() == len(ODD)
    assert quality.quality(docs, marked).count() == len(ODD)
    assert toxicity.toxicity(docs.limit(0), marked).count() == quality.quality(docs.limit(0), marked).count() == 0


def test_quality_keeps_the_good(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").collect()
    good, bad = [r["keep"] for r in got if r["quality"]], [r["keep"] for r in got if not r["quality"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.5
    views = [np.stack([truth + rng.normal(0, 0.45, 3000), rng.normal(0, 1, 3000)], 1) for _ in (0, 1)]
    known = np.arange(3000) < 60
    model = quality.co_train(tuple(v[known] for v in views), truth[known].astype(float), np.arange(60) % 4 == 3, tuple(v[~known] for v in views), sure=0.9)
    assert ((model.chance(tuple(v[~known] for v in views)) > 0.5) == truth[~known]).mean() > 0.9


def test_url_rules_equal_sql(spark, sf_dir):
    got = {(r["page_id"], r["host"], r["path"], r["rule"]): r["verdict"] for r in queries.op5_url_filter(spark, sf_dir).collect()}
    want = duckdb.sql(
        f"""SELECT page_id, host, path, CASE
          WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
          WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
          WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
        FROM (SELECT page_id, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM '{sf_dir}/pages.parquet')"""
    ).fetchall()
    assert set(got) == set(want)
    verdicts = {"com/": "allow", "www.example.com/en/": "allow"}
    assert all(v == verdicts.get(k[3], "block") for k, v in got.items() if k[3])


def test_urls_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://WWW.Example.COM/en/x?a=b#c"), (5, "http://é.net/es/"), (6, "x://com"), (7, "http://a.com/" + "q" * 50_000), (7, "http://a.com/"), (8, "http://b.net?x=/es/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = {(r["page_id"], r["host"], r["path"][:9], r["rule"]) for r in urls.judge_urls(pages, queries.RULES).collect()}
    assert got == {(1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "www.example.com", "/en/x", "www.example.com/en/"), (5, "é.net", "/es/", "net/es/"), (6, "com", "", None), (7, "a.com", "/qqqqqqqq", "com/"), (7, "a.com", "/", "com/"), (8, "b.net", "", None)}
    assert urls.judge_urls(pages.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages.where("page_id < 3"), queries.RULES).collect()} == {"allow"}


def test_svm_and_logistic_separate():
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.5
    x = np.stack([y * 2 - 1 + rng.normal(0, 0.3, 400), np.ones(400)], 1)
    assert ((x @ linear.fit_svm(x, np.where(y, 1.0, -1.0), np.ones(400)) > 0) == y).mean() > 0.99
    assert ((x @ linear.fit_logistic(x, y.astype(float), np.ones(400)) > 0) == y).mean() > 0.99
