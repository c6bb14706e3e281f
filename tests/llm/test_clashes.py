"""Columns named like those made inside, extreme magnitudes, letters that folding takes apart."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import fingerprints, jaccard, neighbours, quality
from tessera.llm.common import table


def test_groups_keep_a_column_of_the_row_id(make_docs):
    docs = make_docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words")]).withColumn("_row_id", F.concat(F.lit("r"), "doc_id")).withColumn("_ROW_ID_", F.lit(7))
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["_row_id"], r["_ROW_ID_"]) for r in got.collect()) == [(1, "r1", 7), (3, "r3", 7)]


def test_quality_with_a_column_y(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    clash = docs.selectExpr("*", "'mine' AS y", "1 AS quality", "2 AS content", "3 AS metadata", "4 AS score")
    score = lambda d: {r["doc_id"]: round(r["score"], 9) for r in quality.quality(d, labels).select("doc_id", "score").collect()}
    assert score(clash) == score(docs)


def cosine_rank(vectors, key, k):
    """The nearest by cosines of integers and fractions; vectors are made so that no two near ones are closer than rounding."""
    def squared(a, b):
        dot = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
        return (1 if dot >= 0 else -1) * dot * dot / (sum(Fraction(x) ** 2 for x in a) * sum(Fraction(y) ** 2 for y in b))

    found = sorted((-squared(vectors[key], v), i) for i, v in vectors.items() if i != key)
    return [i for _, i in found[:k]]


def test_extreme_magnitudes(spark):
    random = np.random.default_rng(4)
    sizes = [1e200, 1e-200, 1.0]
    vectors = {i: [float(x) for x in random.standard_normal(4) * sizes[i % 3]] for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert len(got) == 15
    for q in (0, 20, 40):
        assert [r["vec_id"] for r in got if r["query_id"] == q] == cosine_rank(vectors, q, 5)
    assert all(np.isfinite(r["score"]) and abs(r["score"]) < 1 + 1e-12 for r in got)


def test_folded_letters_are_normalised_again(make_docs):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(make_docs([(1, "ǰ x"), (2, "J̌ X"), (3, "j x")])).collect()}
    assert got[1] == got[2] != got[3]
