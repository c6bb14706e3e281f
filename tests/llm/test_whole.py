"""Stages that take every row: keys that are null or repeat."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import jaccard, pii

from .conftest import ODD

MAIL, SAFE = "write to a@b.co now please", "write to <email> now please"


def test_redaction_needs_no_key(make_docs):
    docs = make_docs([*ODD, (None, MAIL), (None, MAIL), (9, MAIL), (9, MAIL), (9, MAIL), (1, MAIL)])
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([*ODD, (None, SAFE), (None, SAFE), *[(9, SAFE)] * 3, (1, SAFE)])


def test_redaction_takes_the_spans_that_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, pii.redact(docs)))
    for key, value in before.items():
        parts, at = [], 0
        for s in sorted(spans[key], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                parts += [value[at : s["start"]], f"<{s['kind']}>"]
                at = s["end"]
        assert after[key] == (None if value is None else "".join([*parts, value[at:]]))


def test_one_row_of_each_group(make_docs):
    docs = make_docs([*ODD, (None, MAIL), (None, MAIL), (9, MAIL), (9, MAIL), (None, "other words that nobody has"), (None, "other words that nobody has")])
    got = jaccard.one_of_each(docs).select("doc_id", F.substring("text", 1, 40)).collect()
    want = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text here"), (6, "é ß Ǆ 😀 ﬁ"), (7, "word " * 8), (8, "x" * 40), (None, "no id"), (9, MAIL), (None, "other words that nobody has")]
    assert Counter(map(tuple, got)) == Counter(want)
