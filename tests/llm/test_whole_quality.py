"""Co-training over every unlabelled document."""

from __future__ import annotations

import numpy as np

from tessera.llm import quality


def test_every_unlabelled_row_takes_part(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    x = rng.normal(0, 1, (n, 2))
    table = spark.createDataFrame([([float(a)], [float(b)]) for a, b in x], "content array<double>, metadata array<double>").repartition(70)
    views = tuple(quality.View(np.zeros(1), np.ones(1), 0, np.array([1.0, 0.0])) for _ in (0, 1))
    spread, held = quality.Spread(table), quality.Held((x[:, :1], x[:, 1:]))
    ends = spread.ends(views, 0.05)
    history = [(views, tuple(ends))]
    sums = [rows.total(lambda xs: quality._moments(quality._chosen(history, xs))) for rows in (spread, held)]
    assert np.allclose(*sums) and np.allclose(ends, held.ends(views, 0.05), atol=0.01)
    assert 1990 <= sums[0][0] <= 2010  # a twentieth of all rows from either end


def test_training_exchanges_over_all_documents(spark, monkeypatch):
    texts = [("word%d other text of some length" % i) if i % 2 else "# # | |" for i in range(6_500)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(None, "no key", "en", "s1", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda labelled, y, held, unlabelled: seen.append((len(y), unlabelled.table.count())))
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert seen == [(40, 6_461)]
