"""The pipeline: each stage's decisions take effect, and run() is the stages one after another."""

from __future__ import annotations

import corpus_pipeline

from tessera.llm import jaccard, pii, quality, toxicity
from tessera.llm.common import table


def test_pipeline(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    good = stages["quality"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    assert ids(good) == ids(quality.quality(docs, labels).where("keep"))

    mild = stages["toxicity"](spark, good, sf_dir).cache()
    assert ids(mild) == ids(toxicity.score(good, toxicity.train(good, labels)).where("score < 0.3"))

    single = stages["near duplicates"](spark, mild, sf_dir).cache()
    assert ids(single) == ids(jaccard.jaccard_components(mild).where("doc_id = component_id"))

    clean = stages["personal data"](spark, single, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert clean.where("n_chars <> length(text)").count() == 0
    assert pii.find_pii(clean).where("exists(spans, s -> s.base)").count() == 0

    packed = stages["packing"](spark, clean, sf_dir)
    assert ids(packed) == ids(clean)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(clean)
