"""Queries that once ran over some of the ids and users take all of them."""

from __future__ import annotations

from tessera.plans import catalog
from tessera.sources.tables import edges, files


def test_every_file_is_diffed(spark, sf_dir):
    got = {r["id"]: r["diff"] for r in catalog.queries()["df_01_unified_diff"](spark, sf_dir).collect()}
    texts = {r["id"]: r["content"] or "" for r in files(spark, sf_dir).select("id", "content").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        old, new = t.split("\n"), t.replace("the", "THE").split("\n")
        lines = got[i].split("\n") if got[i] else []
        assert [x[1:] for x in lines if x[0] == "-"] == [a for a, b in zip(old, new, strict=True) if a != b]
        assert [x[1:] for x in lines if x[0] == "+"] == [b for a, b in zip(old, new, strict=True) if a != b]


def test_sequences_of_every_user(spark, sf_dir):
    got = {r[0] for r in catalog.queries()["sq_02_tool_sequences"](spark, sf_dir).select("identity_name").distinct().collect()}
    own = {r[0] for r in edges(spark, sf_dir).groupBy("identity_name").count().where("count >= 8").select("identity_name").collect()}
    assert own <= got and len(got) > 3
