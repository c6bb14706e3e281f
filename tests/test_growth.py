"""What made queries grow faster than their input: each test holds a result and the shape of the work that gave it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis as A
from tessera.operators import code as K
from tessera.operators import files as P
from tessera.operators import flow as W
from tessera.operators import graph as G
from tessera.operators import search as S
from tessera.operators import sessions as SE
from tessera.operators import stored_index
from tessera.operators import structure as ST
from tessera.operators.structure import parse
from tessera.plans import catalog
from tessera.sources.shared import slices
from tessera.streaming import freshness as R
from tessera.streaming import streams as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_joined(df):
    """The most rows that a join of the plan gave, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    waiting, most = [plan], 0
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
            continue
        if "QueryStageExec" in node.getClass().getSimpleName():
            waiting.append(node.plan())
        if "JoinExec" in node.getClass().getSimpleName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return most


CALLS = [(i, f"f{i}", "n") for i in range(300)]
SYMBOLS = [(i, f"f{i * 2}", "n", i == 7) for i in range(300)]
LINKS = [("f1", "f14"), ("f1", "f2"), ("f3", "f9")]


def _tables(spark):
    calls = spark.createDataFrame(CALLS, "id long, file_path string, name string")
    symbols = spark.createDataFrame(SYMBOLS, "id long, file_path string, name string, exported boolean")
    return calls, symbols, spark.createDataFrame(LINKS, "src string, dst string")


def test_calls_do_not_meet_all_symbols_of_their_name(spark):
    found = K.resolve_calls(*_tables(spark))
    got = {r["id"]: (r["symbol_id"], r["confidence"]) for r in found.collect()}
    assert got == {i: (i // 2, 1.0) if i % 2 == 0 else (7, 0.9 if i == 1 else 0.7) for i in range(300)}
    assert rows_joined(found) <= 2 * len(CALLS)


def test_flow_calls_do_not_meet_all_symbols_of_their_name(spark):
    found = A.resolve_flow_calls(*_tables(spark))
    assert {r["id"]: r["target"] for r in found.collect()} == {i: i // 2 if i % 2 == 0 else 1 if i == 1 else 7 for i in range(300)}
    assert rows_joined(found) <= 2 * len(CALLS)


def test_parsed_texts_are_kept_in_columns(spark, sf_dir):
    """Checkpoints hold rows as they are in memory."""
    for name in ("ca_09_resolved", "ca_10_resolved_flow"):
        assert "ExistingRDD" not in plan_of(catalog.queries()[name](spark, sf_dir))


def test_event_edges_are_not_shuffled(spark):
    own = [("e", i % 40) for i in range(80)] + [("other", 1)]
    emitters = spark.createDataFrame(own, "event string, symbol long")
    found = K.event_triggers(emitters, emitters)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == 40 * 39 and set(got) == {("e", a, b) for a in range(40) for b in range(40) if a != b}
    plan = plan_of(found)
    assert plan.index("Join") < plan.index("HashAggregate")  # nothing is made distinct above the join


def test_event_edges_repeat_short_lists(spark, monkeypatch):
    """Edges of one emitter to all listeners, one emitter after the other, took five times the disk."""
    monkeypatch.setattr(K, "EVENT_LIST", 4)
    own = spark.createDataFrame([("e", i) for i in range(64)] + [(None, 1)], "event string, symbol long")
    got = [tuple(r) for r in K.event_triggers(own, own).collect()]
    assert len(got) == 64 * 63 and set(got) == {("e", a, b) for a in range(64) for b in range(64) if a != b}
    assert sum(x[1] != y[1] for x, y in zip(got, got[1:])) > 500


@pytest.mark.parametrize("text", ["one two two three", "", "x " * 3000, None])
def test_hashed_embedding_reads_its_words_once(spark, text):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(text,)], "text string").select(S.hashed_embedding(F.col("text"), 16).alias("v"))
    v = rows.first()["v"]
    assert v == [None] * 16 if text is None else len(v) == 16 and abs(sum(x * x for x in v) - (1.0 if text else 0.0)) < 1e-9
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1


def test_components_of_long_chains(spark):
    """A path in an order that has nothing to do with its names; what is given must not carry the rounds before, which took the driver's memory."""
    nodes = [f"{i * 7919 % 500:04d}" for i in range(500)]
    edges = [*zip(nodes, nodes[1:]), ("alone", "alone"), ("x", "y")]
    found = G.components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["node"]: r["component"] for r in found.collect()} == {n: "0000" for n in nodes} | {"alone": "alone", "x": "x", "y": "x"}
    assert len(found._jdf.queryExecution().analyzed().constraints().mkString(",")) < 1000


def test_python_calls_do_not_split_the_text_anew(monkeypatch):
    import ast

    text = "class A(b.C):\n    def m(self):\n" + "".join(f"        é{i}.f(1); self.g(\n{i})[0].h()\n" for i in range(200))
    asked = []
    monkeypatch.setattr(ast, "get_source_segment", lambda *a, **k: asked.append(1))
    edges = parse("a.py", text).edges
    assert not asked and ("EXTENDS", "A", "b.C", 1) in edges
    calls = [(target, line) for kind, _, target, line in edges if kind == "CALLS"]
    assert len(calls) == 600 and {("é7.f", 17), ("g", 17), ("self.g(\n7)[0].h", 17)} <= set(calls)


def test_sequences_are_dealt_out_once(spark, sf_dir):
    queries = catalog.queries()
    for name, most in {"sq_03_skip_hashes": 2, "sq_04_candidates": 2}.items():
        df = queries[name](spark, sf_dir)
        plan = plan_of(df)
        assert plan.count("Exchange") == most and "sha2" not in plan[plan.rindex("Exchange hashpartitioning(signature") :]
    pairs = queries["sq_03_skip_hashes"](spark, sf_dir)
    assert pairs.count() == pairs.distinct().count() > 0


def test_witnesses_share_the_state_of_a_bucket(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"u{i % 3}", None if i % 7 == 0 else f"f{i % 50}", None if i % 4 == 0 else f"k{i}", None if i % 11 == 0 else 2**60 + i) for i in range(400)]
    for n in range(3):
        own = [r for r in rows if r[0] % 3 == n]
        spark.createDataFrame(own, "id long, identity_name string, file_path string, kind string, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.open_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    found = T.witnesses(stream, buckets=2)
    assert "bucket" in found._jdf.queryExecution().analyzed().toString()
    got = {(r.identity_name, r.file_path): (r.total, r.confidence, r.evidence) for r in T.collected(found, "update", spark, str(tmp_path), keys=["identity_name", "file_path"]).collect()}
    want = {}
    for i, who, file, kind, ts in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[0]), reverse=True):
        want.setdefault((who, file), []).append(kind)
    assert got == {k: (len(v), min(100, 10 * len(v)), ",".join(x for x in v[:8] if x is not None)) for k, v in want.items()}


SCRIPT = "export function f(a) {\n  /* ( */ const u = g(a); bus.on('x', h); [a].map(b => lost(b));\n  return k(u) / 2; }\nconst r = /[(/]+/g, s = 4 / 2 / 1;\nclass C { m(p) { return g(p); } }\n"


def test_scripts_are_parsed_once_for_flow_and_symbols(spark):
    rows = [(f"src/f{i}.ts", SCRIPT.replace("f(", f"f{i}(")) for i in range(30)] + [("a.py", "def f():\n    g()\n"), ("b.ts", None), ("c.txt", "x")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    both = W.flow_and_symbols(files)
    assert sorted(W.flow_of(both).collect()) == sorted(W.flow(files).collect())
    assert sorted(ST.symbols_of(both).collect()) == sorted(ST.symbols_of(ST.structure(files)).collect())
    assert {r["name"] for r in ST.symbols_of(both).where("file_path = 'src/f7.ts'").collect()} == {"f7", "r", "s", "C", "C.m"}


def test_tokens_are_not_matched_one_by_one(monkeypatch):
    want = [(t, k, n) for t in (ST.Tokens(SCRIPT, "script"),) for t, k, n in zip(t.text, t.kind, t.line)]
    assert ("/[(/]+/g", "text", 4) in want and ("/", "mark", 4) in want and ("=>", "mark", 2) in want and ("'x'", "text", 2) in want
    plain = "a\xa0b = c(\n'd', \"e\n`f\n` 7x é ' @"

    class Never:
        def match(self, *_):
            raise AssertionError

        finditer = match

    monkeypatch.setattr(ST, "TOKEN", Never())
    t = ST.Tokens(plain, "script")
    assert list(zip(t.text, t.kind, t.line)) == [
        ("a\xa0b", "name", 1), ("=", "mark", 1), ("c", "name", 1), ("(", "mark", 1), ("'d'", "text", 2), (",", "mark", 2), ('"e', "text", 2), ("`f\n`", "text", 3), ("7x", "number", 4), ("é", "name", 4), ("'", "mark", 4), ("@", "mark", 4),
    ]


def test_diffs_are_made_in_slices(spark, monkeypatch):
    """Long texts of one batch aren't all split into lines, nor their diffs all held, at a time."""
    text = "\n".join(f"line {i} the" for i in range(30_000))
    rows = [(i, text, text.replace("the", "THE")) for i in range(6)] + [(6, None, "a"), (7, "s", "s"), (8, None, None)]
    found = P.unified_diffs(spark.createDataFrame(rows, "id long, old string, new string").coalesce(1))
    got = {r["id"]: (r["insertions"], r["deletions"]) for r in found.collect()}
    assert got == {**{i: (30_000, 30_000) for i in range(6)}, 6: (1, 1), 7: (0, 0), 8: (0, 0)}
    sizes = found.select("id").mapInArrow(lambda batches: (b.append_column("n", pa.array([len(b)] * len(b))) for b in batches), "id long, n long")
    assert plan_of(sizes).count("MapInArrow") == 2
    assert list(slices([pa.array(["x" * 10] * 7), pa.array([None] * 6 + ["y" * 5000], pa.string())], 200)) == [(0, 2), (2, 4), (4, 6), (6, 7)]


def test_snapshots_are_unpacked_in_slices():
    """What is made of a batch's texts isn't held for all of them at once; nulls, empty and plain texts stay."""
    texts = pa.array(["é" * 400_000, "", None, "plain"] * 5)
    packed = A.packed.func(texts)
    assert A.unpacked.func(packed).equals(texts) and A.unpacked.func(texts).equals(texts) and A.packed.func(texts[:0]).equals(texts[:0])
    parts = []
    A._each(texts, lambda t: parts.append(len(t)) or t)
    assert len(list(slices([texts]))) >= 5 and len(parts) == 15


def test_candidates_split_a_text_once(spark):
    """The text was split into lines anew for each of its lines."""
    text = "\n".join("const x = 1" for _ in range(20_000)) + "\nexport const K = 1\r\n export async function go() {}"
    rows = [("src/a.ts", text), ("src/b.ts", "x\ny"), ("src/c.ts", ""), ("src/d.ts", None)]
    files = spark.createDataFrame(rows, "file_path string, content string").selectExpr("*", "'c/d' as cluster", "'typescript' as language")
    found = SE.commit_candidates(files)
    assert {r["file_path"]: r["highlights"] and [tuple(h) for h in r["highlights"]] for r in found.collect()} == {
        "src/a.ts": [("Export K", 20_001, 20_002), ("Export go", 20_002, 20_002)], "src/b.ts": [("File opening", 1, 2)], "src/c.ts": None, "src/d.ts": None,
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(content") == 1


def test_changes_wait_in_blocks():
    """Each change was a value of the state of its own."""
    log = [(5, "b"), (5, "a"), (1, "é"), (1, "z"), (3, "b"), (5, "a")]
    blocks = [R._block(np.array([t for t, _ in part]), pa.array([p for _, p in part])) for part in (log[:4], log[4:])]
    ms, number, names = R._in_order(blocks)
    assert [(t, names[n]) for t, n in zip(ms.tolist(), number.tolist())] == sorted(log)
    assert [len(x) for x in R._in_order([])] == [0, 0, 0]


def test_words_are_counted_in_their_document(spark):
    """Words were shuffled to be counted, and counts again to be made blocks."""
    rows = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, ["x"] * 5000 + ["y"])]
    found = spark.createDataFrame(rows, "id long, words array<string>").select("id", stored_index.term_counts(F.col("words")).alias("c"))
    assert {r["id"]: [tuple(c) for c in r["c"]] for r in found.collect()} == {1: [("a", 1), ("b", 3), ("é", 1)], 2: [], 3: [("x", 5000), ("y", 1)]}
    assert "Exchange" not in plan_of(found)


def rows_generated(df):
    """The rows that the plan's generators gave, once it has run."""
    df.collect()
    waiting, rows = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
            continue
        if "QueryStageExec" in node.getClass().getSimpleName():
            waiting.append(node.plan())
        if node.getClass().getSimpleName() == "GenerateExec":
            rows += node.metrics().apply("numOutputRows").value()
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return rows


@pytest.mark.parametrize("broadcast", [0, 100])
def test_words_that_are_too_short_or_long_for_a_name_stay_in_their_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(P, "BROADCAST_NAMES", broadcast)
    texts = [(f"f{i}", "if a b cc " * 50 + "longestNameOfAll " + ("handler run_all " if i % 2 else "handlers ")) for i in range(20)]
    files = spark.createDataFrame(texts, "file_path string, content string")
    symbols = spark.createDataFrame([("handler", "f1"), ("handlers", "f1"), (None, "f2")], "name string, file_path string")
    found = P.symbol_usages(files, symbols)
    want = [("handler", "f1", f"f{i}", 1) for i in range(3, 20, 2)] + [("handlers", "f1", f"f{i}", 1) for i in range(0, 20, 2)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert rows_generated(found) == 30
    assert P.symbol_usages(files, symbols.where("name is null")).collect() == []
