"""Operators against small cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import changelog as C
from tessera.operators import code as K
from tessera.operators import events as E
from tessera.operators import files as P
from tessera.operators import graph as G
from tessera.operators import search as S
from tessera.operators import transcripts as R
from tessera.sources import tables as T

EDGE = "id long, identity_name string, workspace string, file_path string, changelog_id long, kind string, detail string, session_id string, ts long"


def edge_rows(spark, rows, who="agent"):
    return spark.createDataFrame([(i, who, ws, f, i, kind, detail, None, ts) for i, (ws, f, kind, detail, ts) in enumerate(rows)], EDGE)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


HAZARDS = [
    ("ws-a", "a.ts", "surfaced", "race-condition", 100),
    ("ws-a", "a.ts", "resolved", "race-condition", 200),
    ("ws-a", "b.ts", "surfaced", "mem-leak", 300),
    ("ws-b", "c.ts", "surfaced", "dead-code", 400),
    ("ws-a", "d.ts", "surfaced", "null-deref", 500),
    ("ws-a", "d.ts", "surfaced", "oom", 600),
]


def test_open_hazards(spark):
    own = lambda rows: {r["detail"] for r in E.open_hazards(edge_rows(spark, rows)).collect()}
    assert own(HAZARDS) == {"mem-leak", "dead-code", "null-deref", "oom"}
    assert "race-condition" in own([*HAZARDS, ("ws-a", "a.ts", "surfaced", "race-condition", 700)])
    assert own([*HAZARDS, ("ws-a", "d.ts", "resolved", "oom", 800)]) == {"mem-leak", "dead-code", "null-deref"}
    assert own([("w", "f", "surfaced", None, 1), ("w", "f", "resolved", None, 2)]) == {None}


def test_filters_and_counts(spark):
    rows = [("ws", f, k, d, ts) for f, k, d, ts in (
        ("a.ts", "commit", None, 100), ("b.ts", "commit", None, 110), ("a.ts", "commit", None, 120), ("a.ts", "commit", None, 130),
        ("c.ts", "surfaced", "bug1", 200), ("d.ts", "surfaced", "bug2", 210), ("c.ts", "resolved", "bug1", 300), ("e.ts", "lookup", None, 400), ("f.ts", "lookup", None, 500),
    )]
    edges = edge_rows(spark, rows)
    counts = E.count_by_kind(edges).first()
    assert [counts[k] for k in ("commit", "surfaced", "resolved", "lookup", "pattern_added")] == [4, 2, 1, 2, 0]
    top = [(r["file_path"], r["edge_count"]) for r in E.top_files(edges, limit=10).orderBy("rank").collect()]
    assert top == [("a.ts", 3), ("c.ts", 2), ("d.ts", 1), ("b.ts", 1)]
    assert [r["ts"] for r in E.filter_events(edges, since=150, until=350).collect()] == [300, 210, 200]


@pytest.mark.parametrize(
    "text, plain",
    [("helloWorld", "hello World"), ("getHTTPResponse", "get HTTP Response"), ("snake_case-var", "snake case var"), ("ABC", "ABC"), ("ABCxyz", "AB Cxyz")],
)
def test_normalize(spark, text, plain):
    assert spark.range(1).select(X.normalize(F.lit(text))).first()[0] == plain


@pytest.mark.parametrize("text, expression", [("hello world", '"hello" OR "world"'), ("a b cd", '"cd"'), ("the an is", "")])
def test_match_expression(spark, text, expression):
    assert spark.range(1).select(X.match_expression(F.lit(text), X.STOPWORDS_TRANSCRIPTS)).first()[0] == expression


def test_fusion(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "silo string, id string, rank int")
    got = {(r["silo"], r["id"]): r["score"] for r in S.fuse_silos(hits).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): round(61 / 62, 6), ("b", "x"): round(61 / 63, 6)}
    assert S.fuse_silos(hits, k=2).count() == 2
    assert S.fuse_silos(hits.limit(0)).count() == 0
    twice = S.fuse([(spark.createDataFrame([("x", 5), ("x", 1)], "id string, rank int"), "one", 1.0)], "id").first()
    assert (twice["score"], twice["one_rank"]) == (round(1 / 61, 9), 1)


def test_scopes():
    assert S.resolve_scope("all", ["atlas_changelog", "transcripts"]) == (["transcripts", "atlas_changelog"], False, False, False)
    every, atlas = ["transcripts", "atlas_files", "atlas_changelog", "source_highlights"], ["atlas_files", "atlas_changelog", "source_highlights"]
    assert {s: S.resolve_scope(s) for s in S.SCOPES} == {
        "self": (["transcripts"], True, False, False), "session": (["transcripts"], False, True, False), "workspace": (every, False, False, True), "identity": (every, True, False, False),
        "atlas": (atlas, False, False, False), "transcripts": (["transcripts"], False, False, False), "all": (every, False, False, False),
    }
    assert S.resolve_scope("self", ["atlas_files"])[0] == [] and S.resolve_scope("self", [])[0] == ["transcripts"]


def test_rows_in_scope(spark):
    rows = spark.createDataFrame([(1, "transcripts", "a", "s", "p", None), (2, "transcripts", "b", "s", None, None), (3, "transcripts", None, "t", "p", "w"), (4, "atlas_files", None, None, None, "w"), (5, "atlas_changelog", "a", "t", "q", "v"), (6, None, "a", "s", "p", "w")], "id int, silo string, identity_name string, session_id string, project string, workspace string")
    here = {"identity": "a", "session": "s", "project": "p", "workspace": "w"}
    got = {s: [r.id for r in rows.where(S.in_scope(s, **here)).orderBy("id").collect()] for s in S.SCOPES}
    assert got == {"self": [1], "session": [1, 2], "workspace": [1, 3, 4], "identity": [1, 4], "atlas": [4], "transcripts": [1, 2, 3], "all": [1, 2, 3, 4]}
    assert [r.id for r in rows.where(S.in_scope("all", silos=["atlas_changelog"])).collect()] == [5]
    assert rows.where(S.in_scope("self", silos=["atlas_files"], **here)).count() == 0 and rows.where(S.in_scope("self")).count() == 3


@pytest.mark.parametrize("loc, tier", [(0.0, "small"), (1.0, "tiny"), (50.0, "tiny"), (51.0, "small"), (200.0, "small"), (201.0, "medium"), (600.0, "medium"), (601.0, "large"), (1500.0, "large"), (1501.0, "huge"), (float("nan"), "small"), (float("inf"), "small"), (-1.0, "small")])
def test_tiers(spark, loc, tier):
    assert spark.createDataFrame([(loc,)], "loc double").select(P.tier(F.col("loc"))).first()[0] == tier


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, usage int")


def test_graph_small(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("a", "b"), ("d", "d")])
    assert values(G.cycles(g), "component", "size", "edges") == [("a", 3, 3)]
    assert values(G.components(g), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e")]
    assert [r["node"] for r in G.shortest_path(g, "a", "d").orderBy("position").collect()] == ["a", "b", "c", "d"]
    assert G.shortest_path(g, "d", "e").count() == 0
    assert values(G.neighbors(g, "c"), "node", "depth") == [("a", 1), ("b", 1), ("d", 1)]


def test_two_cliques_are_two_communities(spark):
    clique = lambda names: [(a, b, 1) for a in names for b in names if a < b]
    g = spark.createDataFrame([*clique(range(1, 6)), *clique(range(11, 16)), (5, 11, 1)], "src long, dst long, usage int")
    assert {frozenset(r["n"]) for r in G.communities(g).groupBy("community").agg(F.collect_list("node").alias("n")).collect()} == {frozenset(range(1, 6)), frozenset(range(11, 16))}


def test_as_of_and_snapshots(spark):
    entries = spark.createDataFrame([(1, "f", 10), (2, "f", 20), (3, "f", 30), (4, "g", 5)], "id long, file_path string, created_at long")
    shots = spark.createDataFrame([("f", 10, 100), ("f", 30, 101)], "file_path string, created_at long, snapshot_id long")
    assert values(C.nearest_snapshots(entries, shots).fillna(-1), "id", "snapshot_id") == [(1, 100), (2, 100), (3, 101), (4, -1)]
    assert values(C.as_of(entries, 25), "id") == [(2,), (4,)]


def test_merge_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x", ""), (2, "y", "p")], "id long, file_path string, purpose string")
    b = spark.createDataFrame([(9, "x", "q"), (3, "z", "r")], "id long, file_path string, purpose string")
    once = P.merge_missing(a, b, ["file_path"])
    assert values(once, "file_path") == [("x",), ("y",), ("z",)] == values(P.merge_missing(once, b, ["file_path"]), "file_path")
    assert values(P.fill_empty(a, b, "file_path", ["purpose"]), "file_path", "purpose") == [("x", "q"), ("y", "p")]


def test_source_analysis(spark):
    files = spark.createDataFrame([("src/a.ts", "import { b } from './b.js';\nexport const x = 1;\nexport default function run() { return b }"), ("src/b.ts", "export class b {}\nexport type T = x"), ("src/c/index.ts", "import '../a'")], "file_path string, content string")
    assert values(P.resolve_imports(P.extract_imports(files), files), "source_file", "target_file") == [("src/a.ts", "src/b.ts"), ("src/c/index.ts", "src/a.ts")]
    exports = P.extract_exports(files)
    assert values(exports, "file_path", "kind", "name") == [("src/a.ts", "const", "x"), ("src/a.ts", "function", "run"), ("src/b.ts", "class", "b"), ("src/b.ts", "type", "T")]
    assert values(P.symbol_usages(files, exports), "symbol", "used_in", "matches") == [("b", "src/a.ts", 3), ("x", "src/b.ts", 1)]


def test_chunking_covers_every_line(spark):
    text = "\n".join(f"line {i}" for i in range(200))
    got = [(r["start_line"], r["end_line"]) for r in P.chunk_lines(spark.createDataFrame([(1, text)], "id long, content string")).orderBy("start_line").collect()]
    assert got[0] == (1, 80) and got[-1][1] == 200
    assert all(b[0] == a[1] - 11 for a, b in zip(got, got[1:], strict=False))


def test_transcript_round_trip(spark, tmp_path):
    lines = [
        '{"type":"user","sessionId":"s","timestamp":"2026-01-01T00:00:00Z","message":{"role":"user","content":"hello"}}',
        "",
        "not json",
        '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use","id":"t1","name":"Read","input":{"file":"a"}}]}}',
        '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":"first"}]}}',
        '{"type":"user","isMeta":true,"message":{"role":"user","content":"meta"}}',
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    events = R.reduce_lines(T.read_jsonl(spark, str(tmp_path))).orderBy("ordinal")
    assert [(r["kind"], r["synthetic"]) for r in events.collect()] == [("user_text", False), ("assistant_text", False), ("tool_use", False), ("tool_result", False), ("user_text", True)]
    pair = R.pair_tools(events).first()
    assert (pair["tool_name"], pair["result"]) == ("Read", "first")


def test_sequences(spark):
    steps = spark.createDataFrame([("s", i, t, a) for i, (t, a) in enumerate([("Read", "x"), ("Bash", "ls"), ("Edit", "x"), ("TodoWrite", ""), ("Bash", "y")])], "session string, n int, tool string, arg string")
    found = R.sequences(steps, "session", ["n"])
    assert sorted(r["length"] for r in found.collect()) == [3, 3, 4]
    assert R.sequences(steps.where("tool = 'Bash'"), "session", ["n"]).count() == 0


def test_discovery_skips_directories(spark, tmp_path):
    for name in ("a.ts", "node_modules/b.ts", "lib/c.py", "lib/d.bin"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    assert {r["file_path"] for r in T.discover_files(spark, f"file:{tmp_path}").select("file_path").collect()} == {"a.ts", "lib/c.py"}


def test_target_files(spark):
    listing = spark.createDataFrame([("a.ts",), ("b.ts",)], "file_path string")
    present, missing = T.target_files(listing, spark.createDataFrame([("a.ts",), ("z.ts",), ("../etc/passwd",), ("/abs",)], "file_path string"))
    assert (values(present, "file_path"), values(missing, "file_path")) == ([("a.ts",)], [("z.ts",)])


def test_diff_counts(spark):
    got = P.unified_diffs(spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "s", "s")], "id long, old string, new string")).orderBy("id").collect()
    assert [(r["insertions"], r["deletions"]) for r in got] == [(2, 1), (0, 0)]


def test_import_clauses_and_gaps(spark):
    text = "import a, { b, c as d } from 'pkg/deep';\nimport * as e from '@s/p/x';\nimport './side';\nb(); e.f();"
    files = spark.createDataFrame([("m.ts", text)], "file_path string, content string")
    got = {(r["module"], r["imported"], r["local"]) for r in K.import_clauses(files).collect()}
    assert got == {("pkg/deep", "default", "a"), ("pkg/deep", "b", "b"), ("pkg/deep", "c", "d"), ("@s/p/x", "*", "e"), ("./side", None, None)}
    assert values(K.unused_imports(files), "local") == [("a",), ("d",)]
    declared = spark.createDataFrame([("pkg",), ("@s/p",), ("unused",)], "name string")
    assert values(K.undeclared(declared, K.import_clauses(files)), "name") == [("unused",)]


def test_python_symbols(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"), ("bad.py", "def ("), ("b.ts", "class X {}")], "file_path string, content string")
    assert values(K.python_symbols(files), "kind", "name", "line_start", "line_end") == [("class", "A", 1, 3), ("function", "g", 5, 6), ("method", "A.f", 2, 3)]
