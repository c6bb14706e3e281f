"""Fixed values and small operators against literal expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import analysis as A
from tessera.operators import code as K
from tessera.operators import files as P
from tessera.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stopwords():
    assert len(X.STOPWORDS_TRANSCRIPTS) == 90 and {"cant", "whose", "there", "any", "very"} <= X.STOPWORDS_TRANSCRIPTS and not {"if", "then", "else", "his", "its", "their"} & X.STOPWORDS_TRANSCRIPTS
    assert len(X.STOPWORDS_FILES) == 84 and {"also", "just", "only", "out", "need", "shall"} <= X.STOPWORDS_FILES and not {"else", "his", "him", "us"} & X.STOPWORDS_FILES


def test_terms_of_both_lists(spark):
    text = F.lit("Does theirHTTPServer need their useCase if any")
    assert one(spark, X.query_terms(text, X.STOPWORDS_TRANSCRIPTS)) == ["their", "http", "server", "need", "their", "use", "case", "if"]
    assert one(spark, X.query_terms(text, X.STOPWORDS_FILES)) == ["http", "server", "use", "case"]


def test_scanned_files(spark, tmp_path):
    for name in ("src/a.kt", "src/b.vue", "src/c.json", "src/d.sh", "vendor/e.ts", ".atlas/f.ts", "src/tests/g.ts", ".nuxt/h.js", "README.md", "x.svelte"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r["file_path"] for r in T.discover_files(spark, f"file:{tmp_path}").select("file_path").collect()}
    assert found == {"src/a.kt", "src/b.vue", "vendor/e.ts", "README.md", "x.svelte"}
    rows = spark.createDataFrame([(p, "a\r\nb") for p in ("a.TSX", "b.mjs", "c.kt", "d.md", "e.svelte", "f.sql", "g.txt")], "file_path string, content string")
    assert {r["file_path"]: r["language"] for r in K.scan(rows).collect()} == {"a.TSX": "tsx", "b.mjs": "javascript", "c.kt": "kotlin", "d.md": "markdown", "e.svelte": "svelte", "f.sql": "sql", "g.txt": "unknown"}


def test_paths_of_tests(spark):
    paths = ["a/test/x.ts", "test/x.ts", "a/specs/x.ts", "a/__mocks__/x.ts", "x.spec.mjs", "x.TEST.tsx", "vite.config.mts", "a/src/jest.config.js", "e2e/x.ts", "src/a.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    marked = {v: [r["x"] for r in rows.select(P.is_test(F.col("p"), v).alias("x")).collect()] for v in P.TEST_PATHS}
    assert [p for p, x in zip(paths, marked["audit"], strict=True) if x] == ["a/test/x.ts", "a/__mocks__/x.ts", "x.spec.mjs"]
    assert [p for p, x in zip(paths, marked["reachability"], strict=True) if x] == ["a/test/x.ts", "a/specs/x.ts", "a/__mocks__/x.ts", "x.spec.mjs", "vite.config.mts", "a/src/jest.config.js"]
    assert [p for p, x in zip(paths, marked["cycles"], strict=True) if x] == ["a/test/x.ts", "x.spec.mjs", "x.TEST.tsx"]


def test_index_tokens_are_the_tokens_of_the_normalised_text(spark):
    rows = spark.createDataFrame([(t,) for t in ("ABCd useHTTPServerNow x_y-z  A1b2C ABc", "", "éÀb --", "aBCDeF9G")], "t string")
    assert all(r["a"] == r["b"] for r in rows.select(X.index_tokens(F.col("t")).alias("a"), X.tokens(X.normalize(F.col("t"))).alias("b")).collect())


def test_greedy_diff():
    assert P.greedy_diff(["a", "b", "c"], ["a", "x", "c", "d"]) == ("@@ -1,3 +1,4 @@\n a\n-b\n+x\n c\n+d", 2, 1)
    assert P.greedy_diff(["s"], ["s"]) == ("", 0, 0)
    far = ["k"] + [str(i) for i in range(30)]
    assert P.greedy_diff(far[1:], far)[1:] == (1, 0)
    old, new = [str(i) for i in range(40)], [*map(str, range(5)), "x", *map(str, range(6, 30)), "y", *map(str, range(31, 40))]
    hunks = [line for line in P.greedy_diff(old, new)[0].split("\n") if line[0] == "@"]
    assert hunks == ["@@ -3,6 +3,6 @@", "@@ -28,7 +28,7 @@"]


def test_packed_text_comes_back(spark):
    rows = spark.createDataFrame([("é" * 50,), ("",), (None,), ("not packed",)], "t string")
    assert [r["b"] for r in rows.select(A.unpacked(A.packed(F.col("t"))).alias("b")).collect()] == ["é" * 50, "", None, "not packed"]
    assert one(spark, A.unpacked(F.lit("raw text"))) == "raw text"


def test_usage_types(spark):
    said = {"import { Foo } from './x'": "import", "export { Bar, Foo as F }": "re-export", "const a = new Foo": "call", "Foo (1)": "call", "x: Foo": "type-reference", "typeof Foo": "type-reference", "a = Foo;": "reference"}
    rows = spark.createDataFrame(list(said.items()), "line string, want string")
    assert rows.where(A.usage_type(F.lit("Foo"), F.col("line")) != F.col("want")).count() == 0
