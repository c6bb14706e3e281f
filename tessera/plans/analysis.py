"""Queries over source text, references, history and status lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import analysis as A
from tessera.operators.commits import admit
from tessera.plans.registry import query
from tessera.sources.tables import CHANGELOG_SQL, CHUNKS_SQL, FILES_SQL, changelog, chunks, files, read

#: Paths of many kinds, by id.
_MOVED_SQL = "CASE id % 8 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/x/' || id || '.ts' WHEN 2 THEN 'src/a.ts' WHEN 3 THEN 'src/app/api/jobs/' || id || '.ts' WHEN 4 THEN 'src/app/home/x.ts' WHEN 5 THEN 'src/components/audio/' || id || '.ts' WHEN 6 THEN 'src/hooks/u' || (id % 30) || '.ts' ELSE 'src/stores/db/x.ts' END"


def _moved():
    n, i = F.col("id") % 8, F.col("id")
    return (
        F.when(n == 0, F.lit("README.md")).when(n == 1, F.concat(F.lit("docs/x/"), i, F.lit(".ts"))).when(n == 2, "src/a.ts").when(n == 3, F.concat(F.lit("src/app/api/jobs/"), i, F.lit(".ts")))
        .when(n == 4, "src/app/home/x.ts").when(n == 5, F.concat(F.lit("src/components/audio/"), i, F.lit(".ts"))).when(n == 6, F.concat(F.lit("src/hooks/u"), i % 30, F.lit(".ts"))).otherwise("src/stores/db/x.ts")
    )


@query("SELECT id, CASE id % 8 WHEN 0 THEN 'docs' WHEN 1 THEN 'misc-docs' WHEN 2 THEN 'core' WHEN 3 THEN 'api-jobs' WHEN 4 THEN 'page-home' WHEN 5 THEN 'ui-audio' WHEN 6 THEN 'hooks-u' || (id % 30) || '.ts' ELSE 'store-db' END AS cluster FROM files", FILES_SQL)
def ca_04_clusters(spark, sf_dir):
    return files(spark, sf_dir).select("id", X.cluster_of(_moved()).alias("cluster"))


_LINE_SQL = "CASE id % 6 WHEN 0 THEN 'import { n' || s || ' } from ''./a''' WHEN 1 THEN 'export { n' || s || ', x }' WHEN 2 THEN 'new n' || s || '()' WHEN 3 THEN 'n' || s || ' (1)' WHEN 4 THEN 'let a: n' || s ELSE 'n' || s || ' + 1' END"


@query("SELECT id, CASE id % 6 WHEN 0 THEN 'import' WHEN 1 THEN 're-export' WHEN 2 THEN 'call' WHEN 3 THEN 'call' WHEN 4 THEN 'type-reference' ELSE 'reference' END AS usage FROM files", FILES_SQL)
def ca_07_usage_types(spark, sf_dir):
    n, s = F.col("id") % 6, F.concat(F.lit("n"), F.col("id") % 40)
    line = (
        F.when(n == 0, F.concat(F.lit("import { "), s, F.lit(" } from './a'"))).when(n == 1, F.concat(F.lit("export { "), s, F.lit(", x }"))).when(n == 2, F.concat(F.lit("new "), s, F.lit("()")))
        .when(n == 3, F.concat(s, F.lit(" (1)"))).when(n == 4, F.concat(F.lit("let a: "), s)).otherwise(F.concat(s, F.lit(" + 1")))
    )
    return files(spark, sf_dir).select("id", A.usage_type(s, line).alias("usage"))


@query("SELECT file_path, 'n' || id AS name, 'function' AS type FROM files WHERE id % 2 = 0 UNION ALL SELECT file_path, 'default', 'default' FROM files WHERE id % 3 = 0 UNION ALL SELECT file_path, 'K' || id, 'enum' FROM files", FILES_SQL)
def ca_02_exports(spark, sf_dir):
    i = F.col("id")
    source = F.concat(F.col("content"), F.when(i % 2 == 0, F.concat(F.lit("\nexport async function n"), i, F.lit("() {}\n"))).otherwise(""), F.when(i % 3 == 0, "\nexport default x\n").otherwise(""), F.lit("\nexport enum K"), i)
    return A.exports(files(spark, sf_dir).withColumn("content", source))


_REFS = """exported AS (SELECT file_path, 'n' || (id % 7) AS name, id FROM files),
  sites AS (SELECT e.file_path, e.name, CASE WHEN e.id % 3 <> 0 THEN 'src/' || s.source || CASE WHEN s.doc_id % 9 = 0 THEN '/test' ELSE '' END || '/f' || s.doc_id || '.ts' END AS site, CASE WHEN e.id % 3 <> 0 THEN 1 + e.id % 2 END AS n
    FROM exported e JOIN documents s ON s.doc_id = (e.id * 5 + 1) % 150 WHERE e.id % 4 <> 0),
  live AS (SELECT file_path FROM files WHERE id % 5 <> 0)"""


def _refs(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "file_path")
    exported = own.select("file_path", F.concat(F.lit("n"), F.col("id") % 7).alias("name"), "id")
    place = own.select(F.col("id").alias("at"), F.col("file_path").alias("place"))
    sites = exported.where("id % 4 <> 0").withColumn("at", (F.col("id") * 5 + 1) % 150).join(place, "at")
    used = F.col("id") % 3 != 0
    sites = sites.select("file_path", "name", F.when(used, F.col("place")).alias("site"), F.when(used, 1 + F.col("id") % 2).alias("count"))
    return exported, sites, own.where("id % 5 <> 0").select("file_path")


@query(
    """SELECT e.file_path, e.name, CASE WHEN x.places IS NULL THEN 'symbol missing from cross_refs' WHEN x.places > 0 THEN 'consumers exist only in unreachable files' ELSE 'no cross_ref consumers' END AS reason
    FROM exported e JOIN live USING (file_path) LEFT JOIN (SELECT s.file_path, s.name, count(site) AS places, sum(CASE WHEN l.file_path IS NOT NULL THEN n ELSE 0 END) AS uses FROM sites s LEFT JOIN live l ON l.file_path = s.site GROUP BY 1, 2) x
      ON x.file_path = e.file_path AND x.name = e.name WHERE coalesce(x.uses, 0) = 0""",
    FILES_SQL, _REFS,
)
def gr_09_dead_exports(spark, sf_dir):
    return A.dead_exports(*_refs(spark, sf_dir))


@query(
    """SELECT 'exported_not_referenced' AS kind, file_path, name FROM exported e WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.file_path = e.file_path AND s.name = e.name AND s.site <> e.file_path)
    UNION ALL SELECT DISTINCT 'imported_not_used', site, name FROM (SELECT site, name, max(n) OVER (PARTITION BY site, name) AS most FROM sites WHERE site IS NOT NULL) WHERE most <= 1""",
    FILES_SQL, _REFS,
)
def ca_12_gaps(spark, sf_dir):
    exported, sites, _ = _refs(spark, sf_dir)
    used = sites.where("site is not null")
    imported = used.select(F.col("site").alias("file_path"), "name", F.col("file_path").alias("source"))
    words = used.groupBy(F.col("site").alias("file_path"), "name").agg(F.max("count").alias("count"))
    return A.gaps(exported, imported, words)


@query(
    """SELECT id, target, 0.8 AS confidence FROM (SELECT c.id, s.id AS target, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN c.file_path = s.file_path THEN 0 WHEN l.src IS NOT NULL THEN 1 WHEN s.id % 3 = 0 THEN 2 ELSE 3 END, s.id) AS n
      FROM (SELECT id, file_path, 'n' || ((id * 3) % 45) AS name FROM files) c JOIN (SELECT id, file_path, 'n' || (id % 40) AS name FROM files) s USING (name)
      LEFT JOIN (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM files a JOIN files b ON b.id = (a.id * 7 + 3) % 50) l ON l.src = c.file_path AND l.dst = s.file_path) WHERE n = 1""",
    FILES_SQL,
)
def jn_18_resolve_flow_calls(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "file_path")
    calls = own.withColumn("name", F.concat(F.lit("n"), (F.col("id") * 3) % 45))
    symbols = own.withColumns({"name": F.concat(F.lit("n"), F.col("id") % 40), "exported": F.col("id") % 3 == 0})
    links = own.select(F.col("file_path").alias("src"), ((F.col("id") * 7 + 3) % 50).alias("to")).join(own.select(F.col("id").alias("to"), F.col("file_path").alias("dst")), "to").select("src", "dst")
    return A.resolve_flow_calls(calls, symbols, links).select("id", "target", F.col("confidence").cast("decimal(2,1)").alias("confidence"))


@query(
    f"""SELECT community, 'dir/' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY size DESC, community) AS n FROM (
      SELECT community, regexp_replace(regexp_replace(lower(dir), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, size FROM (
        SELECT *, sum(n) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY n DESC, dir) AS place FROM (
          SELECT id % 37 AS community, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE 'root' END AS dir, count(*) AS n FROM (SELECT id, {_MOVED_SQL} AS p FROM files) GROUP BY 1, 2)) WHERE place = 1))""",
    FILES_SQL,
)
def gr_16_cluster_names(spark, sf_dir):
    return A.named_clusters(files(spark, sf_dir).select((F.col("id") % 37).alias("community"), _moved().alias("file_path")))


_ASKED = """asked AS (SELECT file_path || ':' || e AS request, file_path, e AS endpoint FROM (SELECT DISTINCT file_path, max(id) OVER (PARTITION BY file_path) AS last FROM changelog), LATERAL (SELECT unnest(['latest', 'prev', CAST(last AS VARCHAR), '1996-01-01']) AS e)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id DESC) AS back FROM changelog),
  chosen AS (SELECT request, a.file_path, max(struct_pack(at := created_at, id := id)) AS c FROM asked a JOIN ordered o USING (file_path)
    WHERE CASE endpoint WHEN 'latest' THEN back = 1 WHEN 'prev' THEN back = 2 ELSE CASE WHEN try_cast(endpoint AS BIGINT) IS NOT NULL THEN o.id = try_cast(endpoint AS BIGINT) ELSE created_at <= try_cast(endpoint AS TIMESTAMP) END END GROUP BY 1, 2),
  held AS (SELECT request, max(struct_pack(exact := s.id = c.id, at := created_at, id := s.id)) AS s FROM chosen JOIN (SELECT * FROM changelog WHERE id % 3 <> 0) s USING (file_path) WHERE created_at <= c.at GROUP BY 1)"""


@query("SELECT request, c.id AS changelog_id, s.id AS snapshot_id, CASE WHEN s.exact THEN 'exact_snapshot' WHEN s.id IS NOT NULL THEN 'nearest_snapshot' END AS source FROM chosen LEFT JOIN held USING (request)", CHANGELOG_SQL, _ASKED)
def df_04_endpoints(spark, sf_dir):
    entries = changelog(spark, sf_dir).select("file_path", "id", F.col("created_at").alias("at"))
    last = entries.groupBy("file_path").agg(F.max("id").cast("string").alias("last"))
    asked = last.select("file_path", F.explode(F.array(F.lit("latest"), F.lit("prev"), "last", F.lit("1996-01-01"))).alias("endpoint")).withColumn("request", F.concat_ws(":", "file_path", "endpoint"))
    return A.resolve_endpoints(asked, entries, entries.where("id % 3 <> 0"))


@query("SELECT file_path, id, content FROM files WHERE id % 3 > 0", FILES_SQL)
def src_11_snapshots(spark, sf_dir):
    """Packed and raw snapshots of two times; the newest of each file is read back as its text."""
    own = files(spark, sf_dir).where("id % 3 > 0")
    old = own.select("file_path", "id", F.lit("older").alias("content"), F.lit(1).alias("at"))
    new = own.select("file_path", "id", F.when(F.col("id") % 3 == 1, A.packed(F.col("content"))).otherwise(F.col("content")).alias("content"), F.lit(2).alias("at"))
    return A.latest_snapshot(old.unionByName(new))


_STATUS = ["M ", " M", "MM", "??", "R ", "UU", "AA", "A "]


@query(
    """SELECT repo, state, path FROM (SELECT 'r' || (id % 3) AS repo, file_path AS path, unnest(CASE id % 8 WHEN 0 THEN ['staged'] WHEN 1 THEN ['unstaged'] WHEN 2 THEN ['staged', 'unstaged'] WHEN 3 THEN ['untracked']
      WHEN 4 THEN ['renamed', 'staged'] WHEN 7 THEN ['staged'] ELSE ['conflicted'] END) AS state FROM files)""",
    FILES_SQL,
)
def src_14_status(spark, sf_dir):
    lines = files(spark, sf_dir).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo"), F.concat(F.lit([*_STATUS])[(F.col("id") % 8).cast("int")], F.lit(" "), "file_path").alias("line"))
    return A.status_lines(lines)


@query("SELECT DISTINCT 'r' || id % 3 AS repo, 'main' AS branch, CAST(id % 3 AS INTEGER) AS ahead, CAST(CASE WHEN id % 3 = 2 THEN 7 ELSE 0 END AS INTEGER) AS behind FROM files", FILES_SQL)
def src_14_status_branch(spark, sf_dir):
    n = F.col("id") % 3
    lines = files(spark, sf_dir).select(F.concat(F.lit("r"), n).alias("repo"), F.when(n == 0, "## main...origin/main").when(n == 1, "## main...origin/main [ahead 1]").otherwise("## main...origin/main [ahead 2, behind 7]").alias("line")).distinct()
    return A.status_branch(lines)


@query("SELECT slug, max_by(conv_id, (last, conv_id)) AS newest, count(*) AS transcripts FROM (SELECT conv_id, '-home-w' || (conv_id % 5) AS slug, max(turn) AS last FROM conversations GROUP BY 1) GROUP BY 1")
def src_05_transcripts(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("at"))
    listed = own.withColumn("slug", X.folder_slug(F.concat(F.lit("/home/w"), F.col("conv_id") % 5)))
    return listed.groupBy("slug").agg(F.max_by("conv_id", F.struct("at", "conv_id")).alias("newest"), F.count("*").alias("transcripts"))


def _calls(spark, sf_dir):
    n = F.col("turn_index") % 5
    name = F.when(n == 0, "Grep").when(n == 1, "Glob").when(n == 2, "Bash").when(n == 3, "Read").otherwise("Other")
    return chunks(spark, sf_dir).select("session_id", F.col("turn_index").alias("ordinal"), name.alias("name"), F.substring("text", 1, 200).alias("arg"))


_CALLS = "calls AS (SELECT session_id, turn_index AS ordinal, CASE turn_index % 5 WHEN 0 THEN 'Grep' WHEN 1 THEN 'Glob' WHEN 2 THEN 'Bash' WHEN 3 THEN 'Read' ELSE 'Other' END AS name, substr(text, 1, 200) AS arg FROM chunks)"


@query("SELECT session_id, ordinal, name, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS back FROM calls WHERE name IN ('Grep', 'Glob')) WHERE back <= 8", CHUNKS_SQL, _CALLS)
def tr_06_search_footprint(spark, sf_dir):
    return A.search_footprint(_calls(spark, sf_dir).drop("arg"))


@query("SELECT session_id, ordinal, substr(CASE name WHEN 'Grep' THEN 'Grep /' || arg || '/ in src' WHEN 'Glob' THEN 'Glob ' || arg WHEN 'Bash' THEN 'Bash: ' || arg WHEN 'Read' THEN 'Read ' || arg ELSE 'Other ' || arg END, 1, 120) AS line FROM calls WHERE arg IS NOT NULL AND arg <> ''", CHUNKS_SQL, _CALLS)
def tr_07_tool_lines(spark, sf_dir):
    arg = lambda *names: F.when(F.col("name").isin(*names), F.col("arg"))
    inputs = {"pattern": arg("Grep", "Glob"), "path": F.when(F.col("name") == "Grep", "src"), "command": arg("Bash"), "file_path": arg("Read"), "what": arg("Other")}
    return _calls(spark, sf_dir).where("arg <> ''").select("session_id", "ordinal", A.tool_line(F.col("name"), inputs).alias("line"))


@query("SELECT session_id, min_by('abcdef' || (10 + turn_index), turn_index) AS predecessor FROM chunks WHERE turn_index < 50 AND turn_index % 3 = 1 GROUP BY 1", CHUNKS_SQL)
def tr_11_predecessors(spark, sf_dir):
    said = F.when(F.col("turn_index") % 3 == 1, F.concat(F.col("text"), F.lit("\n  Session: abcdef"), (10 + F.col("turn_index")).cast("string"), F.lit("\n"))).otherwise(F.col("text"))
    return A.predecessors(chunks(spark, sf_dir).select("session_id", F.col("turn_index").alias("ordinal"), said.alias("text")))


@query("SELECT session_id, max(turn_index) AS ordinal, 't' || max(turn_index) AS first FROM chunks WHERE turn_index % 4 <> 0 GROUP BY 1", CHUNKS_SQL)
def wn_14_latest_list(spark, sf_dir):
    raw = F.when(F.col("turn_index") % 4 == 0, "not json").otherwise(F.concat(F.lit('{"todos":[{"content":"t'), F.col("turn_index"), F.lit('","status":"pending"}]}')))
    found = A.last_snapshot_of_list(chunks(spark, sf_dir).select("session_id", F.col("turn_index").alias("ordinal"), raw.alias("input")), "todos array<struct<content:string,status:string>>")
    return found.select("session_id", "ordinal", F.col("parsed.todos")[0]["content"].alias("first"))


@query("SELECT id, CASE id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'structure' WHEN 3 THEN 'crossref' WHEN 4 THEN 'structure' ELSE 'crossref' END AS phase FROM files", FILES_SQL)
def flt_14_phase(spark, sf_dir):
    n = F.col("id") % 6
    refs = F.when(n == 2, "{}").when(n == 3, '{"symbols":{"a":{"call_sites":[]}},"crossref_timestamp":"t","crossref_model":"llm"}').when(n == 4, '{"symbols":{"a":{}},"pass2_timestamp":"t","crossref_model":"scaffold"}')
    refs = refs.when(n == 5, '{"symbols":{},"total_exports_analyzed":0,"crossref_timestamp":"t","crossref_model":"heuristic"}')
    stored = F.when(n == 1, "old").when(n > 1, "now")
    return files(spark, sf_dir).select("id", A.phase(F.lit("now"), stored, refs).alias("phase"))


@query(
    """SELECT sha1(concat_ws(chr(0), workspace, file_path, summary, file_hash)) AS key, min(id) AS id FROM (SELECT 'w' AS workspace, file_path, summary, 'h' || (id % 4) AS file_hash, id FROM changelog)
    WHERE sha1(concat_ws(chr(0), workspace, file_path, summary, file_hash)) NOT IN (SELECT sha1(concat_ws(chr(0), 'w', file_path, summary, 'h' || (id % 4))) FROM changelog WHERE id % 10 = 0) GROUP BY 1""",
    CHANGELOG_SQL,
)
def snk_28_idempotent_commits(spark, sf_dir):
    own = changelog(spark, sf_dir).select(F.lit("w").alias("workspace"), "file_path", "summary", F.concat(F.lit("h"), F.col("id") % 4).alias("file_hash"), F.col("id").alias("at"), "id")
    new = own.unionByName(own.withColumn("at", F.col("at") + 1_000_000))
    kept = own.where("id % 10 = 0").select(F.sha1(F.concat_ws("\u0000", "workspace", "file_path", "summary", "file_hash")).alias("key"))
    return A.idempotent_commits(new, kept).select("key", "id")


@query("SELECT id, sha1(concat_ws(chr(0), 'ws', file_path, coalesce(cluster, ''), summary)) AS dedupe_key FROM changelog", CHANGELOG_SQL)
def snk_07_memory_keys(spark, sf_dir):
    return changelog(spark, sf_dir).select("id", X.joined_key(F.lit("ws"), F.col("file_path"), F.coalesce("cluster", F.lit("")), F.col("summary")).alias("dedupe_key"))


@query("SELECT doc_id, substr(text, 1, 200) AS star FROM documents")
def snk_22_star(spark, sf_dir):
    """At most 200 characters; Spark counts code points, so none is ever split."""
    return read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("star"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new' FROM embeddings WHERE vec_id % 30 = 0")
def snk_18_vector_upsert(spark, sf_dir):
    own = read(spark, sf_dir, "embeddings").select("vec_id", F.lit("old").alias("version"))
    new = own.where("vec_id % 3 = 0").union(own.where("vec_id % 30 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)).withColumn("version", F.lit("new"))
    return own.join(new, "vec_id", "left_anti").unionByName(new)


_NAMES = ["Work Space/1", "a_b-C", ".", "..", "-x", "ok.name", "a b", "TRUE", " false ", "12", "1.0", "1.5", "x"]


@query(
    """SELECT n, lower(regexp_replace(lower(t), '[^a-z0-9_-]', '-', 'g')) AS workspace, replace(t, '/', '-') AS folder, t IN ('a_b-C', 'ok.name', 'TRUE', '12', '1.0', '1.5', 'x') AS valid,
      CASE lower(trim(t)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CASE WHEN t IN ('12') THEN 12 WHEN t = '1.0' THEN 1 END AS number, CASE WHEN t = ' false ' THEN 'false' ELSE regexp_replace(lower(t), '[\\s-]+', '_', 'g') END AS edge
    FROM (SELECT CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS t FROM (SELECT ["""
    + ", ".join(f"'{n}'" for n in _NAMES)
    + "] AS l))"
)
def sc_09_names_and_coercion(spark, sf_dir):
    t = F.col("t")
    rows = spark.createDataFrame(list(enumerate(_NAMES)), "n int, t string")
    return rows.select("n", X.workspace_slug(t).alias("workspace"), X.folder_slug(t).alias("folder"), X.valid_identity(t).alias("valid"), X.coerced_boolean(t).alias("flag"), X.coerced_integer(t).alias("number"), X.edge_type(t).alias("edge"))


@query(
    r"""SELECT doc_id, CASE WHEN length(p) <= 160 THEN p WHEN s <> '' AND length(s) <= 160 THEN s ELSE substr(p, 1, 160) || '…' END AS sentence, CASE WHEN length(l) <= 100 THEN l ELSE substr(l, 1, 97) || '...' END AS line
    FROM (SELECT *, regexp_extract(p, '^(.+?[.!?])(?:\s|$)', 1) AS s, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1], '') AS l
      FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents))"""
)
def sc_11_previews(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"), X.first_line(F.col("text")).alias("line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def sc_05_json(spark, sf_dir):
    """Parsed with a fallback: rows that don't parse would have -1."""
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(F.to_json(F.from_json("props", "k int")), "k int")["k"], F.lit(-1)).alias("k"))


@query("SELECT file_path, 'n' || id AS name, 'function' AS type FROM files UNION ALL SELECT file_path, 'v' || id, 'value' FROM files UNION ALL SELECT file_path, 'b', 're-export' FROM files UNION ALL SELECT file_path, 'c', 're-export' FROM files", FILES_SQL)
def ca_05_exported_symbols(spark, sf_dir):
    i = F.col("id")
    source = F.concat(F.lit("export function n"), i, F.lit("() {}\nexport let v"), i, F.lit(" = 1\nexport { a as b, c, n"), i, F.lit(", d as default }\n"), "content")
    return A.exported_symbols(files(spark, sf_dir).withColumn("content", source))


@query(
    """SELECT file_path AS source_file, 'old' AS name, 't' AS target_file, 'x' AS edge_type, CAST(1 AS BIGINT) AS usage_count, 0.5 AS confidence, CASE WHEN id % 2 = 0 THEN 'ast' ELSE 'inferred' END AS provenance FROM files WHERE id % 3 <> 0 OR id % 2 = 0
    UNION ALL SELECT file_path, 'a', 'f' || id, CASE id % 4 WHEN 0 THEN 'type_ref' WHEN 1 THEN 'reexport' WHEN 2 THEN 'config_ref' ELSE 'runtime_call' END, greatest(1, id % 5), CASE WHEN id % 6 = 0 THEN 0.8 ELSE 0.6 END, CASE WHEN id % 6 = 0 THEN 'llm' ELSE 'inferred' END FROM files WHERE id % 3 = 0""",
    FILES_SQL,
)
def snk_04_replace_references(spark, sf_dir):
    own, i = files(spark, sf_dir), F.col("id")
    kept = own.select(F.col("file_path").alias("source_file"), F.lit("old").alias("name"), F.lit("t").alias("target_file"), F.lit("x").alias("edge_type"), F.lit(1).cast("long").alias("usage_count"), F.lit(0.5).alias("confidence"), F.when(i % 2 == 0, "ast").otherwise("inferred").alias("provenance"))
    usage = F.when(i % 4 == 0, " Type-reference").when(i % 4 == 1, "re-export").when(i % 4 == 2, "CONFIG").otherwise("call")
    site = lambda file: F.struct(F.lit(" a ").alias("name"), file.alias("file"), (i % 5 + 0.5).alias("count"), usage.alias("usage_type"))
    refs = own.where("id % 3 = 0").select("file_path", F.when(i % 6 == 0, "some-model").otherwise("heuristic").alias("model"), F.array(site(F.concat(F.lit("f"), i)), site(F.lit("  "))).alias("sites"))
    return A.replaced_references(kept, refs).withColumn("confidence", F.col("confidence").cast("decimal(2,1)"))


@query("SELECT file_path, CAST(CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS removed, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '1:x' ELSE '7:x' END AS labels FROM files", FILES_SQL)
def ca_14_healed_highlights(spark, sf_dir):
    n = F.col("id") % 3
    good = '{"id":7,"label":"x","startLine":1,"endLine":2,"content":"c"}'
    raw = F.when(n == 0, "corrupt").when(n == 1, f'[{{"id":1,"label":"e","startLine":1,"endLine":2,"content":" "}},{good},{{"id":3,"label":"z","startLine":0,"endLine":2,"content":"c"}}]').otherwise(f"[{good}]")
    healed = A.healed_highlights(files(spark, sf_dir).withColumn("source_highlights", raw))
    return healed.select("file_path", "removed", F.array_join(F.transform("highlights", lambda h: F.concat(h["id"].cast("int").cast("string"), F.lit(":"), h["label"])), ",").alias("labels"))


def commit_requests(spark, sf_dir):
    """A request of every changelog entry, seven seconds apart, on fifty files; one in nine is never released."""
    i = F.col("id")
    own = changelog(spark, sf_dir).select("id", F.lit("w").alias("workspace"), F.concat(F.lit("f"), F.floor(i / 8) % 50).alias("file_path"), F.col("author_instance_id").alias("holder"), F.concat(F.lit("s"), i % 3).alias("summary"), F.when(i % 4 != 0, "h").alias("file_hash"), (i * 7000).alias("ts"))
    return own.withColumn("released_at", F.when(i % 9 != 0, F.col("ts") + 5000 * (i % 9)))


@query()
def snk_28_admitted_commits(spark, sf_dir):
    return admit(commit_requests(spark, sf_dir))


@query(
    r"""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9_-]', '-', 'g') AS workspace, replace(url, '/', '-') AS folder, name <> '' AND length(name) <= 128 AND name NOT LIKE '-%' AND name NOT IN ('.', '..') AND NOT regexp_matches(name, '[/\\\s]') AS valid,
      CASE WHEN length(url) > 40 THEN true WHEN length(url) > 20 THEN false END AS flag, CASE WHEN regexp_matches(name, '^[0-9]{1,15}(\.0+)?$') THEN CAST(floor(CAST(name AS DOUBLE)) AS BIGINT) END AS number,
      CASE WHEN trim(name) = '' THEN 'unknown' ELSE regexp_replace(lower(trim(name)), '[\s-]+', '_', 'g') END AS edge
    FROM (SELECT *, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS name FROM pages)"""
)
def sc_09_page_names(spark, sf_dir):
    """Slugs of whole URLs; their last names as identities, numbers and kinds of edges."""
    name, size = F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1), F.length("url")
    flag = F.when(size > 40, " TRUE").when(size > 20, "False ").otherwise("neither")
    return read(spark, sf_dir, "pages").select(
        "page_id", X.workspace_slug(F.col("url")).alias("workspace"), X.folder_slug(F.col("url")).alias("folder"), X.valid_identity(name).alias("valid"),
        X.coerced_boolean(flag).alias("flag"), X.coerced_integer(name).alias("number"), X.edge_type(name).alias("edge"),
    )
