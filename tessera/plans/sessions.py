"""Queries over session logs and histories, profile writes, appended entries, cross-references and short forms of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import code as C
from tessera.operators import sessions as S
from tessera.plans.registry import query
from tessera.sources.tables import CHANGELOG_SQL, CHUNKS_SQL, EDGES_SQL, FILES_SQL, changelog, chunks, edges, files, read


def log_events(own):
    """Chunks as events of several kinds."""
    turn = F.col("turn_index")
    kind = F.when(turn % 7 == 6, "error").when(turn % 5 == 3, "tool_use").when(turn % 5 == 4, "assistant_thinking").when(F.col("role") == "user", "user_text").otherwise("assistant_text")
    return own.select("session_id", turn.alias("ordinal"), "ts", kind.alias("kind"), F.concat(F.lit("T"), turn % 3).alias("name"), "text")


@query()
def tr_08_activity_log(spark, sf_dir):
    """Held against a plain version in the tests: the lines are rendered text."""
    return S.activity_log(log_events(chunks(spark, sf_dir)), hot=2, warm=2, size=3)


@query(
    """SELECT identity_name AS project, CAST(number AS INTEGER) AS number, session_id, gap, linked FROM (
      SELECT *, row_number() OVER (PARTITION BY identity_name ORDER BY number DESC) AS back FROM (
        SELECT *, bool_or(member) OVER (PARTITION BY identity_name) AS linked FROM (
          SELECT e.identity_name, e.session_id, row_number() OVER w AS number, e.ts - lag(e.ts) OVER w AS gap, c.session_id IS NOT NULL AS member
          FROM edges e LEFT JOIN (SELECT * FROM chain WHERE identity_name IN (SELECT identity_name FROM chain GROUP BY 1 HAVING count(*) >= 2)) c
            ON c.identity_name = e.identity_name AND c.session_id = e.session_id WINDOW w AS (PARTITION BY e.identity_name ORDER BY e.ts, e.id)))
      WHERE member OR NOT linked) WHERE back <= CASE WHEN linked THEN 12 ELSE 6 END""",
    EDGES_SQL,
    "chain AS (SELECT DISTINCT identity_name, session_id FROM edges WHERE id % 40 = 0)",
)
def tr_15_history(spark, sf_dir):
    log = edges(spark, sf_dir).select(F.col("identity_name").alias("project"), "id", F.col("ts").alias("t"), "session_id")
    return S.history_shown(log, log.where("id % 40 = 0"))


@query(
    """SELECT (SELECT count(DISTINCT session_id) FROM chunks) + 1 AS files_scanned, count(DISTINCT session_id) AS files_changed,
      count(*) FILTER (turn_index % 3 = 0 OR turn_index % 4 = 1) AS chunks_upserted FROM chunks""",
    CHUNKS_SQL,
)
def tr_03_index_counts(spark, sf_dir):
    own = chunks(spark, sf_dir).withColumn("text_hash", X.short_hash(F.col("text")))
    stored = own.where("turn_index % 3 <> 0").withColumn("text_hash", F.when(F.col("turn_index") % 4 == 1, "old").otherwise(F.col("text_hash")))
    empty = own.agg((F.max("session_id") + 1).alias("session_id"))
    return S.index_counts(own.select("session_id").union(empty), own, stored)


@query()
def df_06_worktree_diffs(spark, sf_dir):
    """The first 20 files by path are the feature; the diffs are held against literals in the tests."""
    i = F.col("id")
    state = F.when(i % 5 == 0, "modified").when(i % 7 == 0, "deleted").otherwise("clean")
    own = files(spark, sf_dir).select("id", "file_path", state.alias("state"), F.when(i % 11 != 0, F.col("content")).alias("old"), F.concat(F.lit("// new\n"), "content").alias("new"))
    return S.worktree_diffs(own)


@query(
    """SELECT name, coalesce(max_by(value, (ts, value)) FILTER (op = 'blurb'), max(old_blurb), '') AS blurb, coalesce(max_by(value, (ts, value)) FILTER (op = 'tags'), max(old_tags), '') AS tags,
      coalesce(max(old_created), min(born)) AS created_at, coalesce(max(ts) FILTER (op IN ('blurb', 'tags')), max(old_created), min(born)) AS updated_at, max(ts) FILTER (op = 'retire') AS retired_at,
      max(old_created) IS NULL OR count(*) FILTER (op = 'blurb') > 0 AS dirty
    FROM (SELECT coalesce(s.name, w.name) AS name, w.op, w.value, w.ts, s.blurb AS old_blurb, s.tags AS old_tags, s.created_at AS old_created, coalesce(s.created_at, w.first) AS born
      FROM (SELECT *, min(ts) FILTER (op = 'create') OVER (PARTITION BY name) AS first FROM writes) w FULL JOIN stored s ON s.name = w.name)
    WHERE op IS NULL OR ts >= born OR old_created IS NOT NULL GROUP BY name""",
    EDGES_SQL,
    "writes AS (SELECT identity_name AS name, CASE id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'blurb' WHEN 2 THEN 'tags' WHEN 3 THEN 'retire' ELSE 'blurb' END AS op, 'v' || (id % 100) AS value, ts FROM edges)",
    "stored AS (SELECT DISTINCT identity_name AS name, 'b' AS blurb, 't' AS tags, CAST(0 AS BIGINT) AS created_at FROM edges WHERE identity_name LIKE '%1')",
)
def snk_20_profile_writes(spark, sf_dir):
    own, n = edges(spark, sf_dir), F.col("id") % 5
    op = F.when(n == 0, "create").when(n == 2, "tags").when(n == 3, "retire").otherwise("blurb")
    writes = own.select(F.col("identity_name").alias("name"), op.alias("op"), F.concat(F.lit("v"), F.col("id") % 100).alias("value"), "ts")
    zero = F.lit(0).cast("long")
    stored = writes.where("name like '%1'").select("name", F.lit("b").alias("blurb"), F.lit("t").alias("tags"), zero.alias("created_at"), zero.alias("updated_at"), F.lit(None).cast("long").alias("retired_at")).distinct()
    return S.profile_writes(stored, writes)


@query(
    """SELECT id, coalesce(cluster, 'agent') AS source, CASE WHEN id % 3 = 0 THEN 'ok' ELSE 'pending' END AS status, CAST(0 AS INTEGER) AS patterns FROM (
      SELECT *, row_number() OVER (PARTITION BY coalesce(rk, 'n' || id) ORDER BY id) AS a, row_number() OVER (PARTITION BY ik ORDER BY id) AS b FROM (SELECT *, CASE WHEN id % 2 = 0 THEN summary || created_at END AS rk, file_path || cluster AS x, 'k' || (id // 3) AS ik FROM changelog))
    WHERE a = 1 AND b = 1 AND (rk IS NULL OR rk NOT IN (SELECT summary || created_at FROM changelog WHERE id % 10 = 0)) AND ik NOT IN (SELECT 'k' || (id // 3) FROM changelog WHERE id % 10 = 0)""",
    CHANGELOG_SQL,
)
def snk_06_append_entries(spark, sf_dir):
    own, i = changelog(spark, sf_dir), F.col("id")
    day = F.concat("summary", F.col("created_at").cast("string"))
    third = F.concat(F.lit("k"), F.floor(i / 3))
    empty = F.lit(None).cast("array<string>")
    new = own.select(
        "id", F.col("cluster").alias("source"), F.when(i % 3 == 0, "ok").alias("verification_status"), empty.alias("patterns_added"), empty.alias("hazards_added"), "breaking_changes",
        F.when(i % 2 == 0, day).alias("recovery_key"), third.alias("idempotency_key"),
    )
    stored = own.where("id % 10 = 0").select(day.alias("recovery_key"), third.alias("idempotency_key"))
    return S.append_entries(stored, new).select("id", "source", F.col("verification_status").alias("status"), F.size("patterns_added").alias("patterns"))


@query(
    """SELECT symbol, CASE WHEN k.n IS NOT NULL THEN 'edges' WHEN f.n IS NOT NULL THEN 'matches' ELSE 'none' END AS source, coalesce(k.sites, f.sites, 0) AS sites,
      coalesce(k.consumers, f.consumers, 0) AS consumers, CAST(coalesce(k.n, f.n, 0) AS BIGINT) AS total_usages
    FROM (SELECT DISTINCT 'p' || (l_partkey % 300) AS symbol FROM lineitem)
    LEFT JOIN (SELECT symbol, count(*) AS sites, count(DISTINCT file) AS consumers, sum(n) AS n FROM (SELECT 'p' || (l_partkey % 300) AS symbol, 's' || l_suppkey AS file, l_returnflag AS usage, sum(greatest(1, floor(CAST(l_quantity AS DOUBLE) / 10))) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY ALL) GROUP BY symbol) k USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS sites, count(DISTINCT file) AS consumers, sum(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, file) AS place FROM (SELECT 'p' || (l_partkey % 300) AS symbol, 'o' || l_orderkey AS file, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL)) WHERE place <= 10 GROUP BY symbol) f USING (symbol)"""
)
def ca_08_cross_references(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").withColumn("symbol", F.concat(F.lit("p"), F.col("l_partkey") % 300))
    known = line.where("l_partkey % 3 = 0").select("symbol", F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_returnflag").alias("usage"), (F.col("l_quantity").cast("double") / 10).alias("n"))
    hits = line.where("l_partkey % 5 <> 0").groupBy("symbol", F.concat(F.lit("o"), "l_orderkey").alias("file")).agg(F.count("*").alias("n"))
    return S.cross_references(line, known, hits)


@query(
    """SELECT file_path, array_to_string(list_filter(string_split(replace(replace(file_path, '.ts', ''), '_', '/'), '/'), lambda w: w <> ''), ' ') AS subject,
      'src' || CASE WHEN cluster IS NOT NULL THEN ',' || cluster ELSE '' END || ',' || language AS tags,
      CASE WHEN id % 2 = 0 THEN 'Export n' || id || ':2:' || least(n + 2, 22) || ',Export K:3:' || least(n + 2, 23) ELSE 'File opening:1:' || least(n, 20) END AS highlights
    FROM (SELECT *, len(string_split_regex(content, '\\r?\\n')) AS n FROM files WHERE content <> '')""",
    FILES_SQL,
)
def ca_15_commit_candidates(spark, sf_dir):
    i = F.col("id")
    source = F.when(i % 2 == 0, F.concat(F.lit("// a\nexport async function n"), i, F.lit("() {}\n export const K = "), "content")).otherwise(F.col("content"))
    found = S.commit_candidates(files(spark, sf_dir).where("content <> ''").withColumn("content", source))
    shown = F.transform("highlights", lambda h: F.concat_ws(":", h["label"], h["first"].cast("string"), h["last"].cast("string")))
    return found.select("file_path", "subject", F.array_join("tags", ",").alias("tags"), F.array_join(shown, ",").alias("highlights"))


@query(
    """SELECT doc_id, CASE WHEN strlen(text) <= 120 THEN text ELSE substr(text, 1, k) || chr(10) || '… [truncated, ' || (strlen(text) - strlen(substr(text, 1, k))) || ' more bytes]' END AS bytes,
      CASE WHEN len(l) <= 2 THEN text ELSE array_to_string(l[1:2], chr(10)) || chr(10) || '… [+' || (len(l) - 2) || ' line' || CASE WHEN len(l) = 3 THEN '' ELSE 's' END || ' elided]' END AS lines,
      CASE WHEN length(p) <= 80 THEN p ELSE rtrim(substr(p, 1, 77)) || '...' END AS line
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p,
      len(list_filter(range(1, 121), lambda i: strlen(substr(text, 1, i)) <= 120)) AS k FROM documents)"""
)
def sc_10_cut_texts(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.cut_bytes(text, 120).alias("bytes"), X.cut_lines(text, 2).alias("lines"), X.clamped_line(text, 80).alias("line"))


@query("SELECT 'w' || p_partkey AS name FROM part EXCEPT SELECT 'w' || l_partkey FROM lineitem WHERE l_linenumber > 2 AND l_partkey % 3 = 0")
def ca_12_installed_not_imported(spark, sf_dir):
    declared = read(spark, sf_dir, "part").select(F.concat(F.lit("w"), "p_partkey").alias("name"))
    line, n = read(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    package = F.concat(F.lit("w"), "l_partkey")
    module = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("../"), package)).when(n > 3, F.concat(package, F.lit("/deep"))).when(n == 3, package).when(n == 2, F.concat(F.lit("./"), package)).otherwise(F.concat(F.lit("node:"), package))
    return C.undeclared(declared, line.select(module.alias("module")))
