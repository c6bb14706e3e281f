"""Queries over transcripts and tool sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import transcripts as R
from tessera.plans.registry import query
from tessera.sources.tables import CHUNKS_SQL, EDGES_SQL, chunks, edges, read


@query("SELECT chunk_id, CASE WHEN back <= 2 THEN 'hot' WHEN back <= 4 THEN 'warm' ELSE 'cold' END AS zone FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS back FROM chunks)", CHUNKS_SQL)
def wn_04_zones(spark, sf_dir):
    return R.zones(chunks(spark, sf_dir), "session_id", "turn_index", hot=2, warm=2).select("chunk_id", "zone")


@query("SELECT chunk_id, CAST(place AS INTEGER) AS place FROM (SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS place FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, chunk_id ROWS UNBOUNDED PRECEDING)) WHERE (total <= 400 OR place = 1) AND place <= 12", CHUNKS_SQL)
def wn_07_newest_within_budget(spark, sf_dir):
    return R.newest_within(chunks(spark, sf_dir), "session_id", [F.desc("ts"), F.col("chunk_id")], F.length("text"), 400, most=12).select("chunk_id", "place")


_RUNS = "SELECT identity_name, run, kind, count(*) AS n, min(ts) AS first FROM (SELECT *, CAST(sum(changed) OVER (PARTITION BY identity_name ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY identity_name ORDER BY ts, id) THEN 0 ELSE 1 END AS changed FROM edges)) GROUP BY ALL"


@query(_RUNS, EDGES_SQL)
def wn_08_run_lengths(spark, sf_dir):
    return R.collapse_runs(edges(spark, sf_dir), "identity_name", ["ts", "id"], "kind")


@query(
    """SELECT id, island, CAST(floor((row_number() OVER (PARTITION BY identity_name, island ORDER BY ts, id) - 1) / 3) AS BIGINT) AS bucket FROM (
    SELECT *, CAST(sum(CASE WHEN kind = 'resolved' THEN 1 ELSE 0 END) OVER (PARTITION BY identity_name ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM edges) WHERE kind <> 'resolved'""",
    EDGES_SQL,
)
def wn_09_cold_buckets(spark, sf_dir):
    return R.buckets(edges(spark, sf_dir), "identity_name", ["ts", "id"], F.col("kind") == "resolved", size=3).select("id", "island", "bucket")


@query("SELECT u.chunk_id, u.session_id, u.ts, (SELECT min_by(a.chunk_id, (a.ts, a.chunk_id)) FROM chunks a WHERE a.role = 'assistant' AND a.session_id = u.session_id AND a.ts > u.ts) AS reply_id FROM chunks u WHERE u.role = 'user'", CHUNKS_SQL)
def jn_20_first_reply(spark, sf_dir):
    return R.first_reply(chunks(spark, sf_dir))


@query(
    """SELECT e.id, (SELECT max_by(c.chunk_id, (c.ts, c.chunk_id)) FROM chunks c WHERE c.session_id = e.session AND c.ts <= e.at) AS chunk_id
    FROM (SELECT id, id % 50 AS session, (id % 50) * 1000000 + (id % 7) * 45000 AS at FROM edges) e""",
    EDGES_SQL, CHUNKS_SQL,
)
def jn_07_nearest_chunk(spark, sf_dir):
    events = edges(spark, sf_dir).select("id", (F.col("id") % 50).alias("session_id"), ((F.col("id") % 50) * 1000000 + (F.col("id") % 7) * 45000).alias("ts"))
    return R.nearest_before(events, chunks(spark, sf_dir))


@query("SELECT session_id, min(CASE WHEN ts > 0 THEN ts END) AS first_ts, max(CASE WHEN ts > 0 THEN ts END) AS last_ts FROM chunks GROUP BY 1", CHUNKS_SQL)
def tr_13_session_span(spark, sf_dir):
    return R.session_span(chunks(spark, sf_dir))


@query("SELECT chunk_id, back FROM (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, chunk_id DESC) AS INTEGER) AS back FROM chunks WHERE trim(text) <> '') WHERE back <= 3", CHUNKS_SQL)
def tr_14_current_thread(spark, sf_dir):
    return R.current_thread(chunks(spark, sf_dir), turns=3).select("chunk_id", "back")


@query(
    """SELECT session_id, CASE WHEN asked IS NULL THEN 'none' WHEN coalesce(answered, -1) > asked THEN 'finish in-flight work' ELSE 'answer the user' END AS hint FROM (
    SELECT session_id, max(CASE WHEN role = 'user' THEN ts END) AS asked, max(CASE WHEN role = 'assistant' THEN ts END) AS answered FROM chunks GROUP BY 1)""",
    CHUNKS_SQL,
)
def tr_12_next_step(spark, sf_dir):
    return R.next_step(chunks(spark, sf_dir))


_CHUNK = "CASE role WHEN 'user' THEN '[user]' WHEN 'assistant' THEN '[assistant]' ELSE '[synthetic]' END || ' ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…[truncated]' ELSE text END"


@query(f"SELECT chunk_id, text, substr(sha256(text), 1, 16) AS text_hash FROM (SELECT chunk_id, {_CHUNK} AS text FROM chunks WHERE trim(text) <> '')", CHUNKS_SQL)
def tr_02_build_chunks(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "assistant_text").otherwise("user_text")
    events = chunks(spark, sf_dir).select("session_id", F.col("turn_index").alias("ordinal"), kind.alias("kind"), (F.col("role") == "system").alias("synthetic"), "text", F.lit(False).alias("is_error"))
    return R.build_chunks(events, body=200).select("chunk_id", "text", "text_hash")


@query(
    """SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(b.h, a.h) AS text_hash, CASE WHEN a.h = b.h OR b.h IS NULL THEN true ELSE false END AS has_vector,
    CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL OR a.h = b.h THEN 'same' ELSE 'changed' END AS change
    FROM (SELECT chunk_id, sha256(text) AS h FROM chunks WHERE turn_index <> 1) a FULL JOIN (SELECT chunk_id, sha256(CASE WHEN turn_index = 2 THEN text || '!' ELSE text END) AS h FROM chunks WHERE turn_index <> 0) b USING (chunk_id)""",
    CHUNKS_SQL,
)
def snk_17_chunk_upsert(spark, sf_dir):
    own = chunks(spark, sf_dir)
    stored = own.where("turn_index <> 1").select("chunk_id", F.sha2("text", 256).alias("text_hash"), F.lit(True).alias("has_vector"))
    new = own.where("turn_index <> 0").select("chunk_id", F.sha2(F.when(F.col("turn_index") == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_hash"))
    return R.upsert_chunks(stored, new)


_SEQ = """steps AS (SELECT identity_name, id, ts, kind AS tool, file_path AS arg, kind || '::' || file_path AS step FROM edges),
  ahead AS (SELECT identity_name, array_agg(step) OVER w AS s, array_agg(tool) OVER w AS t, array_agg(arg) OVER w AS a FROM steps WINDOW w AS (PARTITION BY identity_name ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
  runs AS (SELECT identity_name, n AS length, s[1:n] AS s, t[1:n] AS t, a[1:n] AS a FROM ahead, (SELECT unnest([3, 4, 5, 6, 7, 8]) AS n) WHERE len(s) >= n),
  found AS (SELECT identity_name, length, array_to_string(s, '|') AS signature FROM runs WHERE len(list_distinct(t)) >= 2 AND list_max(list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)))) <= 0.8 * length)"""


#: Events whose sequences, six for each at most, are one task's.
EVENTS_OF_A_TASK = 40_000


def _parts(spark, sf_dir):
    """As many tasks as the session shuffles to, or more where there are many events: a task's memory doesn't grow with them."""
    events = read(spark, sf_dir, "events").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events // EVENTS_OF_A_TASK))


def _found(spark, sf_dir):
    steps = edges(spark, sf_dir).select("identity_name", "id", "ts", F.col("kind").alias("tool"), F.col("file_path").alias("arg"))
    return R.sequences(steps, "identity_name", ["ts", "id"])


@query("SELECT identity_name, CAST(length AS INTEGER) AS length, signature, sha256(signature) AS hash FROM found", EDGES_SQL, _SEQ)
def sq_02_tool_sequences(spark, sf_dir):
    return _found(spark, sf_dir)


@query("SELECT sha256(signature) AS hash, signature, CAST(length AS INTEGER) AS length, count(DISTINCT identity_name) AS occurrences FROM found GROUP BY ALL", EDGES_SQL, _SEQ)
def sq_04_candidates(spark, sf_dir):
    return R.candidates(_found(spark, sf_dir), "identity_name", least=1, parts=_parts(spark, sf_dir))


@query("""SELECT DISTINCT hash, sha256(s) AS skip FROM (SELECT sha256(signature) AS hash, unnest(list_concat([signature], list_transform(generate_series(1, length), lambda i: array_to_string(list_concat(p[1:i - 1], p[i + 1:length]), '|')))) AS s
    FROM (SELECT signature, length, string_split(signature, '|') AS p FROM (SELECT DISTINCT signature, length FROM found)))""", EDGES_SQL, _SEQ)  # fmt: skip
def sq_03_skip_hashes(spark, sf_dir):
    """Signatures alone are made distinct, dealt to tasks by themselves; hashes are computed of what is left and never shuffled."""
    once = _found(spark, sf_dir).select("signature").repartition(_parts(spark, sf_dir), "signature").distinct()
    return R.skip_hashes(once.select(F.sha2("signature", 256).alias("hash"), "signature"))


@query(r"SELECT session_id, path, CAST(n AS INTEGER) AS n FROM (SELECT page_id AS session_id, path, row_number() OVER (PARTITION BY page_id ORDER BY path) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '(/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)', 1)) AS path FROM pages)) WHERE n <= 30")
def tr_05_path_mentions(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("session_id"), F.lit(1).alias("ts"), F.col("url").alias("text"))
    return R.path_mentions(rows)


@query(
    """SELECT identity_name, file_path, count(*) AS total, least(100, count(*) * 10) AS confidence, string_agg(CASE WHEN n <= 8 THEN kind END, ',' ORDER BY n) AS evidence
    FROM (SELECT *, row_number() OVER (PARTITION BY identity_name, file_path ORDER BY ts DESC, id DESC) AS n FROM edges) GROUP BY 1, 2""",
    EDGES_SQL,
)
def snk_13_witnesses(spark, sf_dir):
    return R.interactions(edges(spark, sf_dir), ["identity_name", "file_path"])


@query("SELECT url, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '.' END AS dir, string_split(url, '/')[-1] AS base, sha1(url || chr(0) || page_id) AS key, substr(sha256(url), 1, 16) AS short FROM pages")
def sc_08_paths_and_keys(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("url", X.dirname(u).alias("dir"), X.basename(u).alias("base"), X.joined_key(u, F.col("page_id").cast("string")).alias("key"), X.short_hash(u).alias("short"))


@query("SELECT ts % 100000000 AS span, CASE WHEN ts % 100000000 < 60000 THEN CAST(floor((ts % 100000000) / 1000) AS BIGINT) || 's' WHEN ts % 100000000 < 3600000 THEN CAST(floor((ts % 100000000) / 60000) AS BIGINT) || 'm' WHEN ts % 100000000 < 86400000 THEN CAST(floor((ts % 100000000) / 3600000) AS BIGINT) || 'h' ELSE CAST(floor((ts % 100000000) / 86400000) AS BIGINT) || 'd' END AS age FROM edges", EDGES_SQL)
def sc_03_age(spark, sf_dir):
    span = F.col("ts") % 100000000
    return edges(spark, sf_dir).select(span.alias("span"), X.age(span).alias("age"))


@query(
    """SELECT session_id, path, CAST(n AS INTEGER) AS n FROM (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY max(ts) DESC, path) AS n
      FROM (SELECT session_id, ts, '/' || workspace || '/' || file_path AS path FROM edges) GROUP BY 1, 2) WHERE n <= 30""",
    EDGES_SQL,
)
def tr_05_newest_paths(spark, sf_dir):
    rows = edges(spark, sf_dir).select("session_id", "ts", F.concat(F.lit("opened /"), "workspace", F.lit("/"), "file_path", F.lit(" ("), "kind", F.lit(")")).alias("text"))
    return R.path_mentions(rows)


def _lines(spark, sf_dir):
    """Conversations as transcript lines: an assistant's turn calls a tool after its text; the next user's turn answers it, then speaks."""
    t, text = F.col("turn"), F.col("text")
    block = lambda kind, text, ident, name, used, content: F.struct(F.lit(kind).alias("type"), text.alias("text"), ident.alias("id"), name.alias("name"), used.alias("tool_use_id"), content.alias("content"))
    null = F.lit(None).cast("string")
    said = block("text", text, null, null, null, null)
    call = block("tool_use", null, F.concat(F.lit("t"), t), F.lit("Read"), null, null)
    answer = block("tool_result", null, null, null, F.concat(F.lit("t"), t - 1), F.concat(F.lit("of "), text))
    content = F.when(F.col("role") == "assistant", F.to_json(F.array(said, call))).when((F.col("role") == "user") & (t > 0), F.to_json(F.array(answer, said))).otherwise(text)
    rows = read(spark, sf_dir, "conversations").where("role in ('user', 'assistant') and text is not null")
    return rows.select(F.col("conv_id").alias("source_path"), t.alias("line"), F.col("role").alias("type"), F.struct("role", content.alias("content")).alias("message"), F.lit(False).alias("isMeta"), F.lit("").alias("timestamp"))


_EVENTS = """blocks AS (SELECT conv_id, turn, unnest(CASE WHEN role = 'assistant' THEN [role || '_text', 'tool_use'] WHEN turn > 0 THEN ['tool_result', 'user_text'] ELSE ['user_text'] END) AS kind,
    unnest(CASE WHEN role = 'assistant' THEN [text, NULL] WHEN turn > 0 THEN ['of ' || text, text] ELSE [trim(text)] END) AS text,
    unnest(CASE WHEN role = 'assistant' THEN [1, 2] WHEN turn > 0 THEN [1, 2] ELSE [1] END) AS pos
    FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL),
  happened AS (SELECT conv_id AS source_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS ordinal, kind, text, turn FROM blocks)"""


@query("SELECT source_path, CAST(ordinal AS INTEGER) AS ordinal, kind, text FROM happened", _EVENTS)
def tr_01_events(spark, sf_dir):
    return R.reduce_lines(_lines(spark, sf_dir)).select("source_path", "ordinal", "kind", "text")


@query(
    """SELECT a.source_path, CAST(a.ordinal AS INTEGER) AS ordinal, 't' || a.turn AS tool_id, b.text AS result FROM happened a
    LEFT JOIN happened b ON b.source_path = a.source_path AND b.kind = 'tool_result' AND b.turn = a.turn + 1 WHERE a.kind = 'tool_use'""",
    _EVENTS,
)
def jn_15_tool_results(spark, sf_dir):
    return R.pair_tools(R.reduce_lines(_lines(spark, sf_dir))).select("source_path", "ordinal", "tool_id", "result")
