"""Queries that put records together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators import views as V
from tessera.plans.registry import query
from tessera.plans.search import TERMS, _bm25
from tessera.sources.tables import CHANGELOG_SQL, CHUNKS_SQL, EDGES_SQL, FILES_SQL, changelog, chunks, edges, files, read

LINKS = "links AS (SELECT DISTINCT id AS src, (id * 7 + 3) % 50 AS dst FROM files UNION SELECT DISTINCT id % 20, id FROM files)"


def _links(own):
    return own.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 50).alias("dst")).union(own.select(F.col("id") % 20, "id")).distinct()


def _list(key, value, name):
    return f"(SELECT {key} AS id, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {value}) AS {name} FROM (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {value}) <= 5) GROUP BY 1)"


@query(
    f"""SELECT f.id, file_path, (CASE WHEN trim(purpose) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(blurb) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(cluster, '')) <> '' THEN 1 ELSE 0 END)
      + (CASE WHEN len(tags) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(patterns) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(hazards) > 0 THEN 1 ELSE 0 END) AS coverage, coalesce(imports, '') AS imports, coalesce(imported_by, '') AS imported_by
    FROM files f LEFT JOIN {_list("src", "dst", "imports")} o ON o.id = f.id LEFT JOIN {_list("dst", "src", "imported_by")} i ON i.id = f.id""",
    FILES_SQL, LINKS,
)
def prj_02_brief_cards(spark, sf_dir):
    own = files(spark, sf_dir)
    return V.brief(own, _links(own))


@query("SELECT file_path, count(*) AS entries, string_agg(CASE WHEN n <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY n) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id DESC) AS n FROM changelog) GROUP BY 1", CHANGELOG_SQL)
def prj_03_lookup(spark, sf_dir):
    return V.lookup(changelog(spark, sf_dir))


@query("SELECT id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS snippet FROM files WHERE len(string_split(content, chr(10))) >= 2", FILES_SQL)
def prj_04_snippet(spark, sf_dir):
    return V.snippet(files(spark, sf_dir), 2, 3)


@query("SELECT cluster, files, rank FROM (SELECT cluster, count(*) AS files, CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) AS INTEGER) AS rank FROM files WHERE cluster IS NOT NULL GROUP BY 1) WHERE rank <= 5", FILES_SQL)
def prj_05_context_clusters(spark, sf_dir):
    counts = files(spark, sf_dir).where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("files"))
    return S.ranked(counts, "cluster", score="files", limit=5)


@query("SELECT DISTINCT id, b.i AS line, lines[b.i] AS text FROM (SELECT id, lines, unnest(list_filter(generate_series(1, len(lines)), lambda i: contains(lines[i], 'erthan'))) AS hit FROM (SELECT id, string_split(content, chr(10)) AS lines FROM files)), LATERAL (SELECT unnest(generate_series(greatest(1, hit - 2), least(len(lines), hit + 2))) AS i) b", FILES_SQL)
def wn_13_match_context(spark, sf_dir):
    return V.matches_with_context(files(spark, sf_dir), "erthan")


@query("SELECT cluster, count(*) AS files, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT coalesce(cluster, 'uncategorized') AS cluster, (SELECT count(*) FROM links WHERE src = f.id) + (SELECT count(*) FROM links WHERE dst = f.id) AS n FROM files f) GROUP BY 1", FILES_SQL, LINKS)
def ag_19_cluster_summary(spark, sf_dir):
    own = files(spark, sf_dir)
    return V.cluster_summary(own, _links(own))


@query("SELECT language, directory, n FROM (SELECT language, regexp_replace(file_path, '/[^/]*$', '') AS directory, count(*) AS n FROM files GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, directory) = 1", FILES_SQL)
def ag_22_dominant_directory(spark, sf_dir):
    return V.dominant_directory(files(spark, sf_dir), "language")


@query("SELECT identity_name, string_agg(kind || ' x' || n, ', ' ORDER BY n DESC, kind) AS summary FROM (SELECT identity_name, kind, count(*) AS n FROM edges GROUP BY identity_name, kind QUALIFY row_number() OVER (PARTITION BY identity_name ORDER BY count(*) DESC, kind) <= 3) GROUP BY 1", EDGES_SQL)
def ag_25_bucket_summary(spark, sf_dir):
    return V.bucket_tools(edges(spark, sf_dir), "identity_name", "kind", limit=3)


@query("SELECT count(*) AS files, count(*) FILTER (len(hazards) > 0) AS with_references, round(count(*) FILTER (len(hazards) > 0) / greatest(count(*), 1), 6) AS ratio, round(count(*) FILTER (len(hazards) > 0) / greatest(count(*), 1), 6) < 0.1 AS warn FROM files", FILES_SQL)
def ag_29_crossref_ratio(spark, sf_dir):
    return V.crossref_ratio(files(spark, sf_dir), F.size("hazards"))


@query("SELECT chunk_id, CASE WHEN saves > 0 AND coalesce(before, 0) < total - 600 THEN 'short' ELSE 'full' END AS level FROM (SELECT *, sum(saves) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(length(text)) OVER (PARTITION BY session_id) AS total FROM (SELECT *, greatest(length(text) - 50, 0) AS saves FROM chunks))", CHUNKS_SQL)
def wn_05_budget_demotion(spark, sf_dir):
    own = chunks(spark, sf_dir).withColumn("size", F.length("text"))
    return V.demoted(own, "session_id", "turn_index", "size", budget=600, small=50).select("chunk_id", "level")


@query("SELECT DISTINCT node FROM (SELECT id AS node FROM files WHERE id % 31 = 0 UNION ALL SELECT dst FROM links WHERE src % 31 = 0 AND src IN (SELECT id FROM files) UNION ALL SELECT src FROM links WHERE dst % 31 = 0 AND dst IN (SELECT id FROM files))", FILES_SQL, LINKS)
def set_03_expand_targets(spark, sf_dir):
    own = files(spark, sf_dir)
    return V.expanded_targets(own.where("id % 31 = 0").select(F.col("id").alias("node")), _links(own))


@query("SELECT id, id IN (SELECT src FROM links WHERE dst IN (SELECT id FROM files WHERE id % 10 = 3)) AS crossrefs_stale FROM files", FILES_SQL, LINKS)
def gr_18_stale_dependents(spark, sf_dir):
    own = files(spark, sf_dir)
    return V.stale_dependents(own, own.where("id % 10 = 3").select(F.col("id").alias("node")), _links(own))


@query("SELECT id, CASE WHEN id % 2 = 0 AND length(purpose) > length(blurb) THEN purpose ELSE blurb END AS blurb FROM files", FILES_SQL)
def jn_13_update_from_richer(spark, sf_dir):
    own = files(spark, sf_dir)
    return V.update_richer(own.select("id", "blurb"), own.where("id % 2 = 0").select("id", F.col("purpose").alias("blurb")), "id", "blurb")


@query("SELECT chunk_id, role FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE turn_index = 2)", CHUNKS_SQL)
def jn_14_hydrate(spark, sf_dir):
    own = chunks(spark, sf_dir)
    return V.hydrate(own, own.where("turn_index = 2"), "chunk_id").select("chunk_id", "role")


@query("SELECT id, file_path, pattern FROM (SELECT id, file_path, unnest(patterns) AS pattern FROM files)", FILES_SQL)
def jn_11_lateral_patterns(spark, sf_dir):
    return files(spark, sf_dir).select("id", "file_path", F.explode("patterns").alias("pattern"))


@query("SELECT chunk_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 WHEN 'system' THEN 2 ELSE 3 END, turn_index) AS INTEGER) AS place FROM chunks", CHUNKS_SQL)
def tk_05_todo_order(spark, sf_dir):
    status = F.when(F.col("role") == "assistant", "in_progress").when(F.col("role") == "user", "pending").otherwise("completed")
    return V.todo_order(chunks(spark, sf_dir).withColumn("status", status).withColumn("pos", F.col("turn_index"))).select("chunk_id", "place")


@query("SELECT session_id, file_path, count(*) AS touches, max(ts) AS last_ts, max_by(kind, (ts, id)) AS last_kind FROM edges GROUP BY 1, 2", EDGES_SQL)
def tr_04_file_context(spark, sf_dir):
    return V.file_context(edges(spark, sf_dir))


@query("SELECT detail AS key, count(*) AS occurrences, max(ts) AS last_ts, detail LIKE '%7' AS promoted FROM edges WHERE detail IS NOT NULL GROUP BY 1 HAVING detail LIKE '%7' OR max(ts) >= 1706600000000 - 2592000000", EDGES_SQL)
def sq_05_prune_candidates(spark, sf_dir):
    rows = edges(spark, sf_dir).where("detail is not null").groupBy(F.col("detail").alias("key")).agg(F.count("*").alias("occurrences"), F.max("ts").alias("last_ts"))
    return V.kept_candidates(rows.withColumn("promoted", F.col("key").endswith("7")), 1_706_600_000_000)


@query(f"SELECT id, score, file_path FROM (SELECT id, round(score / max(score) OVER (), 6) AS score FROM ({_bm25('files', 'id', 'content', TERMS)}) WHERE id <> 5) JOIN files USING (id) WHERE score >= 0.5", FILES_SQL)
def rf_09_similar(spark, sf_dir):
    own = files(spark, sf_dir)
    return V.similar(own, 5, S.bm25(own, TERMS, key="id", text="content"))


@query(f"SELECT id, score FROM ({_bm25('changelog', 'id', 'summary', ['urgent', 'w7'])}) JOIN changelog USING (id) WHERE breaking_changes IS NOT NULL ORDER BY score DESC, created_at DESC, id DESC LIMIT 40", CHANGELOG_SQL)
def ft_10_relevance_order(spark, sf_dir):
    own = changelog(spark, sf_dir)
    return S.bm25(own, ["urgent", "w7"], key="id", text="summary").join(own, "id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(40).select("id", "score")


_DOC = "files_text AS (SELECT id, concat_ws(' ', file_path, blurb, purpose, array_to_string(tags, ' '), array_to_string(patterns, ' '), array_to_string(hazards, ' ')) AS doc FROM files)"


@query(_bm25("files_text", "id", "doc", ["en", "src3", "the"]), FILES_SQL, _DOC)
def ft_04_file_documents(spark, sf_dir):
    doc = F.concat_ws(" ", "file_path", "blurb", "purpose", *(F.array_join(c, " ") for c in ("tags", "patterns", "hazards")))
    return S.bm25(files(spark, sf_dir).select("id", doc.alias("doc")), ["en", "src3", "the"], key="id", text="doc")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, sha1(props) AS hash, round(ln(1 + greatest(value, 0)), 6) AS log_value, coalesce(nullif(trim(event_type), 'view'), 'none') AS kind FROM events")
def sc_04_json_and_math(spark, sf_dir):
    kind = F.coalesce(F.nullif(F.trim("event_type"), F.lit("view")), F.lit("none"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.sha1("props").alias("hash"), F.round(F.log1p(F.greatest("value", F.lit(0.0))), 6).alias("log_value"), kind.alias("kind"))
