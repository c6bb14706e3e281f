"""Queries of composed retrieval over one and several workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import retrieval as R
from tessera.operators import search as S
from tessera.plans.registry import query
from tessera.plans.search import _KNN, TERMS, _bm25, _vector
from tessera.sources.tables import CHANGELOG_SQL, CHUNKS_SQL, FILES_SQL, changelog, chunks, files, read

_Q = "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])"
_DISTANCE = f"round(list_distance(CAST(embedding AS DOUBLE[]), {_Q}), 6)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


@query(f"SELECT id, file_path, start_line, distance, CAST(row_number() OVER (ORDER BY distance, file_path, start_line) AS INTEGER) AS rank FROM (SELECT vec_id AS id, 'src/f' || (vec_id % 40) || '.ts' AS file_path, 1 + vec_id % 80 AS start_line, {_DISTANCE} AS distance FROM embeddings) ORDER BY distance, file_path, start_line LIMIT 25")
def vx_02_nearest_source_chunks(spark, sf_dir):
    own = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.concat(F.lit("src/f"), F.col("vec_id") % 40, F.lit(".ts")).alias("file_path"), (1 + F.col("vec_id") % 80).alias("start_line"), "embedding")
    return R.nearest_with_ties(own, _vector(spark, sf_dir), vector="embedding", k=25, ties=[F.col("file_path"), F.col("start_line")]).drop("embedding")


@query(f"SELECT id, distance, CAST(row_number() OVER (ORDER BY distance, created_at DESC, id DESC) AS INTEGER) AS rank FROM (SELECT c.id, c.created_at, {_DISTANCE} AS distance FROM changelog c JOIN embeddings e ON e.vec_id = c.id) ORDER BY distance, created_at DESC, id DESC LIMIT 25", CHANGELOG_SQL)
def vx_03_nearest_changelog(spark, sf_dir):
    own = changelog(spark, sf_dir).select("id", "created_at").join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding"), "id")
    return R.nearest_with_ties(own, _vector(spark, sf_dir), vector="embedding", k=25, ties=[F.desc("created_at"), F.desc("id")]).select("id", "distance", "rank")


@query(f"SELECT f.id, f.file_path, h.distance FROM (SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 30) h JOIN files f ON f.id = h.vec_id", FILES_SQL)
def jn_02_vectors_to_records(spark, sf_dir):
    hits = S.nearest(_vectors(spark, sf_dir), _vector(spark, sf_dir), key="vec_id", vector="embedding", k=30).select(F.col("vec_id").alias("id"), "distance")
    return R.hydrated(hits, files(spark, sf_dir).select("id", "file_path"), "id").select("id", "file_path", "distance")


_ENTRIES = f"""bm AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_bm25("changelog", "id", "summary", ["urgent", "w7"])}) QUALIFY rank <= 50),
  vec AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({_KNN}) QUALIFY rank <= 50)"""


def _entry_lists(spark, sf_dir):
    bm = S.ranked(S.bm25(changelog(spark, sf_dir), ["urgent", "w7"], key="id", text="summary"), "id").select("id", "rank")
    vec = S.nearest(_vectors(spark, sf_dir), _vector(spark, sf_dir), key="vec_id", vector="embedding", k=50).select(F.col("vec_id").alias("id"), "rank")
    return bm, vec


@query(
    """SELECT id, score, file_path FROM (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM bm UNION ALL SELECT * FROM vec) GROUP BY id) JOIN changelog USING (id)
    WHERE NOT breaking_changes AND verification_status <> 'P' ORDER BY score DESC, id DESC LIMIT 10""",
    CHANGELOG_SQL, _ENTRIES,
)
def rf_04_changelog_fusion(spark, sf_dir):
    """Ten entries: the lists hold clamped(10, 5, 25, 100) = 50 candidates each."""
    bm, vec = _entry_lists(spark, sf_dir)
    keep = ~F.col("breaking_changes") & (F.col("verification_status") != "P")
    return R.fused_records([(bm, "text", 1.0), (vec, "vector", 1.0)], changelog(spark, sf_dir), key="id", keep=keep, limit=10, ties=[F.desc("id")]).select("id", "score", "file_path")


_FILE_LISTS = f"""texts AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT doc_id AS id, score FROM ({_bm25("documents", "doc_id", "text", TERMS)})) QUALIFY rank <= 30),
  near AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({_KNN}) QUALIFY rank <= 30),
  bm AS (SELECT file_path, rank FROM texts JOIN files USING (id)), whole AS (SELECT file_path, rank FROM near JOIN files USING (id)),
  parts AS (SELECT file_path, arg_min(id, rank) AS chunk, row_number() OVER (ORDER BY min(rank)) AS rank FROM (SELECT 'src/p' || (vec_id % 12) || '.ts' AS file_path, vec_id AS id, row_number() OVER (ORDER BY distance DESC, vec_id) AS rank FROM ({_KNN}) QUALIFY rank <= 30) GROUP BY 1)"""


def _file_lists(spark, sf_dir):
    own, vectors, asked = files(spark, sf_dir).select("id", "file_path"), _vectors(spark, sf_dir), _vector(spark, sf_dir)
    bm = S.ranked(S.bm25(read(spark, sf_dir, "documents"), TERMS, key="doc_id", text="text"), "doc_id", limit=30).select(F.col("doc_id").alias("id"), "rank")
    near = S.nearest(vectors, asked, key="vec_id", vector="embedding", k=30).select(F.col("vec_id").alias("id"), "rank")
    far = vectors.select("vec_id", F.round(S.l2_distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in asked))), 6).alias("d"))
    chunk = S.ranked(far, "vec_id", score="d", limit=30).select(F.concat(F.lit("src/p"), F.col("vec_id") % 12, F.lit(".ts")).alias("file_path"), F.col("vec_id").alias("chunk"), "rank")
    return R.hydrated(bm, own, "id").select("file_path", "rank"), chunk, R.hydrated(near, own, "id").select("file_path", "rank")


@query("SELECT file_path, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT file_path, rank FROM bm UNION ALL SELECT file_path, rank FROM whole) GROUP BY 1 ORDER BY score DESC, file_path LIMIT 20", FILES_SQL, _FILE_LISTS)
def rf_05_seed_fusion(spark, sf_dir):
    bm, _, near = _file_lists(spark, sf_dir)
    return R.fused_seeds([bm, near.withColumn("file_path", F.replace("file_path", F.lit("/"), F.lit("\\")))], limit=20)


_THREE = """vec AS (SELECT file_path, row_number() OVER (ORDER BY score DESC, file_path) AS rank FROM (SELECT file_path, sum(1.0 / (60 + rank)) AS score FROM (SELECT file_path, rank FROM parts UNION ALL SELECT file_path, rank FROM whole) GROUP BY 1)),
  three AS (SELECT file_path, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM bm UNION ALL SELECT * FROM vec) GROUP BY 1 ORDER BY score DESC, file_path LIMIT 15)"""


@query("SELECT file_path, round(score / (SELECT max(score) FROM three), 4) AS score, chunk FROM three LEFT JOIN (SELECT file_path, chunk FROM parts) USING (file_path)", FILES_SQL, _FILE_LISTS, _THREE)
def rf_07_three_way(spark, sf_dir):
    bm, chunk, near = _file_lists(spark, sf_dir)
    return R.three_way(bm, chunk, near, limit=15)


_PER = f"""hits AS (SELECT 'ws' || (doc_id % 4) AS workspace, 'f' || doc_id AS file_path, score, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY score DESC, doc_id) AS rank FROM ({_bm25("documents", "doc_id", "text", TERMS)}) QUALIFY rank <= 10)"""


@query("SELECT workspace, file_path, round(score + 1.0 / (60 + row_number() OVER (ORDER BY CASE workspace WHEN 'ws2' THEN 1 WHEN 'ws0' THEN 2 ELSE 3 END, rank)), 9) AS score FROM hits WHERE workspace IN ('ws2', 'ws0', 'ws3') ORDER BY score DESC, workspace, file_path LIMIT 20", _PER)
def rf_06_across_workspaces(spark, sf_dir):
    from pyspark.sql.window import Window

    scored = S.bm25(read(spark, sf_dir, "documents"), TERMS, key="doc_id", text="text").withColumn("workspace", F.concat(F.lit("ws"), F.col("doc_id") % 4))
    rank = F.row_number().over(Window.partitionBy("workspace").orderBy(F.desc("score"), "doc_id"))
    hits = scored.withColumn("rank", rank).where("rank <= 10").select("workspace", F.concat(F.lit("f"), "doc_id").alias("file_path"), "score", "rank")
    return R.across_workspaces(hits, ["ws2", "ws0", "ws3"], limit=20)


@query("SELECT 'atlas_files' AS silo, CAST(id AS VARCHAR) AS id, CAST(rank AS INTEGER) AS rank FROM texts WHERE rank <= 10 UNION ALL SELECT 'atlas_changelog', CAST(id AS VARCHAR), CAST(rank AS INTEGER) FROM entries WHERE rank <= 20",
       f"texts AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25('documents', 'doc_id', 'text', TERMS)}))", CHANGELOG_SQL,
       f"entries AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_bm25('changelog', 'id', 'summary', ['urgent', 'w7'])}))")
def rf_08_evidence(spark, sf_dir):
    found = S.ranked(S.bm25(read(spark, sf_dir, "documents"), TERMS, key="doc_id", text="text"), "doc_id", limit=10).select(F.col("doc_id").alias("id"), "rank")
    return R.evidence(found, _entry_lists(spark, sf_dir)[0])


@query("SELECT file_path, 0.6 AS score FROM files WHERE contains(lower(concat_ws(' ', file_path, purpose, blurb, array_to_string(patterns, ' '), array_to_string(hazards, ' '))), 'p2 en') ORDER BY file_path LIMIT 12", FILES_SQL)
def rf_12_fallback_seeds(spark, sf_dir):
    return R.fallback_seeds(files(spark, sf_dir), "P2 En", limit=12).select("file_path", F.col("score").cast("decimal(2,1)").alias("score"))


@query("SELECT chunk_id FROM chunks WHERE session_id IN (3, 5, 8) AND session_id % 2 = 1 AND role = 'user'", CHUNKS_SQL)
def flt_10_transcript_scope(spark, sf_dir):
    own = chunks(spark, sf_dir).select("chunk_id", "session_id", F.col("role").alias("identity_name"), F.concat(F.lit("/w/"), F.col("session_id") % 2).alias("cwd"))
    return R.transcript_scope(own, identity="user", sessions=[3, 5, 8], folder="/w/1").select("chunk_id")


@query("SELECT id, file_path, coalesce(cluster, '') AS cluster, lower(regexp_replace(summary, '[_-]+', ' ', 'g')) AS summary FROM changelog", CHANGELOG_SQL)
def ft_05_changelog_documents(spark, sf_dir):
    own = changelog(spark, sf_dir)
    return own.select("id", "file_path", F.coalesce("cluster", F.lit("")).alias("cluster"), F.lower(X.normalize(F.col("summary"))).alias("summary"))


@query("SELECT f.id, file_path, len(embedding) AS size FROM files f LEFT JOIN embeddings e ON e.vec_id = f.id WHERE contains(file_path, '/f1')", FILES_SQL)
def src_08_export(spark, sf_dir):
    own = files(spark, sf_dir).where(F.contains("file_path", F.lit("/f1"))).select("id", "file_path")
    return own.join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("size")), "id", "left")
