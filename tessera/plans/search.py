"""Queries of full-text, vector and fused retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import search as S
from tessera.operators import stored_index
from tessera.plans.registry import query
from tessera.sources.shared import shared_folder
from tessera.sources.tables import CHANGELOG_SQL, CHUNKS_SQL, FILES_SQL, changelog, chunks, files, read

TERMS = ["the", "inst", "thand"]

#: Splitting of camelCase, acronyms, underscores and white space, as in normalize().
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_TOKENS = r"list_filter(string_split_regex(lower(" + _NORM + r"), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _bm25(table, key, text, terms):
    words = _TOKENS.format(t=f"coalesce({text}, '')")
    tf = ", ".join(f"len(list_filter(words, lambda w: w = '{q}')) AS tf_{i}" for i, q in enumerate(sorted(terms)))
    df = ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END) OVER () AS df_{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n_docs - df_{i} + 0.5) / (df_{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df_{i} + 0.5) / (df_{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf_{i} > 0" for i in range(len(terms)))
    return f"""SELECT {key}, round({score}, 6) AS score FROM (SELECT *, CAST(count(*) OVER () AS DOUBLE) AS n_docs, avg(dl) OVER () AS avgdl, {df} FROM (
      SELECT {key}, len(words) AS dl, {tf} FROM (SELECT {key}, {words} AS words FROM {table}))) WHERE {hit}"""


@query(f"SELECT doc_id, {_NORM.format(t='text')} AS plain FROM documents")
def ft_01_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("plain"))


@query(
    "SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(lower(regexp_replace("
    + _NORM.format(t="text")
    + r", '[^\p{L}\p{N}\s]', ' ', 'g')), '\s+'), lambda w: length(w) > 1 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in sorted(X.STOPWORDS_TRANSCRIPTS))
    + """], w)), lambda w: '"' || w || '"'), ' OR ') AS expression FROM conversations"""
)
def ft_02_match_expression(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.match_expression(F.col("text"), X.STOPWORDS_TRANSCRIPTS).alias("expression"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format(t='text')}) AS term FROM documents) GROUP BY ALL")
def ft_06_inverted_index(spark, sf_dir):
    return S.postings(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(_bm25("documents", "doc_id", "text", TERMS) + " ORDER BY score DESC, doc_id LIMIT 50")
def ft_07_bm25_documents(spark, sf_dir):
    return S.bm25(read(spark, sf_dir, "documents"), TERMS, key="doc_id", text="text").orderBy(F.desc("score"), "doc_id").limit(50)


@query(_bm25("documents", "doc_id", "text", TERMS) + " ORDER BY score DESC, doc_id LIMIT 50")
def ft_07_stored_bm25(spark, sf_dir):
    """The index of all documents, written in two batches; the search reads its postings alone."""
    docs, path = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    for batch in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")):
        stored_index.append(batch, path, key="doc_id", text="text")
    return stored_index.search(spark, path, TERMS, k=50).withColumnRenamed("key", "doc_id")


@query(_bm25("changelog", "id", "summary", ["urgent", "w7"]) + " ORDER BY score DESC, id DESC LIMIT 50", CHANGELOG_SQL)
def ft_08_bm25_changelog(spark, sf_dir):
    return S.bm25(changelog(spark, sf_dir), ["urgent", "w7"], key="id", text="summary").orderBy(F.desc("score"), F.desc("id")).limit(50)


@query("SELECT chunk_id, score FROM (" + _bm25("chunks", "chunk_id", "text", TERMS) + ") JOIN chunks USING (chunk_id) WHERE role = 'user' ORDER BY score DESC, chunk_id LIMIT 50", CHUNKS_SQL)
def ft_09_bm25_transcripts(spark, sf_dir):
    own = chunks(spark, sf_dir)
    scored = S.bm25(own, TERMS, key="chunk_id", text="text").join(own.where("role = 'user'").select("chunk_id"), "chunk_id")
    return scored.orderBy(F.desc("score"), "chunk_id").limit(50)


@query("SELECT id, file_path FROM files WHERE contains(lower(blurb), 'thand') OR contains(lower(file_path), 'thand') OR contains(lower(blurb), 'src3') OR contains(lower(file_path), 'src3')", FILES_SQL)
def flt_05_keyword_fallback(spark, sf_dir):
    return S.keyword_matches(files(spark, sf_dir), ["thand", "src3"], ["blurb", "file_path"]).select("id", "file_path")


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vector(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_KNN = "SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(" + _Q + " AS DOUBLE[])), 6) AS distance FROM embeddings"


def _ranks(inner):
    return f"SELECT vec_id, distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank FROM ({inner})"


@query(_ranks(_KNN + " WHERE label = 3 ORDER BY distance, vec_id LIMIT 20"))
def vx_01_knn_prefiltered(spark, sf_dir):
    return S.nearest(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), key="vec_id", vector="embedding", k=20, where=F.col("label") == 3)


@query(_ranks("SELECT * FROM (" + _KNN + " ORDER BY distance, vec_id LIMIT 60) WHERE label = 3 ORDER BY distance, vec_id LIMIT 20"))
def vx_04_knn_postfiltered(spark, sf_dir):
    return S.nearest(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), key="vec_id", vector="embedding", k=20, where=F.col("label") == 3, prefilter=False, oversample=3)


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) AS norm2, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS first FROM embeddings")
def vx_05_normalize(spark, sf_dir):
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(S.dot(v, v), 4).alias("norm2"), F.round(S.normalized(v)[0], 5).alias("first"))


@query("SELECT id, array_to_string(list_filter([file_path, purpose, blurb], lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)) AS text FROM files", FILES_SQL)
def vx_07_embedding_text(spark, sf_dir):
    return files(spark, sf_dir).select("id", S.embedding_text([F.col("file_path"), F.col("purpose"), F.col("blurb")]).alias("text"))


@query("SELECT id, sha256(purpose) AS text_hash FROM files WHERE id % 3 <> 0 OR id % 2 = 1", FILES_SQL)
def vx_08_stale_embeddings(spark, sf_dir):
    own = files(spark, sf_dir)
    hashes = own.where("id % 3 = 0").select("id", F.sha2(F.when(F.col("id") % 2 == 0, F.col("purpose")).otherwise("x"), 256).alias("text_hash"))
    return S.stale_embeddings(own, hashes, key="id", text="purpose")


@query("SELECT chunk_id, ts FROM chunks WHERE turn_index % 2 = 1 ORDER BY ts DESC, chunk_id LIMIT 30", CHUNKS_SQL)
def vx_09_embedding_backlog(spark, sf_dir):
    own = chunks(spark, sf_dir).withColumn("has_vector", F.col("turn_index") % 2 == 0)
    return S.backlog(own, key="chunk_id", budget=30).select("chunk_id", "ts")


@query()
def vx_06_hashed_embedder(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.hashed_embedding(F.col("text"), 16).alias("vector"))


_LISTS = f"""bm AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25("documents", "doc_id", "text", TERMS)}) QUALIFY rank <= 50),
  vec AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({_KNN}) QUALIFY rank <= 50)"""


def _lists(spark, sf_dir):
    bm = S.ranked(S.bm25(read(spark, sf_dir, "documents"), TERMS, key="doc_id", text="text"), "doc_id").select(F.col("doc_id").alias("id"), "rank")
    vec = S.nearest(read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), key="vec_id", vector="embedding", k=50).select(F.col("vec_id").alias("id"), "rank")
    return bm, vec


_FUSED = """SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(min(CASE WHEN list = 'bm25' THEN rank END) AS INTEGER) AS bm25_rank,
  CAST(min(CASE WHEN list = 'vector' THEN rank END) AS INTEGER) AS vector_rank FROM (SELECT *, 'bm25' AS list FROM bm UNION ALL SELECT *, 'vector' FROM vec) GROUP BY id"""


@query(_FUSED, _LISTS)
def rf_01_reciprocal_rank(spark, sf_dir):
    bm, vec = _lists(spark, sf_dir)
    return S.fuse([(bm, "bm25", 1.0), (vec, "vector", 1.0)], "id")


@query(f"SELECT * REPLACE (round(score / max(score) OVER (), 6) AS score) FROM ({_FUSED} ORDER BY score DESC, id LIMIT 20)", _LISTS)
def rf_02_scaled_fusion(spark, sf_dir):
    bm, vec = _lists(spark, sf_dir)
    return S.fuse([(bm, "bm25", 1.0), (vec, "vector", 1.0)], "id", limit=20, scale=True)


_HITS = """hits AS (SELECT 'transcripts' AS silo, chunk_id AS id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM ({a}) QUALIFY rank <= 50
  UNION ALL SELECT 'atlas_files', CAST(id AS VARCHAR), row_number() OVER (ORDER BY score DESC, id) FROM ({b}) QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 50
  UNION ALL SELECT 'atlas_changelog', CAST(id AS VARCHAR), row_number() OVER (ORDER BY score DESC, id) FROM ({c}) QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 50)""".format(
    a=_bm25("chunks", "chunk_id", "text", TERMS), b=_bm25("files", "id", "content", TERMS), c=_bm25("changelog", "id", "summary", ["urgent", "w7"])
)


def _hits(spark, sf_dir):
    out = None
    for silo, docs, key, text, terms in (
        ("transcripts", chunks(spark, sf_dir), "chunk_id", "text", TERMS),
        ("atlas_files", files(spark, sf_dir), "id", "content", TERMS),
        ("atlas_changelog", changelog(spark, sf_dir), "id", "summary", ["urgent", "w7"]),
    ):
        one = S.ranked(S.bm25(docs, terms, key=key, text=text), key).select(F.lit(silo).alias("silo"), F.col(key).cast("string").alias("id"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT silo, id, round(raw / max(raw) OVER (), 6) AS score FROM (SELECT silo, id, sum(1.0 / (60 + rank)) AS raw FROM hits GROUP BY 1, 2 ORDER BY raw DESC, silo, id LIMIT 20)""",
    CHUNKS_SQL, FILES_SQL, CHANGELOG_SQL, _HITS,
)
def rf_11_search_all_silos(spark, sf_dir):
    return S.fuse_silos(_hits(spark, sf_dir), k=20)


@query(
    "SELECT silo, coalesce(n, 0) AS n FROM (SELECT unnest(['transcripts', 'atlas_files', 'atlas_changelog', 'source_highlights']) AS silo) LEFT JOIN (SELECT silo, count(*) AS n FROM hits GROUP BY 1) USING (silo)",
    CHUNKS_SQL, FILES_SQL, CHANGELOG_SQL, _HITS,
)
def ag_24_silo_breakdown(spark, sf_dir):
    return S.silo_breakdown(spark, _hits(spark, sf_dir))


@query("SELECT language AS value, n, total FROM (SELECT language, count(*) AS n, sum(count(*)) OVER () AS total FROM files GROUP BY 1) WHERE n >= greatest(2, ceil(0.6 * total)) ORDER BY n DESC, language LIMIT 1", FILES_SQL)
def ag_21_concentration(spark, sf_dir):
    return S.concentration(files(spark, sf_dir), "language")


_CORPUS = """corpus AS (SELECT 'transcripts' AS silo, chunk_id AS id, role AS identity_name, session_id % 5 AS session_id, session_id % 3 AS project, CAST(NULL AS VARCHAR) AS workspace FROM chunks
  UNION ALL SELECT 'atlas_files', CAST(id AS VARCHAR), NULL, NULL, NULL, 'ws' || (id % 4) FROM files
  UNION ALL SELECT 'atlas_changelog', CAST(id AS VARCHAR), author_name, NULL, NULL, 'ws' || (id % 4) FROM changelog)"""


@query(
    """SELECT scope, silo, count(*) AS n, min(id) AS first, max(id) AS last FROM corpus JOIN (SELECT unnest(['self', 'session', 'workspace', 'identity', 'atlas', 'transcripts', 'all']) AS scope) ON CASE
      WHEN silo = 'transcripts' THEN CASE WHEN scope IN ('self', 'identity') THEN identity_name = 'user' WHEN scope = 'session' THEN session_id = 2 WHEN scope = 'workspace' THEN project = 1 ELSE scope <> 'atlas' END
      ELSE scope IN ('workspace', 'identity', 'atlas', 'all') AND workspace = 'ws1' END GROUP BY 1, 2""",
    CHUNKS_SQL, FILES_SQL, CHANGELOG_SQL, _CORPUS,
)
def flt_11_scopes(spark, sf_dir):
    """What each scope searches, of all silos read once."""
    none = lambda kind: F.lit(None).cast(kind)
    said = chunks(spark, sf_dir).select(F.lit("transcripts").alias("silo"), F.col("chunk_id").alias("id"), F.col("role").alias("identity_name"), (F.col("session_id") % 5).alias("session_id"), (F.col("session_id") % 3).alias("project"), none("string").alias("workspace"))
    where = F.concat(F.lit("ws"), F.col("id") % 4).alias("workspace")
    records = [
        of.select(F.lit(silo).alias("silo"), F.col("id").cast("string").alias("id"), who.alias("identity_name"), none("long").alias("session_id"), none("long").alias("project"), where)
        for silo, of, who in (("atlas_files", files(spark, sf_dir), none("string")), ("atlas_changelog", changelog(spark, sf_dir), F.col("author_name")))
    ]
    scopes = F.array_compact(F.array(*(F.when(S.in_scope(s, identity="user", session=2, project=1, workspace="ws1"), s) for s in S.SCOPES)))
    found = said.unionByName(records[0]).unionByName(records[1]).select("silo", "id", F.explode(scopes).alias("scope"))
    return found.groupBy("scope", "silo").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
