"""The queries of this subpackage, one for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, divergence, fingerprints, jaccard, manifest, neighbours, packing, pii, quality, secrets, sharding, toxicity, urls
from tessera.llm.common import table

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, similarity=(9, 10))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **BYTE_BPE, tokenizer_path=TOKENIZER, capacity=1024, end_id=2)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), **BYTE_BPE)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, relax=2.0)


def op11_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), shards=8)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verification(table(spark, sf_dir, "documents"), fanout=3)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_jaccard, op2_toxicity, op3_fingerprints, op4_quality, op5_url_filter, op6_best_fit_packing, op7_pii, op8_secrets, op9_vantage_point_search, op10_byte_bpe,
        op11_two_pass_shuffle, op12_merkle_manifest, op13_source_divergence,
    )}


#: Sets as sorted distinct shingles; pairs that share a shingle, counted; links followed to the smallest id.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, list_sort(list(s)) AS members FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (
    SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) pairs
  JOIN sets a ON a.doc_id = p JOIN sets b ON b.doc_id = q WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id,
       coalesce((SELECT min(t.doc_id) FROM sets t WHERE t.members = s.members), d.doc_id) AS class_id
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars", "{0}"))) + ")"

#: Levels of each source's tree and of the crown by recursion; each document folds its altered leaf up run by run.
MERKLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS inverse
  FROM documents),
altered AS (SELECT *, CASE WHEN xor(inverse, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM crc),
leaves AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("changed")} AS hit,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM altered),
nodes(lvl, grp, idx, n, digest) AS (
  SELECT 0, source, idx, n, leaf FROM leaves
  UNION ALL SELECT lvl + 1, grp, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl + 1, grp, idx // 3),
tops AS (SELECT grp, digest, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown(lvl, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM tops
  UNION ALL SELECT lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY lvl + 1, idx // 3),
up(doc_id, grp, lvl, idx, n, folded, proof) AS (
  SELECT doc_id, source, 0, idx, n, hit, '' FROM leaves
  UNION ALL
  SELECT u.doc_id, u.grp, u.lvl + 1, u.idx // 3, (max(u.n) + 2) // 3, sha256(string_agg(CASE WHEN s.idx = u.idx THEN u.folded ELSE s.digest END, '' ORDER BY s.idx)),
         any_value(u.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx <> u.idx), '')
  FROM up u JOIN nodes s ON s.grp IS NOT DISTINCT FROM u.grp AND s.lvl = u.lvl AND s.idx // 3 = u.idx // 3
  WHERE u.n > 1 GROUP BY u.doc_id, u.grp, u.lvl + 1, u.idx // 3),
over(doc_id, lvl, idx, n, folded, proof) AS (
  SELECT doc_id, 0, t.idx, t.n, folded, proof FROM up JOIN tops t ON t.grp IS NOT DISTINCT FROM up.grp WHERE up.n = 1
  UNION ALL
  SELECT u.doc_id, u.lvl + 1, u.idx // 3, (max(u.n) + 2) // 3, sha256(string_agg(CASE WHEN s.idx = u.idx THEN u.folded ELSE s.digest END, '' ORDER BY s.idx)),
         any_value(u.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx <> u.idx), '')
  FROM over u JOIN crown s ON s.lvl = u.lvl AND s.idx // 3 = u.idx // 3
  WHERE u.n > 1 GROUP BY u.doc_id, u.lvl + 1, u.idx // 3)
SELECT l.doc_id, l.leaf, t.digest AS subroot, c.digest AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = c.digest AS verified
FROM leaves l JOIN tops t ON t.grp IS NOT DISTINCT FROM l.source JOIN over o ON o.doc_id = l.doc_id AND o.n = 1 JOIN crown c ON c.n = 1"""

#: Every kept term for every source, zeros written out.
DIVERGENCE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER own + count(*) OVER own) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER own + count(*) OVER own) AS q
  FROM cells WINDOW own AS (PARTITION BY lang, source)),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
  FROM groups x JOIN groups y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN shares a ON a.lang = x.lang AND a.source = x.source
  LEFT JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source = y.source GROUP BY x.lang, x.source, y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """The queries whose rows SQL can tell; the others are tested against plain versions."""
    return {"op1_ngram_jaccard": JACCARD_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_source_divergence": DIVERGENCE_SQL}
