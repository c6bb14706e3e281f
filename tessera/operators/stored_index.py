"""A stored inverted index: postings in blocks, dealt to buckets by term, appended to by documents, read by term.

A block holds one term's postings in at most CHUNK documents, with its largest count and its shortest document, which bound
what the term can add to a score there. A query reads the buckets of its terms, never a text, and for the best k only
blocks that can hold one of them. So neither a frequent term nor the whole index is ever one task's.

Defined results: null texts have no terms but count as documents; null keys aren't indexed; a key is expected to stand for one document; an
empty index and a query without terms give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import index_tokens
from tessera.operators.search import K1, B, held
from tessera.sources.shared import Scratch, cut

#: Documents whose postings of a term make a block, at most; folders that terms are dealt to.
CHUNK, BUCKETS = 4_096, 64
#: Blocks of each term that give the first bound of the k-th score.
FIRST_BLOCKS = 4


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(docs: DataFrame, path: str, *, key: str, text: str, chunk: int = CHUNK) -> None:
    """Adds the documents to the index in the folder ``path``, which is made if there is none."""
    words = index_tokens(F.coalesce(F.col(text), F.lit("")))
    batch = uuid.uuid4().hex
    read = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), words.alias("words"))
    read = read.select("key", "words", F.size("words").alias("dl"), F.floor(F.monotonically_increasing_id() / chunk).alias("chunk"))
    with Scratch(docs.sparkSession) as scratch:
        # texts are read once, and a document's words are counted where it stands: no word is shuffled but as a posting
        read = scratch.cut(read.select("key", "dl", "chunk", term_counts(F.col("words")).alias("counts")))
        read.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_words"), F.lit(docs.schema[key].dataType.simpleString()).alias("kind")).write.mode("append").parquet(f"{path}/sizes")
        _write_blocks(read.select("key", "dl", "chunk", F.explode("counts").alias("c")).select("key", "dl", "chunk", "c.*"), path, batch)


def term_counts(words: Column) -> Column:
    """(term, tf) of each distinct word of an array, by the places where runs begin in its sorted order."""

    def counts(s: Column) -> Column:
        begins = F.array_compact(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)))
        run = lambda b: F.transform(b, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).cast("long").alias("tf")))
        return held(begins, run)

    return held(F.sort_array(words), counts)


def _write_blocks(counted: DataFrame, path: str, batch: str) -> None:
    blocks = counted.groupBy("term", "chunk").agg(
        F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("shortest"), F.collect_list(F.struct("key", "tf", "dl")).alias("postings")
    )
    blocks = blocks.withColumns({"bucket": bucket_of(F.col("term")), "batch": F.lit(batch)})
    dealt = blocks.repartition("bucket", F.pmod("chunk", F.lit(8))).sortWithinPartitions("bucket", "term")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")


def _blocks(spark: SparkSession, path: str, asked: Sequence[str]) -> DataFrame:
    """The blocks of the terms; only their buckets are read."""
    terms = F.array(*map(F.lit, asked))
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.transform(terms, bucket_of))).distinct().collect()]
    return spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(buckets) & F.col("term").isin(list(asked)))


def _gain(idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(spark: SparkSession, path: str, query: Sequence[str], *, k: int | None = None) -> DataFrame:
    """(key, score) by BM25 of the documents that hold a term of the query, as ``bm25`` over the texts gives them; with ``k`` the best ones by score, then key."""
    asked = sorted(set(query))
    sizes = spark.read.parquet(f"{path}/sizes").agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words"), F.max("kind").alias("kind")).first()
    if not asked or not sizes["n"] or not sizes["words"]:
        return spark.createDataFrame([], f"key {sizes['kind']}, score double")
    n_docs, avgdl = sizes["n"], sizes["words"] / sizes["n"]
    blocks = _blocks(spark, path, asked)
    known = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each term of the query

    def idf(term: str) -> Column:
        n, df = F.lit(n_docs), F.lit(known[term])
        value = F.log((n - df + 0.5) / (df + 0.5))
        return F.when(value <= 0, 1e-6).otherwise(value)

    def scored(some: DataFrame, exact: bool = True) -> DataFrame:
        rows = some.select("term", F.explode("postings").alias("p")).select("term", "p.*")
        counts = rows.groupBy("key").agg(F.first("dl").alias("dl"), *(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(asked)))
        total = F.lit(0.0)
        for i, t in enumerate(asked):
            if t in known:
                total = total + F.coalesce(_gain(idf(t), F.col(f"tf_{i}"), F.col("dl"), avgdl), F.lit(0.0))
        return counts.select("key", (F.round(total, 6) if exact else total).alias("score"))

    if k is None or not known:
        return scored(blocks)
    bound = F.coalesce(*(F.when(F.col("term") == t, _gain(idf(t), F.col("most"), F.col("shortest"), avgdl)) for t in known))
    bounds = cut(blocks.select("term", "batch", "chunk", bound.alias("bound")))
    best = {r["term"]: r["most"] for r in bounds.groupBy("term").agg(F.max("bound").alias("most")).collect()}
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("bound"), "batch", "chunk"))
    first = bounds.withColumn("place", place).where(F.col("place") <= FIRST_BLOCKS).select("term", "batch", "chunk")
    least = scored(blocks.join(F.broadcast(first), ["term", "batch", "chunk"], "left_semi"), exact=False).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    if least["n"] == k:  # what is there so far bounds the k-th score from below
        rest = F.coalesce(*(F.when(F.col("term") == t, F.lit(sum(b for s, b in best.items() if s != t))) for t in best))
        blocks = blocks.where(bound + rest >= least["score"] - 1e-5)
    return scored(blocks).orderBy(F.desc("score"), "key").limit(k)
