"""Retrieval: BM25, nearest vectors, rank fusion and what is built from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import index_tokens, normalize, tokens
from tessera.sources.shared import cut

K1, B = 1.2, 0.75
SILOS = ("transcripts", "atlas_files", "atlas_changelog", "source_highlights")

# For each scope, the silos it searches and whether it is bound to the identity, the session and the project.
SCOPES = {
    "self": (("transcripts",), True, False, False),
    "session": (("transcripts",), False, True, False),
    "workspace": (SILOS, False, False, True),
    "identity": (SILOS, True, False, False),
    "atlas": (("atlas_files", "atlas_changelog", "source_highlights"), False, False, False),
    "transcripts": (("transcripts",), False, False, False),
    "all": (SILOS, False, False, False),
}


def resolve_scope(scope: str, silos: Sequence[str] | None = None) -> tuple[list[str], bool, bool, bool]:
    """(silos in their order, by identity, by session, by project); ``silos`` narrows the first, and none narrows nothing."""
    own, *flags = SCOPES[scope]
    return [s for s in own if not silos or s in silos], *flags


def in_scope(scope: str, *, identity=None, session=None, project=None, workspace=None, silos: Sequence[str] | None = None) -> Column:
    """Whether a row (silo, identity_name, session_id, project, workspace) is searched in a scope.

    Transcripts are bound by the scope's flags, the other silos by the workspace alone; what isn't given (None) binds nothing.
    A null in a column that binds is outside.
    """
    own, *flags = resolve_scope(scope, silos)
    inside = F.lit(True)
    for column, value, bound in zip(("identity_name", "session_id", "project"), (identity, session, project), flags):
        if bound and value is not None:
            inside &= F.col(column).eqNullSafe(value)
    there = F.lit(True) if workspace is None else F.col("workspace").eqNullSafe(workspace)
    return F.coalesce(F.col("silo").isin(*own), F.lit(False)) & F.when(F.col("silo") == "transcripts", inside).otherwise(there) if own else F.lit(False)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the inverted index."""
    terms = docs.select(key, F.explode(index_tokens(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: Sequence[str], *, key: str, text: str) -> DataFrame:
    """(key, score) of documents that hold a term of the query; higher is better.

    Sizes and frequencies are of the whole table. The texts are read once: of each document its length and the
    number of each of the query's terms are written, a few numbers a row, for the statistics and the scores.
    """
    words = index_tokens(F.coalesce(F.col(text), F.lit("")))
    asked = sorted(set(query))
    times = lambda q: F.size("words") - F.size(F.array_remove("words", q))
    counted = docs.select(key, words.alias("words")).select(key, F.size("words").alias("dl"), *(times(q).alias(f"tf_{i}") for i, q in enumerate(asked)))
    counted = cut(counted)
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(asked))))
    found = counted.where(" or ".join(f"tf_{i} > 0" for i in range(len(asked))) or "false").join(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        n, df, tf = F.col("n_docs"), F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        return F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    total = F.lit(0.0)
    for i in range(len(asked)):
        total = total + part(i)
    return found.select(key, F.round(total, 6).alias("score"))


def ranked(scored: DataFrame, key: str, *, score: str = "score", limit: int = 50, ascending: bool = False) -> DataFrame:
    """The best rows with their rank from 1. The cut is a distributed top-k; only what it keeps is numbered."""
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(key).asc()]
    best = scored.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def keyword_matches(docs: DataFrame, words: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that hold any of the words in any of the columns, whatever the case."""
    condition = F.lit(False)
    for c in columns:
        for w in words:
            condition = condition | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w.lower()))
    return docs.where(condition)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` names it and within whatever lambda."""
    return F.transform(F.array(value), use)[0]


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    scaled = lambda s: F.transform(s["v"], lambda x: F.when(s["norm"] > 0, x.cast("double") / s["norm"]).otherwise(x.cast("double")))
    return held(v, lambda v: held(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm")), scaled))


def nearest(vectors: DataFrame, query: Sequence[float], *, key: str, vector: str, k: int, where: Column | None = None, prefilter: bool = True, oversample: int = 1) -> DataFrame:
    """The k nearest by Euclidean distance, with ranks. A filter applies before the cut, or (``prefilter`` off) after it."""
    rows = vectors if where is None or not prefilter else vectors.where(where)
    asked = F.array(*(F.lit(float(x)) for x in query))
    best = rows.withColumn("distance", F.round(l2_distance(F.col(vector), asked), 6)).orderBy("distance", key).limit(k * oversample)
    if where is not None and not prefilter:
        best = best.where(where)
    w = Window.partitionBy(F.lit(0)).orderBy("distance", key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "distance", "rank")


def fuse(lists: Sequence[tuple[DataFrame, str, float]], key: str, *, k: int = 60, limit: int | None = None, scale: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (rows of key and rank, name, weight): the score, and each list's rank.

    A row repeated in a list counts at its best rank. ``scale`` makes the best score 1.
    """
    both = None
    for df, name, weight in lists:
        one = df.groupBy(key).agg(F.min("rank").alias("rank")).select(key, F.lit(name).alias("list"), "rank", F.lit(weight).alias("weight"))
        both = one if both is None else both.unionByName(one)
    out = both.groupBy(key).agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"),
        *(F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for _, name, _ in lists),
    )
    if limit is not None:
        out = out.orderBy(F.desc("score"), key).limit(limit)
    if scale:
        top = out.agg(F.max("score").alias("top"))
        out = out.join(F.broadcast(top)).withColumn("score", F.round(F.col("score") / F.col("top"), 6)).drop("top")
    return out


def fuse_silos(hits: DataFrame, *, k: int = 20, rrf_k: int = 60) -> DataFrame:
    """Hits (silo, id, rank) of all silos into one list: ids of different silos stay apart; the best is 1 after the cut."""
    scored = hits.groupBy("silo", "id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("raw"))
    best = scored.orderBy(F.desc("raw"), "silo", "id").limit(k)
    top = best.agg(F.max("raw").alias("top"))
    return best.join(F.broadcast(top)).select("silo", "id", F.round(F.col("raw") / F.col("top"), 6).alias("score"))


def silo_breakdown(spark, hits: DataFrame) -> DataFrame:
    """Candidates of each silo, zero for those without."""
    names = spark.createDataFrame([(s,) for s in SILOS], "silo string")
    return names.join(hits.groupBy("silo").agg(F.count("*").alias("n")), "silo", "left").select("silo", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def concentration(hits: DataFrame, column: str) -> DataFrame:
    """The value that at least max(2, 60 %) of the hits share, if there is one."""
    counts = hits.groupBy(column).agg(F.count("*").alias("n"))
    total = hits.agg(F.count("*").alias("total"))
    out = counts.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(0.6 * F.col("total"))))
    return out.orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("value"), "n", "total")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed term counts in hashed slots, at length 1."""
    words = tokens(normalize(text))
    signs = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int") * 2 + F.pmod(F.crc32(w.cast("binary")), F.lit(2)).cast("int"))
    # what is left without a slot's terms of one sign says how many there are
    left = lambda s, code: F.size(F.array_remove(s, code))
    slots = lambda s: F.array(*(left(s, 2 * i + 1) - left(s, 2 * i) for i in range(size)))
    return held(held(signs, slots), lambda v: normalized(v.cast("array<double>")))


def embedding_text(parts: Sequence[Column]) -> Column:
    """What is embedded of a record: its non-blank parts, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


def stale_embeddings(rows: DataFrame, hashes: DataFrame, *, key: str, text: str) -> DataFrame:
    """Rows whose text's hash isn't the one that was embedded."""
    now = rows.withColumn("text_hash", F.sha2(text, 256))
    old = hashes.select(key, F.col("text_hash").alias("old_hash"))
    return now.join(old, key, "left").where(~F.col("text_hash").eqNullSafe(F.col("old_hash"))).select(key, "text_hash")


def backlog(rows: DataFrame, *, key: str, budget: int = 200) -> DataFrame:
    """The newest rows without a vector, within a budget."""
    return rows.where("not has_vector").orderBy(F.desc("ts"), key).limit(budget)
