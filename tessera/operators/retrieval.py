"""Composed retrieval: ranked lists of one or several workspaces fused, filtered and joined to their records.

Ranked lists are (key, rank) with ranks from 1, already cut to some candidates, so what is fused here is bounded
by the candidates asked for; the records are joined by key afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.search import fuse, l2_distance

#: The constant of rank fusion, the score of a substring hit.
RRF, FALLBACK = 60, 0.6


def clamped(limit: int, times: int, least: int, most: int) -> int:
    """How many candidates to fetch for a limit."""
    return min(most, max(times * limit, least))


def nearest_with_ties(vectors: DataFrame, asked: Sequence[float], *, vector: str, k: int, ties: Sequence[Column]) -> DataFrame:
    """The k nearest by Euclidean distance as rows with ``distance`` and ``rank``, ties by the given order."""
    query = F.array(*(F.lit(float(x)) for x in asked))
    best = vectors.withColumn("distance", F.round(l2_distance(F.col(vector), query), 6)).orderBy("distance", *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", *ties)))  # k rows


def hydrated(hits: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records of the hits, in no order; hits without a record go."""
    return F.broadcast(hits).join(records, key)


def fused_records(lists: Sequence[tuple[DataFrame, str, float]], records: DataFrame, *, key: str, keep: Column, limit: int, ties: Sequence[Column]) -> DataFrame:
    """Fusion without normalisation, then the filter on the records, then the limit."""
    fused = fuse(lists, key, k=RRF).select(key, "score")
    return hydrated(fused, records, key).where(keep).orderBy(F.desc("score"), *ties).limit(limit)


def fused_seeds(lists: Sequence[DataFrame], *, limit: int) -> DataFrame:
    """(file_path, score): lists of (file_path, rank) fused on paths with forward slashes, ties by path."""
    every = lists[0].select("file_path", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("file_path", "rank"))
    plain = every.withColumn("file_path", F.replace("file_path", F.lit("\\"), F.lit("/")))
    return plain.groupBy("file_path").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), "file_path").limit(limit)


def fallback_seeds(files: DataFrame, task: str, *, limit: int) -> DataFrame:
    """(file_path, score): files whose path, texts, patterns or hazards hold the whole task, whatever the case."""
    parts = [F.col(c) for c in ("file_path", "purpose", "blurb")] + [F.array_join(c, " ") for c in ("patterns", "hazards")]
    found = files.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(task.lower())))
    return found.select("file_path", F.lit(FALLBACK).alias("score")).orderBy("file_path").limit(limit)


def best_chunk_per_file(chunks: DataFrame) -> DataFrame:
    """Of ranked chunks (file_path, chunk, rank), the best of each file, ranked anew."""
    best = chunks.groupBy("file_path").agg(F.min(F.struct("rank", "chunk")).alias("b")).select("file_path", "b.chunk", F.col("b.rank").alias("was"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("was"))).drop("was")  # no more rows than candidates


def three_way(bm25: DataFrame, chunks: DataFrame, files: DataFrame, *, limit: int) -> DataFrame:
    """(file_path, score, chunk): BM25 fused with the fusion of the nearest chunks and nearest files; the best score is 1.

    ``bm25`` and ``files`` are (file_path, rank), ``chunks`` (file_path, chunk, rank).
    """
    own = best_chunk_per_file(chunks)
    vector = fuse([(own.select("file_path", "rank"), "chunk", 1.0), (files, "file", 1.0)], "file_path", k=RRF)
    vector = vector.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_path"))).select("file_path", "rank")
    both = fuse([(bm25, "text", 1.0), (vector, "vector", 1.0)], "file_path", k=RRF).orderBy(F.desc("score"), "file_path").limit(limit)
    top = both.agg(F.max("score").alias("top"))  # one row
    scored = both.join(F.broadcast(top)).select("file_path", F.round(F.col("score") / F.col("top"), 4).alias("score"))
    return scored.join(own.select("file_path", "chunk"), "file_path", "left")


def across_workspaces(hits: DataFrame, order: Sequence[str], *, limit: int) -> DataFrame:
    """(workspace, file_path, score): each workspace's list (workspace, file_path, score, rank) put one after another; a hit adds 1 / (60 + its place)."""
    number = F.array_position(F.lit(list(order)), F.col("workspace"))
    placed = hits.where(F.col("workspace").isin(*order)).withColumn("place", F.row_number().over(Window.orderBy(number, "rank")))  # candidates only
    return placed.select("workspace", "file_path", F.round(F.col("score") + 1.0 / (RRF + F.col("place")), 9).alias("score")).orderBy(F.desc("score"), "workspace", "file_path").limit(limit)


def evidence(files: DataFrame, entries: DataFrame, *, files_most: int = 10, entries_most: int = 20) -> DataFrame:
    """(silo, id, rank): what a question is answered from: the first files and the first changelog entries."""
    first = lambda hits, silo, most: hits.where(F.col("rank") <= most).select(F.lit(silo).alias("silo"), F.col("id").cast("string").alias("id"), "rank")
    return first(files, "atlas_files", files_most).unionByName(first(entries, "atlas_changelog", entries_most))


def transcript_scope(chunks: DataFrame, *, scope: str = "workspace", identity: str | None = None, session: str | None = None, sessions: Sequence[str] | None = None, folder: str | None = None) -> DataFrame:
    """Chunks of an identity, of one or some sessions, and, in workspace scope only, of a working folder."""
    for column, value in (("identity_name", identity), ("session_id", session), ("cwd", folder if scope == "workspace" else None)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    return chunks if sessions is None else chunks.where(F.col("session_id").isin(*sessions))
