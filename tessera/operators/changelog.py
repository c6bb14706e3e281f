"""Changelog: filters, grouping, timelines and as-of lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import monday_week

MOST = 2000
GROUPS = ("file_path", "cluster", "author_name", "author_instance_id", "verification_status", "source", "commit_sha")


def predicates(*, prefix: str | None = None, since=None, until=None, breaking: bool | None = None, **equal) -> list[Column]:
    found = [F.col(c) == v for c, v in equal.items() if v is not None]
    if prefix is not None:
        found.append(F.col("file_path").startswith(prefix))
    if since is not None:
        found.append(F.col("created_at") >= since)
    if until is not None:
        found.append(F.col("created_at") <= until)
    if breaking is not None:
        found.append(F.col("breaking_changes") == breaking)
    return found


def query(entries: DataFrame, *, order: str = "desc", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Entries that match all filters, by time; at most MOST."""
    found = predicates(**filters)
    out = entries.where(reduce(and_, found)) if found else entries
    way = F.desc if order == "desc" else F.asc
    return out.orderBy(way("created_at"), way("id")).offset(offset).limit(max(1, min(limit, MOST)))


def span(entries: DataFrame, **filters) -> DataFrame:
    found = predicates(**filters)
    out = entries.where(reduce(and_, found)) if found else entries
    return out.agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def group(entries: DataFrame, by: str, *, limit: int = MOST) -> DataFrame:
    """Count and span of each value; entries without one are grouped as ``(none)``. No rows for an unknown column."""
    if by not in GROUPS or by not in entries.columns:
        return entries.limit(0).select(F.lit("").alias("key"), F.lit(0).cast("long").alias("n"), F.col("created_at").alias("first_at"), F.col("created_at").alias("last_at"))
    out = entries.groupBy(by).agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    out = out.orderBy(F.desc("n"), F.asc_nulls_first(by)).limit(limit)
    return out.select(F.coalesce(by, F.lit("(none)")).alias("key"), "n", "first_at", "last_at")


def group_count(entries: DataFrame, by: str) -> DataFrame:
    """How many groups there are, entries without a value being one."""
    return entries.groupBy(by).count().agg(F.count("*").alias("groups"))


def timeline(entries: DataFrame, bucket: str) -> DataFrame:
    """Entries, files, authors and breaking changes for each day, week or month."""
    at = F.col("created_at")
    key = {"day": F.date_format(at, "yyyy-MM-dd"), "week": monday_week(at), "month": F.date_format(at, "yyyy-MM")}[bucket]
    return entries.groupBy(key.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.countDistinct("file_path").alias("files"),
        F.countDistinct(F.coalesce("author_name", "author_instance_id")).alias("authors"),
        F.sum(F.col("breaking_changes").cast("long")).alias("breaking"),
    )


def as_of(entries: DataFrame, moment) -> DataFrame:
    """The last entry of each file at a moment."""
    order = Window.partitionBy("file_path").orderBy(F.desc("created_at"), F.desc("id"))
    return entries.where(F.col("created_at") <= moment).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def previous(entries: DataFrame) -> DataFrame:
    """Each entry with the one before it on the same file."""
    order = Window.partitionBy("file_path").orderBy("created_at", "id")
    return entries.select("id", "file_path", "created_at", F.lag("id").over(order).alias("previous_id"), F.lag("created_at").over(order).alias("previous_at"))


def latest(entries: DataFrame, n: int) -> DataFrame:
    """The last n entries of each file, newest first."""
    order = Window.partitionBy("file_path").orderBy(F.desc("created_at"), F.desc("id"))
    return entries.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def nearest_snapshots(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each entry with the last snapshot of its file at or before it: a sorted union, not a range join."""
    marks = entries.select("file_path", F.col("created_at").alias("at"), F.lit(1).alias("side"), "id", F.lit(None).cast("long").alias("snapshot_id"))
    shots = snapshots.select("file_path", F.col("created_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), "snapshot_id")
    order = Window.partitionBy("file_path").orderBy("at", "side", "snapshot_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(shots).withColumn("found", F.last("snapshot_id", ignorenulls=True).over(order))
    return both.where("side = 1").select("id", "file_path", F.col("found").alias("snapshot_id"))


def churn(entries: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Entries and breaking ones for each file; ``cap`` looks at the newest entries only."""
    some = entries if cap is None else entries.orderBy(F.desc("created_at"), F.desc("id")).limit(cap)
    return some.groupBy("file_path").agg(F.count("*").alias("churn"), F.sum(F.col("breaking_changes").cast("long")).alias("breaking"))


def pending(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries without a commit on some files."""
    return entries.where("commit_sha is null").join(paths.select("file_path").distinct(), "file_path", "left_semi")


def verify_last(entries: DataFrame, file_path: str, n: int, status: str) -> DataFrame:
    """The table after the last n (1 to 50) entries of a file got a status; only that file's entries are sorted."""
    if status not in ("verified", "needs_review", "pending"):
        raise ValueError(status)
    own = entries.where(F.col("file_path") == file_path).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(n, 50)))
    hit = own.select("file_path", "id").distinct().withColumn("hit", F.lit(True))
    out = entries.join(F.broadcast(hit), ["file_path", "id"], "left")  # at most 50 rows
    return out.withColumn("verification_status", F.when(F.col("hit"), status).otherwise(F.col("verification_status"))).select(*entries.columns)


def stamp(entries: DataFrame, ids: DataFrame, sha: str) -> DataFrame:
    """The table after some entries without a commit got one."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    out = entries.join(hit, "id", "left")
    return out.withColumn("commit_sha", F.when(F.col("hit") & F.col("commit_sha").isNull(), sha).otherwise(F.col("commit_sha"))).drop("hit").select(*entries.columns)


def backfill_authors(entries: DataFrame, authors: DataFrame) -> DataFrame:
    """The table with blank author fields filled by id; what is there stays."""
    new = authors.select("id", F.col("author_name").alias("new_name"))
    blank = F.trim(F.coalesce("author_name", F.lit(""))) == ""
    out = entries.join(new, "id", "left").withColumn("author_name", F.when(blank, F.coalesce("new_name", "author_name")).otherwise(F.col("author_name")))
    return out.select(*entries.columns)


def status_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("verification_status").agg(F.count("*").alias("n"))
