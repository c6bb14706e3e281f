"""Records put together for reading: cards, lookups, snippets, summaries, and rankings over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import dirname
from tessera.operators.events import top_per


def listed(rows: DataFrame, key: str, value: str, *, order: Sequence[str], limit: int) -> DataFrame:
    """The first values of each key, joined by commas."""
    cols = [F.col(o) for o in order]
    few = top_per(rows, key, cols, limit)
    return few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), ",").alias(f"{value}_list"))


def brief(files: DataFrame, links: DataFrame, *, neighbours: int = 5) -> DataFrame:
    """A card for each file: how many of its fields hold something, and some of what it imports and is imported by (src, dst)."""
    fields = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1).otherwise(0) for c in ("purpose", "blurb", "cluster")] + [F.when(F.size(c) > 0, 1).otherwise(0) for c in ("tags", "patterns", "hazards")]
    out = listed(links, "src", "dst", order=["dst"], limit=neighbours).withColumnRenamed("src", "id").withColumnRenamed("dst_list", "imports")
    into = listed(links, "dst", "src", order=["src"], limit=neighbours).withColumnRenamed("dst", "id").withColumnRenamed("src_list", "imported_by")
    cards = files.select("id", "file_path", sum(fields, F.lit(0)).alias("coverage"))
    return cards.join(out, "id", "left").join(into, "id", "left").fillna("", ["imports", "imported_by"])


def lookup(entries: DataFrame, *, changes: int = 5) -> DataFrame:
    """Each file with its number of entries and its last few, newest first."""
    w = Window.partitionBy("file_path").orderBy(F.desc("created_at"), F.desc("id"))
    last = entries.withColumn("n", F.row_number().over(w))
    few = F.array_sort(F.collect_list(F.when(F.col("n") <= changes, F.struct("n", F.col("id").cast("string").alias("v")))))
    return last.groupBy("file_path").agg(F.count("*").alias("entries"), F.array_join(F.transform(few, lambda s: s["v"]), ",").alias("recent"))


def snippet(files: DataFrame, start: int, lines: int = 81) -> DataFrame:
    """Some lines of each file from a given one on; no row for files that end before."""
    own = F.split("content", "\n")
    return files.where(F.size(own) >= start).select("id", F.array_join(F.slice(own, start, lines), "\n").alias("snippet"))


def matches_with_context(files: DataFrame, word: str, *, around: int = 2) -> DataFrame:
    """(id, line, text) of lines that hold a word and of those around them, each once; the lines are an array of the row, so nothing is joined."""
    rows = files.select("id", F.split("content", "\n").alias("lines"))
    hit = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.contains(F.get("lines", i), F.lit(word)))
    near = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.filter(F.sequence(i - around, i + around), lambda j: (j >= 0) & (j < F.size("lines"))))))
    return rows.where(F.size(hit) > 0).select("id", "lines", F.explode(near).alias("at")).select("id", (F.col("at") + 1).alias("line"), F.get("lines", F.col("at")).alias("text"))


def usage_marks(links: DataFrame, *, share: float = 0.75) -> DataFrame:
    """Usage of all edges at each node (an edge to itself counts twice), and whether it reaches a share of the greatest."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node"), "usage").groupBy("node").agg(F.sum("usage").alias("usage"))
    most = ends.agg(F.max("usage").alias("most"))
    return ends.join(F.broadcast(most)).select("node", "usage", (F.col("usage") >= share * F.col("most")).alias("heavy"))


def cluster_summary(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files and incident edges of each cluster; edges within count at both ends, files without a cluster as uncategorized."""
    named = files.select(F.col("id").alias("node"), F.coalesce("cluster", F.lit("uncategorized")).alias("cluster"))
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).join(named, "node").groupBy("cluster").agg(F.count("*").alias("edges"))
    return named.groupBy("cluster").agg(F.count("*").alias("files")).join(ends, "cluster", "left").fillna(0, ["edges"])


def dominant_directory(files: DataFrame, group: str) -> DataFrame:
    """The most frequent directory of each group; of equals the first by name."""
    counts = files.groupBy(group, dirname(F.col("file_path")).alias("directory")).agg(F.count("*").alias("n"))
    return top_per(counts, group, [F.desc("n"), F.col("directory")], 1).select(group, "directory", "n")


def bucket_tools(rows: DataFrame, key: str, value: str, *, limit: int = 5) -> DataFrame:
    """The most frequent values of each key as ``value xN``."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    few = top_per(counts, key, [F.desc("n"), F.col(value)], limit)
    text = F.concat(F.col(value), F.lit(" x"), F.col("n"))
    return few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]), ", ").alias("summary"))


def demoted(events: DataFrame, session: str, order: str, size: str, *, budget: int, small: int) -> DataFrame:
    """full or short for each event: the oldest are shortened to ``small`` until the session's sizes fit a budget.

    Running sums of what shortening saves say where to stop; what is small already saves nothing and stays.
    """
    saves = F.greatest(F.col(size) - small, F.lit(0))
    w = Window.partitionBy(session)
    earlier = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = F.sum(size).over(w) - budget
    short = (saves > 0) & (F.coalesce(F.sum(saves).over(earlier), F.lit(0)) < over)
    return events.withColumn("level", F.when(short, "short").otherwise("full"))


def expanded_targets(targets: DataFrame, links: DataFrame) -> DataFrame:
    """Targets (node) with what they import and what imports them, one step."""
    out = links.join(targets.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    into = links.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return targets.select("node").union(out).union(into).distinct()


def stale_dependents(files: DataFrame, changed: DataFrame, links: DataFrame) -> DataFrame:
    """``files`` with a mark on those that import a changed one (node)."""
    hit = links.join(changed.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(True))
    return files.join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("crossrefs_stale"))


def update_richer(target: DataFrame, source: DataFrame, key: str, text: str) -> DataFrame:
    """The target with a text column taken from the source where the source's is longer."""
    new = source.select(key, F.col(text).alias("_new"))
    longer = F.length(F.coalesce("_new", F.lit(""))) > F.length(F.coalesce(text, F.lit("")))
    return target.join(new, key, "left").withColumn(text, F.when(longer, F.col("_new")).otherwise(F.col(text))).drop("_new").select(*target.columns)


def hydrate(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def crossref_ratio(files: DataFrame, total: Column) -> DataFrame:
    """Share of files with cross-references, and whether it is suspiciously low."""
    out = files.agg(F.count("*").alias("files"), F.count(F.when(total > 0, 1)).alias("with_references"))
    ratio = F.round(F.col("with_references") / F.greatest(F.col("files"), F.lit(1)), 6)
    return out.select("files", "with_references", ratio.alias("ratio"), (ratio < 0.1).alias("warn"))


def similar(files: DataFrame, seed: int, scored: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Scores (id, score) scaled to the best, without the seed, of at least ``least``."""
    rest = scored.where(F.col("id") != seed)
    top = rest.agg(F.max("score").alias("top"))
    return rest.join(F.broadcast(top)).withColumn("score", F.round(F.col("score") / F.col("top"), 6)).where(F.col("score") >= least).select("id", "score").join(files.select("id", "file_path"), "id")


def todo_order(rows: DataFrame) -> DataFrame:
    """Rows with a place by state: in progress, pending, completed, other; stable within."""
    state = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "completed", 2).otherwise(3)
    w = Window.partitionBy("session_id").orderBy(state, "pos")
    return rows.withColumn("place", F.row_number().over(w))


def file_context(events: DataFrame) -> DataFrame:
    """Per session and path: touches, the last one, and what it was."""
    return events.groupBy("session_id", "file_path").agg(F.count("*").alias("touches"), F.max("ts").alias("last_ts"), F.max_by("kind", F.struct("ts", "id")).alias("last_kind"))


def kept_candidates(rows: DataFrame, now: int, *, days: int = 30) -> DataFrame:
    """Candidates that are promoted or were seen within some days, the most frequent first."""
    fresh = F.col("promoted") | (F.col("last_ts") >= now - days * 86_400_000)
    return rows.where(fresh).orderBy(F.desc("occurrences"), F.desc("last_ts"), "key")
