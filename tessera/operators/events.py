"""Analytics over identity-to-file events: open hazards, counts, signatures, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import dirname
from tessera.sources.tables import KINDS

HAZARD_KEY = ["identity_name", "workspace", "file_path", "detail"]


def filter_events(edges: DataFrame, *, identity=None, workspace=None, file_path=None, kind=None, session=None, since: int | None = None, until: int | None = None, limit: int | None = 100) -> DataFrame:
    """Events that match all that is given, newest first."""
    equal = {"identity_name": identity, "workspace": workspace, "file_path": file_path, "kind": kind, "session_id": session}
    for column, value in equal.items():
        if value is not None:
            edges = edges.where(F.col(column) == value)
    if since is not None:
        edges = edges.where(F.col("ts") >= since)
    if until is not None:
        edges = edges.where(F.col("ts") <= until)
    out = edges.orderBy(F.desc("ts"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def open_hazards(edges: DataFrame) -> DataFrame:
    """Surfaced hazards that nothing later resolves; a hazard without detail is never resolved.

    One pass over the events: the last resolution of a key is later than a hazard or not. Keys are
    pre-aggregated, so a hot key costs one row on the resolved side.
    """
    last = edges.where("kind = 'resolved' and detail is not null").groupBy(*HAZARD_KEY).agg(F.max("ts").alias("resolved_at"))
    surfaced = edges.where("kind = 'surfaced'").join(last, HAZARD_KEY, "left")
    return surfaced.where("resolved_at is null or resolved_at <= ts").drop("resolved_at").select(*edges.columns)


def resolve_times(edges: DataFrame) -> DataFrame:
    """Each surfaced hazard with the first later resolution of its key, and the time between."""
    w = Window.partitionBy(*HAZARD_KEY).orderBy("ts").rangeBetween(1, Window.unboundedFollowing)
    after = F.min(F.when(F.col("kind") == "resolved", F.col("ts"))).over(w)
    found = edges.where("kind in ('surfaced', 'resolved') and detail is not null").withColumn("resolved_at", after)
    return found.where("kind = 'surfaced' and resolved_at is not null").select("id", *HAZARD_KEY, "ts", "resolved_at", (F.col("resolved_at") - F.col("ts")).alias("took_ms"))


def count_by_kind(edges: DataFrame) -> DataFrame:
    """One column for each kind, zero where an identity has none."""
    return edges.groupBy("identity_name").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS))


def top_files(edges: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Files by number of events other than lookups, then by the last one."""
    out = edges.where("kind <> 'lookup'").groupBy("identity_name", "file_path").agg(F.count("*").alias("edge_count"), F.max("ts").alias("last_ts"))
    return out if limit is None else top_per(out, "identity_name", [F.desc("edge_count"), F.desc("last_ts"), F.col("file_path")], limit)


def recent_files(edges: DataFrame, *, limit: int) -> DataFrame:
    out = edges.groupBy("identity_name", "file_path").agg(F.count("*").alias("touches"), F.max("ts").alias("last_ts"))
    return top_per(out, "identity_name", [F.desc("last_ts"), F.col("file_path")], limit)


def top_per(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows of each key, with their rank."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def lineage(edges: DataFrame, file_path: str) -> DataFrame:
    """Per identity that touched a file: events, first and last, commits, and what it did in order."""
    return (
        edges.where(F.col("file_path") == file_path)
        .groupBy("identity_name")
        .agg(
            F.count("*").alias("edge_count"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.sum((F.col("kind") == "commit").cast("long")).alias("commits"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "kind"))), lambda s: s["kind"]), ",").alias("kinds"),
        )
    )


def when_did(edges: DataFrame, what: str, detail: str, *, limit: int = 100, strict: bool = False) -> DataFrame:
    """First events of a kind of thing: hazards and patterns by exact detail, commits by part of it or without detail."""
    kinds = {"hazard": ("surfaced", "resolved"), "pattern": ("pattern_added", "pattern_removed"), "commit": ("commit",)}[what]
    named = F.col("detail").contains(detail) if what == "commit" else F.col("detail") == detail
    if what == "commit" and not strict:
        named = named | F.col("detail").isNull()
    return edges.where(F.col("kind").isin(*kinds) & named).orderBy("ts", "id").limit(limit)


def hazard_diff(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Hazards of two identities by detail and workspace: how often each surfaced them, and resolved those it surfaced."""
    own = edges.where(F.col("identity_name").isin(a, b) & F.col("kind").isin("surfaced", "resolved") & F.col("detail").isNotNull())
    n = lambda who, kind: F.sum(((F.col("identity_name") == who) & (F.col("kind") == kind)).cast("long"))
    out = own.groupBy("detail", "workspace").agg(n(a, "surfaced").alias("a_surfaced"), n(b, "surfaced").alias("b_surfaced"), n(a, "resolved").alias("ra"), n(b, "resolved").alias("rb"))
    out = out.where("a_surfaced > 0 or b_surfaced > 0")
    kept = lambda s, r: F.when(F.col(s) > 0, F.col(r)).otherwise(F.lit(0))
    return out.select("detail", "workspace", "a_surfaced", "b_surfaced", kept("a_surfaced", "ra").alias("a_resolved"), kept("b_surfaced", "rb").alias("b_resolved"))


def file_diff(edges: DataFrame, a: str, b: str, *, cap: int | None = None) -> DataFrame:
    """Files of two identities, each in one of the buckets shared, only_a and only_b; ``cap`` cuts each side first."""
    side = lambda who: top_files(edges.where(F.col("identity_name") == who), limit=cap).select("file_path", F.col("edge_count"))
    left, right = side(a).withColumnRenamed("edge_count", "a_count"), side(b).withColumnRenamed("edge_count", "b_count")
    bucket = F.when(F.col("b_count").isNull(), "only_a").when(F.col("a_count").isNull(), "only_b").otherwise("shared")
    return left.join(right, "file_path", "full").select("file_path", "a_count", "b_count", bucket.alias("bucket"))


def pattern_overlap(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct patterns of two identities: shared, only_a or only_b."""
    own = edges.where(F.col("identity_name").isin(a, b) & F.col("kind").isin("pattern_added", "pattern_removed") & F.col("detail").isNotNull())
    has = lambda who: F.max((F.col("identity_name") == who).cast("int"))
    out = own.groupBy("detail").agg(has(a).alias("a"), has(b).alias("b"))
    return out.select("detail", F.when(F.col("a") + F.col("b") == 2, "shared").when(F.col("a") == 1, "only_a").otherwise("only_b").alias("bucket"))


def directory_rollup(edges: DataFrame, *, files: int = 50, directories: int = 15) -> DataFrame:
    """The directories of an identity's most touched files."""
    top = top_files(edges, limit=files).withColumn("directory", dirname(F.col("file_path")))
    out = top.groupBy("identity_name", "directory").agg(F.sum("edge_count").alias("edge_count"), F.count("*").alias("files"))
    return top_per(out, "identity_name", [F.desc("edge_count"), F.col("directory")], directories)


def pattern_rollup(edges: DataFrame, *, patterns: int = 20) -> DataFrame:
    out = edges.where("kind in ('pattern_added', 'pattern_removed') and detail is not null").groupBy("identity_name", "detail").agg(F.count("*").alias("n"))
    return top_per(out, "identity_name", [F.desc("n"), F.col("detail")], patterns)


def signature(edges: DataFrame) -> DataFrame:
    """Per identity: hazards surfaced and resolved, and the mean time to resolve."""
    counts = edges.groupBy("identity_name").agg(
        F.count(F.when(F.col("kind") == "surfaced", 1)).alias("hazards_surfaced"),
        F.count(F.when(F.col("kind") == "resolved", 1)).alias("hazards_resolved"),
        F.countDistinct("file_path").alias("files"),
    )
    mean = resolve_times(edges).groupBy("identity_name").agg(F.floor(F.avg("took_ms") + 0.5).cast("long").alias("mean_resolve_ms"))
    return counts.join(mean, "identity_name", "left")


def scaled(value: Column, window) -> Column:
    """Into 0..1 by the least and greatest; 0 where they are the same."""
    least, most = F.min(value).over(window), F.max(value).over(window)
    return F.when(most > least, (value - least) / (most - least)).otherwise(F.lit(0.0))


def recommend(edges: DataFrame, *, directory: str, pattern: str, hazard: str, limit: int = 10) -> DataFrame:
    """Identities by how much they touched a directory, a pattern and a hazard, each scaled; weights .4, .35, .25.

    The counts of all identities come from one pass; the range of each is one row, joined by broadcast.
    """
    n = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("double")
    counts = edges.groupBy("identity_name").agg(
        n(F.col("file_path").startswith(directory) & (F.col("kind") != "lookup")).alias("f"),
        n(F.col("kind").isin("pattern_added", "pattern_removed") & (F.col("detail") == pattern)).alias("p"),
        n((F.col("kind") == "resolved") & (F.col("detail") == hazard)).alias("h"),
    )
    ends = counts.agg(*(g(c).alias(f"{c}_{name}") for c in "fph" for name, g in (("least", F.min), ("most", F.max))))
    part = lambda c: F.when(F.col(f"{c}_most") > F.col(f"{c}_least"), (F.col(c) - F.col(f"{c}_least")) / (F.col(f"{c}_most") - F.col(f"{c}_least"))).otherwise(0.0)
    scored = counts.join(F.broadcast(ends)).withColumn("score", F.round(0.4 * part("f") + 0.35 * part("p") + 0.25 * part("h"), 6))
    return scored.where("score > 0").orderBy(F.desc("score"), "identity_name").limit(limit).select("identity_name", "score")


def commit_fan_out(commits: DataFrame) -> DataFrame:
    """One commit event for each commit, and one for each hazard and pattern it adds or removes, at the same time."""
    one = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    each = lambda kind, column: F.transform(F.coalesce(column, F.array()), lambda d: one(kind, d))
    lists = (("surfaced", "hazards_added"), ("resolved", "hazards_removed"), ("pattern_added", "patterns_added"), ("pattern_removed", "patterns_removed"))
    fan = F.concat(F.array(one("commit", F.lit(None).cast("string"))), *(each(kind, F.col(c)) for kind, c in lists if c in commits.columns))
    return commits.select("id", "identity_name", "file_path", "ts", F.explode(fan).alias("e")).select("id", "identity_name", "file_path", "ts", "e.kind", "e.detail")


def touched_identities(edges: DataFrame, since: int) -> DataFrame:
    """Identities whose signature is out of date."""
    return edges.where(F.col("ts") > since).select("identity_name").distinct()


def session_gaps(edges: DataFrame) -> DataFrame:
    """Each event with the time since the identity's previous one."""
    w = Window.partitionBy("identity_name").orderBy("ts", "id")
    return edges.select("id", "identity_name", "ts", (F.col("ts") - F.lag("ts").over(w)).alias("gap_ms"))


def resume(edges: DataFrame, identity: str, now: int) -> DataFrame:
    """Open hazards of an identity with their age in days, oldest first."""
    own = open_hazards(edges.where(F.col("identity_name") == identity))
    return own.select("id", "file_path", "detail", "ts", F.floor((F.lit(now) - F.col("ts")) / 86_400_000).alias("age_days"))
