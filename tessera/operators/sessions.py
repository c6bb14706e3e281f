"""Sessions as logs, their history, indexing counts; diffs of a work tree; profile writes; appended entries; cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.operators.files import unified_diffs
from tessera.operators.search import held
from tessera.operators.transcripts import zones

#: Kinds of old events that keep a line of their own.
LOUD = ("user_text", "error", "hook")
DAY = 86_400_000


def clock(millis: Column) -> Column:
    """``HH:MM`` of a time in UTC; dashes for time zero."""
    part = lambda unit, most: F.lpad((F.floor(millis / unit) % most).cast("string"), 2, "0")
    return F.when(millis > 0, F.concat(part(3_600_000, 24), F.lit(":"), part(60_000, 60))).otherwise("--:--")


def _label(zone: Column, kind: Column, name: Column, text: Column) -> Column:
    """What an event with a line of its own says: much in the hot zone, a sentence in the warm, a word in the cold."""
    said, start, whole = X.first_sentence(text, 160), F.trim(F.regexp_replace(X.cut_bytes(text, 120), r"\s+", " ")), X.cut_lines(F.trim(text), 6)
    failed = F.when(start == "", "tool_error").otherwise(F.concat(F.lit("tool_error: "), start))
    cold = F.when(kind == "user_text", "· user").when(kind == "error", F.concat(F.lit("· "), failed)).otherwise(F.concat(F.lit("⚙ hook: "), name))
    either = F.when(kind == "assistant_thinking", "💭 (thinking)").when(kind == "tool_use", F.concat(F.lit("🔧 "), name)).when(kind == "error", F.concat(F.lit("⚠ "), failed))
    either = either.when(kind == "tool_result", "↩ tool_result").when(kind == "hook", F.concat(F.lit("⚙ hook: "), name))
    warm = F.when(kind == "user_text", F.concat(F.lit("👤 "), said)).when(kind == "assistant_text", F.concat(F.lit("🤖 "), said)).otherwise(either)
    hot = F.when(kind == "user_text", F.concat(F.lit("👤 USER:\n"), whole)).when(kind == "assistant_text", F.concat(F.lit("🤖 AI:\n"), whole)).otherwise(either)
    return F.when(zone == "cold", cold).when(zone == "warm", warm).otherwise(hot)


def _number_of(n: Column, what: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s")))


def activity_log(events: DataFrame, *, hot: int = 12, warm: int = 40, size: int = 25) -> DataFrame:
    """(session_id, place, line, n): each session's events, oldest first, as numbered lines that stand for n events.

    Events are (session_id, ordinal, ts, kind, name, text), times in milliseconds. The newest are told in full, those
    before in a sentence; of the rest only loud ones have a line, the others are summed up in buckets of at most ``size``
    consecutive events. A new day has a divider, which also ends a bucket. Repeated short lines are one line.
    """
    order = Window.partitionBy("session_id").orderBy("ordinal")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = events.withColumns({"name": F.coalesce("name", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = zones(filled, "session_id", "ordinal", hot=hot, warm=warm)
    rows = rows.withColumn("day", F.when(F.col("ts") > 0, F.date_from_unix_date(F.floor(F.col("ts") / DAY).cast("int")).cast("string")))
    rows = rows.withColumn("before", F.last("day", True).over(above))
    rows = rows.withColumn("divider", F.when(F.col("day").isNotNull() & ~F.col("day").eqNullSafe(F.col("before")), F.col("day")))
    rows = rows.withColumn("alone", (F.col("zone") != "cold") | F.col("kind").isin(*LOUD))
    breaks = F.col("alone").cast("int") + F.col("divider").isNotNull().cast("int")
    rows = rows.withColumn("island", F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.row_number().over(Window.partitionBy("session_id", "alone", "island").orderBy("ordinal"))
    rows = rows.withColumn("bucket", F.floor((inside - 1) / size))

    kinds = lambda kind: F.count_if(F.col("kind") == kind)
    lines = rows.groupBy("session_id", "alone", "island", "bucket").agg(
        F.min("ordinal").alias("at"), F.min_by("ts", "ordinal").alias("first"), F.max_by("ts", "ordinal").alias("last"), F.count("*").alias("n"), F.max("divider").alias("divider"),
        F.max(F.when(F.col("alone"), _label(F.col("zone"), F.col("kind"), F.col("name"), F.col("text")))).alias("label"),
        F.collect_list(F.when(F.col("kind") == "tool_use", F.col("name"))).alias("tools"), kinds("assistant_text").alias("ai"), kinds("assistant_thinking").alias("thoughts"), kinds("synthetic").alias("synthetic"),
    )
    # a bucket has at most ``size`` tools, so its list is small
    counted = F.transform(F.array_distinct("tools"), lambda t: F.struct((-F.size(F.filter("tools", lambda u: u == t))).alias("n"), t.alias("name")))
    named = F.array_join(F.transform(F.slice(F.array_sort(counted), 1, 5), lambda s: F.concat((-s["n"]).cast("string"), F.lit("× "), s["name"])), ", ")
    synthetic = F.when(F.col("synthetic") > 0, F.concat(F.col("synthetic").cast("string"), F.lit(" synthetic")))
    body = F.concat_ws(", ", F.when(F.size("tools") > 0, named), _number_of(F.col("ai"), "AI turn"), _number_of(F.col("thoughts"), "thought"), synthetic)
    summary = F.concat(F.lit("◯ "), F.col("n").cast("string"), F.lit(" cold events: "), F.when(body == "", "misc").otherwise(body))
    said = F.struct(F.lit(1).alias("rank"), F.coalesce("label", summary).alias("said"), "first", "last", "n")
    divider = F.struct(F.lit(0).alias("rank"), F.concat(F.lit("── "), F.col("divider"), F.lit(" ──")).alias("said"), "first", "last", F.lit(0).cast("long").alias("n"))
    lines = lines.select("session_id", "at", F.explode(F.array(divider, said)).alias("l")).select("session_id", "at", "l.*").where("said is not null")

    order = Window.partitionBy("session_id").orderBy("at", "rank")
    short = F.col("said").rlike(r"^(· \S+|💭 \(thinking\))$")
    lines = lines.withColumn("again", F.when(short & F.col("said").eqNullSafe(F.lag("said").over(order)), 0).otherwise(1))
    lines = lines.withColumn("place", F.sum("again").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = lines.groupBy("session_id", "place", "said").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"), F.count("*").alias("times"), F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last"))
    from_, to = clock(F.col("first")), clock(F.col("last"))
    tail = F.when(F.col("times") > 1, F.concat(F.lit(" ×"), F.col("times").cast("string"))).otherwise("")
    when = F.when(from_ == to, from_).otherwise(F.concat(from_, F.lit("–"), to))
    line = F.when(F.col("rank") == 0, F.col("said")).otherwise(F.concat(F.lit("["), when, F.lit("] "), F.col("said"), tail))
    return runs.select("session_id", "place", line.alias("line"), "n")


def history_shown(log: DataFrame, chain: DataFrame, *, tail: int = 6, most: int = 12) -> DataFrame:
    """(project, number, session_id, gap, linked): the entries of a project's log (project, id, t, session_id) to show.

    Those whose session is in the project's ``chain`` (project, session_id), if that has two sessions or more and any entry;
    else the last ones. Numbers and gaps are those of the whole log.
    """
    order = Window.partitionBy("project").orderBy("t", "id")
    sessions = chain.select("project", "session_id").distinct()
    long = sessions.groupBy("project").agg(F.count("*").alias("depth")).where("depth >= 2").select("project")
    member = sessions.join(long, "project", "left_semi").withColumn("member", F.lit(True))
    rows = log.withColumns({"number": F.row_number().over(order), "gap": F.col("t") - F.lag("t").over(order)})
    rows = rows.join(member, ["project", "session_id"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
    rows = rows.withColumn("linked", F.max("member").over(Window.partitionBy("project"))).where("member or not linked")
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("number"))))
    return rows.where(F.col("back") <= F.when(F.col("linked"), most).otherwise(min(tail, most))).select("project", "number", "session_id", "gap", "linked")


def index_counts(listing: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row (files_scanned, files_changed, chunks_upserted): listed sessions, those with chunks, and chunks that are new or changed."""
    read = chunks.join(listing.select("session_id").distinct(), "session_id", "left_semi")
    old = stored.select("chunk_id", F.col("text_hash").alias("old"))
    changed = read.join(old, "chunk_id", "left").select(F.countDistinct("session_id").alias("files_changed"), F.count_if(~F.col("old").eqNullSafe(F.col("text_hash"))).alias("chunks_upserted"))
    return listing.agg(F.countDistinct("session_id").alias("files_scanned")).join(F.broadcast(changed))


def worktree_diffs(entries: DataFrame, *, most: int = 20, context: int = 3) -> DataFrame:
    """Diffs of modified and deleted files (id, file_path, state, old, new), the first ``most`` by path; one without a kept text is skipped.

    A deleted file is compared with nothing. ``reason`` says why a file has no diff.
    """
    few = entries.where(F.col("state").isin("modified", "deleted")).orderBy("file_path", "id").limit(most)
    few = few.withColumn("new", F.when(F.col("state") == "deleted", "").otherwise(F.col("new")))
    reason = F.when(F.col("old").isNull(), "no kept text").when(F.col("new").isNull(), "no current text")
    few = few.withColumn("reason", reason)
    diffs = unified_diffs(few.where("reason is null"), context=context)
    return few.select("id", "file_path", "state", "reason").join(diffs, "id", "left")


def profile_writes(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """(name, blurb, tags, created_at, updated_at, retired_at, dirty) after writes (name, op, value, ts), which apply in order of time.

    ``create`` does nothing to a name that is there, other writes nothing to one that isn't. ``blurb`` and ``tags`` set a
    value, ``retire`` the time. A new profile and a new blurb leave the signature dirty. Of writes of one time the greatest value wins.
    """
    old = stored.select("name", F.col("blurb").alias("old_blurb"), F.col("tags").alias("old_tags"), F.col("created_at").alias("old_created"), F.col("updated_at").alias("old_updated"), F.col("retired_at").alias("old_retired"))
    at = lambda op: F.when(F.col("op") == op, F.col("ts"))
    value = lambda op: F.max(F.when(F.col("op") == op, F.struct("ts", "value")))
    rows = writes.join(old.select("name", "old_created"), "name", "left")
    rows = rows.withColumn("born", F.coalesce("old_created", F.min(at("create")).over(Window.partitionBy("name")))).where("ts >= born")
    new = rows.groupBy("name").agg(
        F.min("born").alias("born"), value("blurb").alias("blurb"), value("tags").alias("tags"), F.max(at("retire")).alias("retired"), F.max(F.when(F.col("op").isin("blurb", "tags"), F.col("ts"))).alias("touched")
    )
    out = old.join(new, "name", "full")
    return out.select(
        "name", F.coalesce("blurb.value", "old_blurb", F.lit("")).alias("blurb"), F.coalesce("tags.value", "old_tags", F.lit("")).alias("tags"), F.coalesce("old_created", "born").alias("created_at"),
        F.coalesce("touched", "old_updated", "born").alias("updated_at"), F.coalesce("retired", "old_retired").alias("retired_at"), (F.col("old_created").isNull() | F.col("blurb").isNotNull()).alias("dirty"),
    )


def append_entries(stored: DataFrame, new: DataFrame, *, order: str = "id", keys: tuple[str, ...] = ("recovery_key", "idempotency_key")) -> DataFrame:
    """New entries with their defaults. A key that is stored, or that an earlier new entry has, is refused; null keys never clash.

    An entry that one key refuses still takes its other keys.
    """
    out = new
    for key in keys:
        # entries without a key are each in a group of their own, not all in one
        own = F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("-"), F.col(order).cast("string")))
        out = out.withColumn(f"_{key}", F.row_number().over(Window.partitionBy(own).orderBy(order)))
    for key in keys:
        out = out.where(F.col(f"_{key}") == 1).join(stored.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("patterns_added", "hazards_added")}
    plain = {"source": F.coalesce("source", F.lit("agent")), "verification_status": F.coalesce("verification_status", F.lit("pending")), "breaking_changes": F.coalesce("breaking_changes", F.lit(False))}
    return out.withColumns(lists | plain).select(*new.columns)


def cross_references(symbols: DataFrame, edges: DataFrame, hits: DataFrame, *, most: int = 10) -> DataFrame:
    """(symbol, source, sites, consumers, total_usages): known edges of a symbol, else the files with most matches of its name.

    Edges are (symbol, file, usage, n), hits (symbol, file, n). A site of edges is a file and a usage; less than one use counts as one.
    """
    known = edges.groupBy("symbol", "file", "usage").agg(F.sum(F.greatest(F.lit(1), F.floor("n"))).alias("n"))
    totals = lambda sites, name: sites.groupBy("symbol").agg(F.struct(F.count("*").alias("sites"), F.countDistinct("file").alias("consumers"), F.sum("n").alias("total")).alias(name))
    best = Window.partitionBy("symbol").orderBy(F.desc("n"), "file")
    top = hits.where("n > 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    out = symbols.select("symbol").distinct().join(totals(known, "known"), "symbol", "left").join(totals(top, "found"), "symbol", "left")
    one = F.coalesce("known", "found")
    source = F.when(F.col("known").isNotNull(), "edges").when(F.col("found").isNotNull(), "matches").otherwise("none")
    count = lambda field: F.coalesce(one[field], F.lit(0)).cast("long").alias(field if field != "total" else "total_usages")
    return out.select("symbol", source.alias("source"), count("sites"), count("consumers"), count("total"))


def commit_candidates(files: DataFrame, *, content: str = "content", most: int = 4, span: int = 20) -> DataFrame:
    """(file_path, subject, tags, highlights): what a commit's missing fields may say, told from the path and the source.

    Tags are the first folder, marks of the path, the cluster's last part and the language, seven at most; highlights
    (label, first, last) start at exported definitions, or at the file's opening if there are none.
    """
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    mark = lambda where, tag: F.when(where, tag)
    # The tags and their order, how many are kept, and the form of an exported definition.
    tags = [
        F.element_at(F.split(path, "/"), 1), mark(path.contains("/tools/"), "mcp-tool"), mark(path.contains("/migrations/"), "migration"), mark(path.contains("/tests/") | path.rlike(r"\.test\.[cm]?tsx?$"), "test"),
        mark(path.rlike(r"types?\.[cm]?ts$"), "types"), F.element_at(F.filter(F.split("cluster", "[/:]"), lambda p: p != ""), -1), F.col("language"),
    ]
    kept = F.slice(F.array_distinct(F.filter(F.array(*tags), lambda t: t.isNotNull() & (t != ""))), 1, 7)
    subject = F.array_join(F.filter(F.transform(F.split(F.regexp_replace("file_path", r"\.[^.]+$", ""), r"[/?#\\._-]+"), lambda w: F.trim(w)), lambda w: w != ""), " ")
    name = lambda line: F.regexp_extract(line, r"^\s*export\s+(?:async\s+)?(?:function|class|interface|type|const)\s+([A-Za-z0-9_$]+)", 1)
    spot = lambda label, first, last: F.struct(label.alias("label"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def highlights(lines: Column) -> Column:
        end = F.size(lines)
        named = F.filter(F.transform(lines, lambda line, i: F.struct(name(line).alias("name"), (i + 1).alias("at"))), lambda m: m["name"] != "")
        marks = F.transform(F.slice(named, 1, most), lambda m: spot(F.concat(F.lit("Export "), m["name"]), m["at"], F.least(end, m["at"] + span)))
        opening = F.array(spot(F.lit("File opening"), F.lit(1), F.least(end, F.lit(span))))
        return held(marks, lambda m: F.when(F.size(m) > 0, m).otherwise(opening))

    # the text is split once, not once for each of its lines
    found = F.when(F.coalesce(F.col(content), F.lit("")) != "", held(F.split(content, r"\r?\n"), highlights))
    return files.select("file_path", F.when(subject == "", F.col("file_path")).otherwise(subject).alias("subject"), kept.alias("tags"), found.alias("highlights"))
