"""Transcripts: reduction to events, chunks, zones and budgets; tool sequences and their mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import short_hash, truncated

NOISE_TOOLS = ("TodoWrite", "Task", "ExitPlanMode", "AskUserQuestion")
PREFIX = {"user_text": "[user]", "assistant_text": "[assistant]", "synthetic": "[synthetic]", "hook": "[hook]", "tool_use": "[tool_call]", "tool_result": "[tool_result]", "error": "[error]"}

BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def reduce_lines(lines: DataFrame) -> DataFrame:
    """Normalised events of transcript lines (source_path, line, type, message.role, message.content, isMeta, timestamp).

    Content is text, which is one block, or an array of blocks. ``ordinal`` numbers the events of a file.
    """
    content = F.trim(F.col("message.content"))
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")), F.lit(None).cast("boolean").alias("is_error")))
    blocks = F.when(content.startswith("["), F.from_json(content, BLOCK)).otherwise(plain.cast(BLOCK))
    rows = lines.select("source_path", "line", "type", F.col("message.role").alias("role"), "isMeta", "timestamp", F.posexplode(blocks).alias("pos", "b"))
    wrapped = F.coalesce(F.col("isMeta"), F.lit(False)) | F.substring(F.coalesce("b.text", F.lit("")), 1, 200).rlike(r"^\s*(<[a-z-]+>|\[CONTEXT REBIRTH\]|\[Request interrupted)")
    kind = (
        F.when(F.col("b.type") == "tool_use", "tool_use")
        .when(F.col("b.type") == "tool_result", "tool_result")
        .when(F.col("b.type") == "thinking", "assistant_thinking")
        .when(F.col("role") == "assistant", "assistant_text")
        .when(F.col("role") == "user", "user_text")
    )
    order = Window.partitionBy("source_path").orderBy("line", "pos")
    out = rows.withColumn("kind", kind).where("kind is not null").withColumn("ordinal", F.row_number().over(order) - 1)
    return out.select(
        "source_path", "ordinal", "kind", (wrapped & (F.col("kind") == "user_text")).alias("synthetic"), F.coalesce("b.text", "b.content").alias("text"),
        F.col("b.id").alias("tool_id"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("input"), F.col("b.tool_use_id").alias("tool_use_id"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), "timestamp",
    )


def pair_tools(events: DataFrame, *, session: str = "source_path", last: bool = True) -> DataFrame:
    """Tool calls with their result: the last (or first) one of the same id."""
    order = Window.partitionBy(session, "tool_use_id").orderBy(F.desc("ordinal") if last else F.asc("ordinal"))
    results = events.where("kind = 'tool_result'").withColumn("n", F.row_number().over(order)).where("n = 1")
    results = results.select(session, F.col("tool_use_id").alias("tool_id"), F.col("text").alias("result"), F.col("is_error").alias("failed"))
    return events.where("kind = 'tool_use'").join(results, [session, "tool_id"], "left").select(session, "ordinal", "tool_id", "tool_name", "input", "result", "failed")


def build_chunks(events: DataFrame, *, session: str = "session_id", body: int = 6000) -> DataFrame:
    """One chunk for each event that says something: a tagged, truncated text, its id and a short hash."""
    tag = F.create_map(*(F.lit(x) for pair in PREFIX.items() for x in pair))
    kind = F.when(F.col("synthetic"), "synthetic").when((F.col("kind") == "tool_result") & F.col("is_error"), "error").otherwise(F.col("kind"))
    text = F.concat_ws(" ", tag[kind], truncated(F.col("text"), body))
    rows = events.where("kind <> 'assistant_thinking' and trim(coalesce(text, '')) <> ''")
    return rows.select(F.concat_ws(":", session, "ordinal").alias("chunk_id"), session, "ordinal", kind.alias("kind"), text.alias("text"), short_hash(text).alias("text_hash"))


def upsert_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, text_hash, has_vector, change): stored chunks after new ones; a changed text loses its vector."""
    both = stored.select("chunk_id", F.col("text_hash").alias("old"), "has_vector").join(new.select("chunk_id", F.col("text_hash").alias("new")), "chunk_id", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull() | (F.col("old") == F.col("new")), "same").otherwise("changed")
    return both.select("chunk_id", F.coalesce("new", "old").alias("text_hash"), F.when(change == "same", F.col("has_vector")).otherwise(F.lit(False)).alias("has_vector"), change.alias("change"))


def zones(events: DataFrame, session: str, order: str, *, hot: int = 12, warm: int = 40) -> DataFrame:
    """hot, warm or cold: the last events of a session, those before, the rest."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return events.withColumn("zone", F.when(place <= hot, "hot").when(place <= hot + warm, "warm").otherwise("cold"))


def newest_within(rows: DataFrame, key: str, order: list[Column], size: Column, budget: int, *, most: int | None = None) -> DataFrame:
    """The newest rows of a key whose sizes sum up to a budget, the first one always, at most ``most``."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumns({"total": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    kept = marked.where((F.col("total") <= budget) | (F.col("place") == 1))
    return (kept if most is None else kept.where(F.col("place") <= most)).drop("total")


def collapse_runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: the value, its number of rows, and where it starts."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", value).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"))


def buckets(rows: DataFrame, key: str, order: list[str], breaks: Column, *, size: int = 25) -> DataFrame:
    """(..., island, bucket): consecutive rows between breaks, at most ``size`` in a bucket."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~breaks)
    place = F.row_number().over(Window.partitionBy(key, "island").orderBy(*order))
    return islands.withColumn("bucket", F.floor((place - 1) / size))


def first_reply(chunks: DataFrame) -> DataFrame:
    """Each user turn with the first assistant turn after it."""
    w = Window.partitionBy("session_id").orderBy("ts").rangeBetween(1, Window.unboundedFollowing)
    reply = F.min(F.when(F.col("role") == "assistant", F.struct("ts", "chunk_id"))).over(w)
    return chunks.withColumn("reply", reply).where("role = 'user'").select("chunk_id", "session_id", "ts", F.col("reply.chunk_id").alias("reply_id"))


def nearest_before(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each event (id, session_id, ts) with the last chunk of its session at or before it, by one sorted union."""
    both = events.select("session_id", "ts", F.lit(1).alias("side"), "id", F.lit(None).cast("string").alias("chunk_id")).unionByName(chunks.select("session_id", "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), "chunk_id"))
    w = Window.partitionBy("session_id").orderBy("ts", "side", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("chunk_id", F.last("chunk_id", ignorenulls=True).over(w)).where("side = 1").select("id", "chunk_id")


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("v")).select(key, "v.*")


def session_span(rows: DataFrame) -> DataFrame:
    """First and last time of each session, times of zero left out."""
    at = F.when(F.col("ts") > 0, F.col("ts"))
    return rows.groupBy("session_id").agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"))


def current_thread(chunks: DataFrame, *, turns: int = 8) -> DataFrame:
    """The last turns of each session that say something, in order."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("chunk_id"))
    return chunks.where("trim(text) <> ''").withColumn("back", F.row_number().over(w)).where(F.col("back") <= turns)


def next_step(chunks: DataFrame) -> DataFrame:
    """Per session: its last user turn, and whether the assistant has spoken since."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("ts")))
    out = chunks.groupBy("session_id").agg(last("user").alias("asked_at"), last("assistant").alias("answered_at"))
    return out.select("session_id", F.when(F.col("asked_at").isNull(), "none").when(F.coalesce("answered_at", F.lit(-1)) > F.col("asked_at"), "finish in-flight work").otherwise("answer the user").alias("hint"))


def sequences(steps: DataFrame, key: str, order: list[str], *, least: int = 3, most: int = 8, noise: tuple[str, ...] = NOISE_TOOLS, share: float = 0.8) -> DataFrame:
    """(key, length, signature, hash): runs of 3 to 8 steps (tool, arg) with two tools or more and no argument in over ``share`` of them."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.concat_ws("::", "tool", F.coalesce("arg", F.lit("")))
    clean = steps.where(~F.col("tool").isin(*noise)).withColumn("step", F.struct("tool", "arg", step.alias("text")))
    ahead = clean.withColumn("ahead", F.collect_list("step").over(w.rowsBetween(0, most - 1)))
    runs = ahead.select(key, F.explode(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(F.size("ahead") >= n, F.slice("ahead", 1, n)))).alias("run")).where("run is not null")
    tools = F.size(F.array_distinct(F.transform("run", lambda s: s["tool"])))
    args = F.filter(F.transform("run", lambda s: s["arg"]), lambda a: a.isNotNull() & (a != ""))
    most_of = F.coalesce(F.array_max(F.transform(F.array_distinct(args), lambda a: F.size(F.filter(args, lambda b: b == a)))), F.lit(0))
    kept = runs.where((tools >= 2) & (most_of <= share * F.size("run")))
    signature = F.array_join(F.transform("run", lambda s: s["text"]), "|")
    return kept.select(key, F.size("run").alias("length"), signature.alias("signature"), F.sha2(signature, 256).alias("hash"))


def candidates(found: DataFrame, session: str, *, least: int = 2, parts: int | None = None) -> DataFrame:
    """Signatures by the number of sessions they occur in.

    Signatures are dealt out once, to ``parts`` tasks where that is given, and counted there; hashes are computed of what is left.
    """
    by = [F.col("signature")]
    dealt = found.select("signature", "length", session).repartition(*([parts] if parts else []), *by)
    counted = dealt.groupBy("signature", "length", session).agg(F.lit(1).alias("n")).groupBy("signature", "length").agg(F.count(session).alias("occurrences"))
    return counted.where(F.col("occurrences") >= least).select(F.sha2("signature", 256).alias("hash"), "signature", "length", "occurrences")


def skip_hashes(found: DataFrame) -> DataFrame:
    """(hash, skip): the hash of each signature and of it with one step left out, if two or more stay; each pair once where ``found`` has each signature once."""
    steps = F.split("signature", r"\|")
    n = F.size(steps)
    without = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.filter(F.transform(steps, lambda s, j: F.when(j != i, s)), lambda s: s.isNotNull()), "|"))
    every = F.concat(F.array("signature"), F.when(n > 2, without).otherwise(F.array().cast("array<string>")))
    return found.select("hash", F.explode(F.array_distinct(every)).alias("s")).select("hash", F.sha2("s", 256).alias("skip"))


def path_mentions(rows: DataFrame, *, text: str = "text", most: int = 30) -> DataFrame:
    """(session_id, path): paths named in texts, the newest first, each once."""
    found = rows.select("session_id", "ts", F.explode(F.regexp_extract_all(text, F.lit(r"(/[\w.-]+(?:/[\w.-]+)+)"), 1)).alias("path"))
    last = found.groupBy("session_id", "path").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "path")
    return last.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("session_id", "path", "n")


def interactions(rows: DataFrame, keys: list[str], *, most: int = 8) -> DataFrame:
    """Running witness state in batch: counts by kind, the newest evidence, confidence up to 100."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id"))
    newest = rows.withColumn("n", F.row_number().over(w))
    return newest.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.least(F.lit(100), F.count("*") * 10).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "kind")))), lambda s: s["kind"]), ",").alias("evidence"),
    )
