"""Domain tables projected from the generic test tables, and readers for files and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("commit", "surfaced", "resolved", "pattern_added", "pattern_removed", "source_highlight", "lookup")

#: Directories that are never scanned and extensions that are. Fixed values.
SKIPPED_DIRS = (
    "node_modules", "dist", ".git", ".next", "__tests__", "tests", "test", ".brain", ".atlas", ".turbo", ".cache",
    "coverage", "build", "out", ".vercel", ".svelte-kit", ".nuxt", ".output",
)
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "sql", "py", "go", "rs", "java", "kt", "swift", "vue", "svelte", "md")

TRANSCRIPT_LINE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("isMeta", T.BooleanType()),
        T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])),
    ]
)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity-to-file events: one of KINDS for each row of ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*(F.lit(x) for x in ("click", "commit", "error", "surfaced", "purchase", "resolved", "signup", "pattern_added", "view", "lookup")))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("identity_name"),
        F.concat(F.lit("ws"), F.col("user_id") % 4).alias("workspace"),
        F.concat(F.lit("src/d"), k % 10, F.lit("/f"), k, F.lit(".ts")).alias("file_path"),
        F.col("event_id").alias("changelog_id"),
        kind[F.col("event_type")].alias("kind"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("h"), k)).alias("detail"),
        F.concat(F.lit("s"), F.col("event_id") % 97).alias("session_id"),
        millis(F.col("ts")).alias("ts"),
    )


EDGES_SQL = """edges AS (
  SELECT event_id AS id, 'u' || user_id AS identity_name, 'ws' || (user_id % 4) AS workspace,
         'src/d' || (k % 10) || '/f' || k || '.ts' AS file_path, event_id AS changelog_id,
         CASE event_type WHEN 'click' THEN 'commit' WHEN 'error' THEN 'surfaced' WHEN 'purchase' THEN 'resolved'
              WHEN 'signup' THEN 'pattern_added' WHEN 'view' THEN 'lookup' END AS kind,
         CASE WHEN event_type <> 'click' THEN 'h' || k END AS detail, 's' || (event_id % 97) AS session_id, epoch_us(ts) // 1000 AS ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changelog entries from ``orders``; authors, clusters and commits are null on some."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        o.alias("id"),
        F.concat(F.lit("src/c"), c % 20, F.lit("/f"), c, F.lit(".ts")).alias("file_path"),
        F.concat_ws(" ", F.lit("change"), F.col("o_orderpriority"), F.concat(F.lit("w"), o % 50)).alias("summary"),
        F.when(c % 11 != 0, F.col("o_orderpriority")).alias("cluster"),
        (F.col("o_totalprice") > 300000).alias("breaking_changes"),
        F.when(o % 5 != 0, F.concat(F.lit("sha"), o)).alias("commit_sha"),
        F.when(c % 7 != 0, F.concat(F.lit("a"), c % 13)).alias("author_name"),
        F.concat(F.lit("i"), c % 17).alias("author_instance_id"),
        F.col("o_orderstatus").alias("verification_status"),
        F.col("o_orderdate").alias("created_at"),
    )


CHANGELOG_SQL = """changelog AS (
  SELECT o_orderkey AS id, 'src/c' || (o_custkey % 20) || '/f' || o_custkey || '.ts' AS file_path,
         'change ' || o_orderpriority || ' w' || (o_orderkey % 50) AS summary,
         CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END AS cluster, o_totalprice > 300000 AS breaking_changes,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'sha' || o_orderkey END AS commit_sha,
         CASE WHEN o_custkey % 7 <> 0 THEN 'a' || (o_custkey % 13) END AS author_name, 'i' || (o_custkey % 17) AS author_instance_id,
         o_orderstatus AS verification_status, o_orderdate AS created_at
  FROM orders)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records from ``documents``: content, lines, cluster, and arrays that are empty on some."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.concat(F.lit("ws"), d % 4).alias("workspace"),
        F.concat(F.lit("src/"), F.col("source"), F.when(d % 9 == 0, "/test").otherwise(""), F.lit("/f"), d, F.lit(".ts")).alias("file_path"),
        F.when(d % 13 != 0, F.col("source")).alias("cluster"),
        F.size(F.split("text", "\r?\n")).alias("loc"),
        F.when(d % 3 != 0, F.substring("text", 1, 60)).otherwise("").alias("blurb"),
        F.when(d % 5 != 0, F.substring("text", 1, 120)).otherwise("").alias("purpose"),
        F.when(d % 2 == 0, F.array(F.concat(F.lit("p"), d % 6), F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("patterns"),
        F.when(d % 4 == 0, F.array(F.concat(F.lit("z"), d % 5), F.concat(F.lit("z"), d % 8))).otherwise(F.array().cast("array<string>")).alias("hazards"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


FILES_SQL = """files AS (
  SELECT doc_id AS id, 'ws' || (doc_id % 4) AS workspace,
         'src/' || source || CASE WHEN doc_id % 9 = 0 THEN '/test' ELSE '' END || '/f' || doc_id || '.ts' AS file_path,
         CASE WHEN doc_id % 13 <> 0 THEN source END AS cluster, len(string_split_regex(text, '\\r?\\n')) AS loc,
         CASE WHEN doc_id % 3 <> 0 THEN substr(text, 1, 60) ELSE '' END AS blurb,
         CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 120) ELSE '' END AS purpose,
         CASE WHEN doc_id % 2 = 0 THEN ['p' || (doc_id % 6), lang] ELSE CAST([] AS VARCHAR[]) END AS patterns,
         CASE WHEN doc_id % 4 = 0 THEN ['z' || (doc_id % 5), 'z' || (doc_id % 8)] ELSE CAST([] AS VARCHAR[]) END AS hazards,
         [lang, source] AS tags, lang AS language, text AS content
  FROM documents)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph (src, dst): parts that follow each other in an order, without self-loops."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return line.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


IMPORTS_SQL = """imports AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""


def _followed(log: DataFrame) -> DataFrame:
    """``log`` (user_id, ts, event_id) with ``dst``, the user of the next row by time.

    Rows are dealt by ranges of time; the first user of each range, one row a range, is carried to the range before.
    """
    from pyspark.sql.window import Window

    from tessera.sources.shared import cut

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(log.select("user_id", "ts", "event_id").repartitionByRange(n, "ts", "event_id", "user_id").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("first"))
    # one row for each range
    carried = firsts.select("range", F.lead("first.user_id").over(Window.partitionBy(F.lit(0)).orderBy("range")).alias("carried"))
    inside = F.lead(F.struct("user_id")).over(Window.partitionBy("range").orderBy("ts", "event_id", "user_id"))
    ahead = ranged.withColumn("inside", inside).join(F.broadcast(carried), "range")
    return ahead.select("user_id", "event_id", F.when(F.col("inside").isNull(), F.col("carried")).otherwise(F.col("inside.user_id")).alias("dst"))


def _usage(pairs: DataFrame) -> DataFrame:
    return pairs.where("dst is not null and dst <> user_id").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("usage"))


def follow_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph (src, dst, usage) of users who follow each other in the event log, over all events."""
    return _usage(_followed(read(spark, sf_dir, "events")))


FOLLOW_GRAPH_SQL = """graph AS (
  SELECT user_id AS src, dst, count(*) AS usage FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND dst <> user_id GROUP BY ALL)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript chunks from ``conversations``."""
    return read(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_index"),
        "role",
        "text",
        (F.col("conv_id") * 1000000 + F.col("turn") * 60000).alias("ts"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT conv_id || ':' || turn AS chunk_id, conv_id AS session_id, turn AS turn_index, role, text,
         conv_id * 1000000 + turn * 60000 AS ts FROM conversations)"""


def discover_files(spark: SparkSession, root: str, *, extensions: Sequence[str] = SOURCE_EXTENSIONS, skipped: Sequence[str] = SKIPPED_DIRS) -> DataFrame:
    """(path, content, modificationTime, length) of source files below ``root``, skipped directories left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    inside = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in skipped) + ")/"
    return found.withColumn("file_path", below).where(~F.col("file_path").rlike(inside) & F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*extensions))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = TRANSCRIPT_LINE) -> DataFrame:
    """JSON lines; blank and malformed ones are dropped. Keeps the file and the line's place for ordering."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("modified_at"), F.monotonically_increasing_id().alias("line"))
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("row", parsed).where("trim(value) <> '' and row is not null and row._bad is null").select("source_path", "modified_at", "line", "row.*").drop("_bad")


def target_files(listing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(present, missing) of the wanted paths; paths that climb out of the root are neither."""
    inside = wanted.where(~F.col("file_path").rlike(r"(^/|(^|/)\.\.(/|$))")).select("file_path").distinct()
    return listing.join(inside, "file_path", "left_semi"), inside.join(listing, "file_path", "left_anti")
