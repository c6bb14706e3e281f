"""Streaming queries, drained over the files there are; their SQL is the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.shared import shared_folder
from tessera.sources.tables import EDGES_SQL, edges, read
from tessera.streaming import freshness as R
from tessera.streaming import streams as T


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/streams-{uuid.uuid4().hex}"


def _source(spark, sf_dir):
    """The edges as a stream: written to a folder first, since a file source reads folders."""
    folder = _folder(spark)
    own = edges(spark, sf_dir).withColumn("at", F.timestamp_millis("ts"))
    own.write.parquet(f"{folder}/in")
    return T.open_stream(spark, f"{folder}/in", own.schema), folder


@query("SELECT epoch_ms(CAST(hour * 3600000 AS BIGINT)) AS start, kind, n FROM (SELECT ts // 3600000 AS hour, kind, count(*) AS n FROM edges GROUP BY ALL)", EDGES_SQL)
def st_03_windowed_counts(spark, sf_dir):
    stream, folder = _source(spark, sf_dir)
    return T.collected(T.windowed_counts(stream), "complete", spark, folder).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT kind, file_path FROM edges", EDGES_SQL)
def st_04_deduplicated(spark, sf_dir):
    stream, folder = _source(spark, sf_dir)
    return T.collected(T.deduplicated(stream, ["kind", "file_path"], ttl="3650 days").select("kind", "file_path"), "append", spark, folder)


@query(
    """SELECT identity_name, file_path, count(*) AS total, least(100, count(*) * 10) AS confidence, string_agg(CASE WHEN n <= 8 THEN kind END, ',' ORDER BY n) AS evidence
    FROM (SELECT *, row_number() OVER (PARTITION BY identity_name, file_path ORDER BY ts DESC, id DESC) AS n FROM edges) GROUP BY 1, 2""",
    EDGES_SQL,
)
def st_05_witness_state(spark, sf_dir):
    stream, folder = _source(spark, sf_dir)
    return T.collected(T.witnesses(stream), "update", spark, folder, keys=["identity_name", "file_path"])


@query("SELECT file_path, max_by(id, (ts, id)) AS id, max(ts) AS ts, max_by(kind, (ts, id)) AS kind FROM edges GROUP BY 1", EDGES_SQL)
def st_01_last_change_per_path(spark, sf_dir):
    stream, folder = _source(spark, sf_dir)
    return T.collected(T.last_per_path(stream), "complete", spark, folder)


@query(
    """SELECT workspace, file_path, epoch_ms(max(ts) + 3600000) AS due_at, count(*) AS changes, max_by(id, (ts, id)) AS id, max_by(kind, (ts, id)) AS kind FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY workspace, file_path ORDER BY ts, id) AS run FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY workspace, file_path ORDER BY ts, id) <= 3600000 THEN 0 ELSE 1 END AS fresh FROM edges))
    GROUP BY workspace, file_path, run HAVING max(ts) + 3600000 <= (SELECT max(ts) - 600000 FROM edges)""",
    EDGES_SQL,
)
def st_01_quiet_changes(spark, sf_dir):
    """Files left alone for an hour; those still warm at the end are not due yet."""
    stream, folder = _source(spark, sf_dir)
    quiet = R.quiet_changes(stream, quiet="1 hour")
    return T.collected(quiet, "append", spark, folder).withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


@query()
def st_02_refresh_batches(spark, sf_dir):
    """The log's changes are minutes apart: quiet for 15 minutes and two and a half hours between batches."""
    stream, folder = _source(spark, sf_dir)
    with R.state_in_rocksdb(spark):
        return T.collected(R.refresh_batches(stream, debounce_ms=900_000, cooldown_ms=9_000_000), "append", spark, folder)
