"""Structured Streaming forms of the push-like behaviour: the same results as in batch, over event time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def open_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 20, fmt: str = "parquet") -> DataFrame:
    """A file source that takes a bounded number of files in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def deduplicated(stream: DataFrame, keys: list[str], *, at: str = "at", ttl: str = "30 seconds") -> DataFrame:
    """The first row of each key within a time to live."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, *, at: str = "at", by: str = "kind", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of each kind in tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, *, at: str = "at", by: str = "identity_name", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def witnesses(stream: DataFrame, *, most: int = 8, buckets: int = 4_096) -> DataFrame:
    """Running state for each (identity_name, file_path): events so far, confidence up to 100, the newest kinds.

    Keys share the state of a bucket, so that Python is entered once for each bucket and not for each key; a batch reads and writes the buckets it
    touches whole. The state keeps (ts, id, kind) of each key's newest, so that frames and batches may come in any order.
    """
    number = lambda v: None if v is None else int(v)
    newer = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(who, file): (total, recent) for who, file, total, recent in json.loads(state.get[0])} if state.exists else {}
        touched: dict[tuple, list] = {}
        for frame in frames:
            own = (frame[c].astype(object).where(frame[c].notna(), None) for c in ("identity_name", "file_path", "ts", "id", "kind"))
            for who, file, ts, i, kind in zip(*own, strict=True):
                total, recent = held.get((who, file), (0, []))
                recent = [*recent, (number(ts), number(i), kind)]
                if len(recent) > most:
                    recent = sorted(recent, key=newer, reverse=True)[:most]
                held[who, file] = touched[who, file] = (total + 1, recent)
        state.update((json.dumps([(*k, *v) for k, v in held.items()]),))
        rows = [(*k, total, min(100, total * 10), ",".join(kind for _, _, kind in sorted(recent, key=newer, reverse=True) if kind is not None)) for k, (total, recent) in touched.items()]
        yield pd.DataFrame(rows, columns=["identity_name", "file_path", "total", "confidence", "evidence"])

    # numbers beside nulls would come as floats
    own = stream.select("identity_name", "file_path", F.col("ts").cast("string"), F.col("id").cast("string"), "kind", F.pmod(F.xxhash64("identity_name", "file_path"), F.lit(buckets)).alias("bucket"))
    return own.groupBy("bucket").applyInPandasWithState(
        update, "identity_name string, file_path string, total long, confidence long, evidence string", "held string", "update", GroupStateTimeout.NoTimeout
    )


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None):
    """Runs ``handle`` on each micro-batch; without an interval, on all that there is, and ends."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def last_per_path(batch: DataFrame) -> DataFrame:
    """Of the changes of a micro-batch, the last of each path: what a debounced watcher would act on."""
    return batch.groupBy("file_path").agg(F.max_by(F.struct("id", "ts", "kind"), F.struct("ts", "id")).alias("v")).select("file_path", "v.*")


def collected(stream: DataFrame, mode: str, spark: SparkSession, folder: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Drains a stream of what there is now into a table of files and reads it.

    In update mode a batch holds only the ``keys`` that it touched: each batch is kept, and the last row of each key is read.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    checkpoint, out = f"{folder}/checkpoint", f"{folder}/out"
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out)
    place = (lambda n: f"{out}/batch={n}") if mode == "update" else (lambda n: out)
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(place(n))).start().awaitTermination()
    found = spark.read.parquet(out)
    if mode != "update":
        return found
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)
