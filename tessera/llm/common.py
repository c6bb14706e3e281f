"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of ids in a partition of a table that a loop goes over.
ROWS_IN_PARTITION = 50_000
#: Bytes of text that a task works on at a time (a longer text is taken alone).
SLICE_BYTES = 1_500_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the context's, else the session's ``spark.checkpoint.dir``.

    Only where Spark runs in one process a temporary folder is made; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder; it stays there until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written for a step that is over."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation.

    With ``rows``, a bound of its number of rows, into no more partitions than they need.

    See ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_IN_PARTITION)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of what is no longer referenced, between rounds of a loop.

    Spark deletes them when the driver's garbage collector finds them, which a loop over small tables seldom calls.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT: dict[object, object] = {}


def _give_back() -> None:
    """Returns freed memory to the system, as long-lived workers otherwise hold what their largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache(name: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that operators don't add up in its memory."""
    if name not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def slices(batches: Iterator[pa.RecordBatch], text: int | str = 1, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes (SLICE_BYTES) of the column ``text``, so that what is made of one part is small."""
    limit = limit or SLICE_BYTES
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64) + 64)
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
                yield batch.slice(start, end - start)
                start = end
    finally:
        _give_back()


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def kept(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``keep`` marks, decided where they stand: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def span_digests(found: DataFrame, counts: dict[str, str], *, key: str = "doc_id") -> DataFrame:
    """Of (key, spans) rows: the number of base spans of each kind, the SHA-256 of the base spans as text, and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key,
        *(number(kind).alias(name) for name, kind in counts.items()),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
