"""The folder that the driver and all executors share, and frames written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that Python works on at a time; a longer text is taken alone.
SLICE_BYTES = 1_000_000


def slices(texts: list[pa.Array], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of rows that hold about ``limit`` bytes of the columns, so that what is made of them at a time is small."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in texts)
    ends, start = np.cumsum(sizes + 64), 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, end
        start = end


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, else the session's ``spark.checkpoint.dir``; a temporary one only where Spark is one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as compressed columns in the shared folder, to be read several times; it stays there until the folder is cleared.

    A checkpoint holds rows as they are in memory, several times the size where texts repeat.
    """
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew where it has fewer partitions than the cluster has cores: for what costs seconds a megabyte."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Scratch:
    """Frames that a loop writes to the shared folder and reads again; they go when it ends.

    What is read again knows nothing of where it comes from: after many rounds of checkpoints, planning drags along the
    constraints of all rounds before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.written = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        path, self.written = f"{self.folder}/{self.written}", self.written + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
