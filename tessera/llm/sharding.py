"""Sharding by a two-pass external shuffle.

The first pass scatters records uniformly into buckets that fit in memory, by a seeded hash of key and text; it is
Spark's shuffle. The second takes one bucket at a time, puts it in the order of the hash, so that the order of
arrival doesn't matter, and shuffles it by Fisher and Yates with a generator seeded for that bucket. The buckets one after the
other are the shuffled corpus, which is cut into shards whose numbers of rows are at most one apart.

The number of buckets grows with the bytes of the records, so a bucket's size doesn't. Only rows whose key and text
are both the same share a hash; where such repeats overfill a bucket, it is scattered on by where its rows stand in
a copy of the table that is written first. Equal texts under different keys are scattered like any others.

Defined results: a null text has no bytes; a null key is a key like others; each of repeated rows gets a slot of its own; an empty
table gives an empty result; a text larger than a bucket has one for itself or shares it with a few rows; other columns come along,
but for those named ``shard`` and ``slot``. The same rows and seed give the same shards, however the rows are dealt,
unless repeats overfill a bucket: then rows equal in key and text may trade places, which shows in other columns alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, partitions, stored

#: Bytes of records that a bucket is sized for, and those that count for a row besides its text.
BUCKET_BYTES, ROW_BYTES = 32_000_000, 200
#: A bucket with more than so many times its share is scattered on.
OVERFULL = 2
#: Up to so many buckets (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 500_000
#: Buckets whose running sums are taken together.
RUN = 4_096


def fisher_yates(n: int, draws: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1; ``draws[i]``, from 0 to below 1, picks what goes to place i."""
    order, picks = list(range(n)), (draws * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _before(tally: DataFrame) -> DataFrame:
    """(bucket, part, rows, before): the rows in all buckets before; summed within runs of buckets, then over runs."""
    runs = tally.withColumn("run", F.floor(F.col("bucket") / RUN))
    own = Window.partitionBy("run").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("run").agg(F.sum("rows").alias("all"))
    ahead = totals.select("run", F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return runs.withColumn("within", F.coalesce(F.sum("rows").over(own), F.lit(0))).join(ahead, "run").select("bucket", "part", "rows", (F.col("ahead") + F.col("within")).alias("before"))


def shards(docs: DataFrame, *, shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot``, the row's place in its shard, gapless from 0; shards' sizes are at most one apart."""
    spark = docs.sparkSession
    row = F.struct(*docs.columns)  # columns of any name stay apart from those made here
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    weight = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    marks = checkpointed(docs.select(hashed.alias("hash"), weight.alias("weight")))
    total = marks.agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).first()
    rows, buckets = total["n"], -(-(total["bytes"] or 0) // bucket_bytes) or 1
    bucket = lambda c: F.pmod(F.xxhash64(F.lit(seed + 1), c), F.lit(buckets))
    placed = docs.select(row.alias("row"), hashed.alias("hash"), bucket(hashed).alias("bucket"), F.lit(0).cast("long").alias("part"))
    tally = checkpointed(marks.groupBy(bucket(F.col("hash")).alias("bucket")).agg(F.count("*").alias("rows"), F.sum("weight").alias("bytes")))
    overfull = tally.where((F.col("bytes") > OVERFULL * bucket_bytes) & (F.col("rows") > 1))
    overfull = overfull.select("bucket", F.least("rows", F.ceil(F.col("bytes") / bucket_bytes)).alias("parts"))
    if overfull.isEmpty():
        tally = tally.select("bucket", F.lit(0).cast("long").alias("part"), "rows")
    else:
        few = overfull.count() <= BROADCAST_BUCKETS
        parted = placed.drop("part").join(F.broadcast(overfull) if few else overfull, "bucket", "left")
        dealt = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("hash"), F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1).cast("long")))
        placed = stored(parted.withColumn("part", dealt).drop("parts"))  # written, so that no row changes its part when a task runs again
        tally = placed.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    starts = checkpointed(_before(tally).select("bucket", "part", "before"))
    placed = placed.join(F.broadcast(starts) if starts.count() <= BROADCAST_BUCKETS else starts, ["bucket", "part"])
    if buckets < partitions(spark):  # a task for each bucket
        placed = placed.repartition(buckets, "bucket", "part")

    def shuffled(table: pa.Table) -> pa.Table:
        place, part, before = (table.column(c)[0].as_py() for c in ("bucket", "part", "before"))
        arrived = np.argsort(table.column("hash").to_numpy(), kind="stable")
        order = arrived[fisher_yates(len(arrived), np.random.default_rng([seed, place, part]).random(len(arrived)))]
        at = before + np.arange(len(order), dtype=np.int64)
        shard = at * shards // rows if rows < 2**62 // shards else np.array([int(i) * shards // rows for i in at])
        first = -(-shard * rows // shards)
        return pa.table([table.column("row").take(pa.array(order)), pa.array(shard.astype(np.int32)), pa.array((at - first).astype(np.int64))], names=["row", "shard", "slot"])

    kind = StructType([StructField("row", placed.schema["row"].dataType), StructField("shard", IntegerType()), StructField("slot", LongType())])
    out = placed.groupBy("bucket", "part").applyInArrow(shuffled, kind)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes ``docs`` as Parquet, a folder for each shard; in each file rows stand in the order of their slots."""
    shards(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row; the law that holds is ``rows``."""
    return shards(docs, key=key, text=text, **options).select(
        key,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
