"""Streams of several batches, and keys of several frames, against the batch form."""

from __future__ import annotations

from tessera.streaming import streams as T


def test_witnesses_over_many_batches_and_frames(spark, tmp_path):
    schema = "id long, identity_name string, file_path string, kind string, ts long"
    # a hot key in every file, its newest events in the first one; each file has a key of its own
    rows = [(i, "hot", "f", f"k{i}", 10_000 - i) for i in range(250)] + [(1000 + i, "u", f"f{i}", "c", i) for i in range(25)]
    for n in range(25):
        own = [r for r in rows if r[0] % 25 == n]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = T.open_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        got = T.collected(T.witnesses(stream), "update", spark, str(tmp_path), keys=["identity_name", "file_path"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.identity_name, r.file_path): r.total for r in got} == {("hot", "f"): 250} | {("u", f"f{i}"): 1 for i in range(25)}
    assert [r.evidence for r in got if r.identity_name == "hot"] == [",".join(f"k{i}" for i in range(8))]
