"""Refresh batches and quiet files against plain versions, over micro-batches of any cut and a restart."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tessera.sources.tables import edges
from tessera.streaming import freshness as R
from tessera.streaming import streams as T

SCHEMA = "workspace string, file_path string, at timestamp"


def when(ms):
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def plain(changes, debounce, cooldown, most, until):
    """Steps from timer to timer of each workspace."""
    out = []
    for w in {w for w, _, _ in changes}:
        log = sorted((t, p) for v, p, t in changes if v == w and t < until)
        waits, due, last, n = [], None, None, 0
        while log or due is not None:
            if log and (due is None or log[0][0] < due):
                t, p = log.pop(0)
                waits += [p] * (p not in waits)
                due = t + debounce
            elif due >= until:
                break
            elif last is not None and due < last + cooldown:
                due = last + cooldown
            else:
                out.append((w, n, due, waits[:most]))
                waits, last, n = waits[most:], due, n + 1
                due = due + cooldown if waits else None
    return sorted(out)


def drained(spark, folder, parts, **how):
    """Each of the parts arrives while no query runs; the query is then started again from its checkpoint."""
    for part in parts:
        spark.createDataFrame([(w, p, when(t)) for w, p, t in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = T.open_stream(spark, f"{folder}/in", SCHEMA, files_per_trigger=1)
        with R.state_in_rocksdb(spark):
            out = T.collected(R.refresh_batches(stream, **how), "append", spark, folder)
    return sorted((r.workspace, r.batch, r.ms, r.files) for r in out.withColumn("ms", F.unix_millis("started_at")).collect())


END = ("z", "end.ts", 10_000_000)  # moves the watermark beyond all else


def test_a_replayed_log_gives_literal_batches_over_restarts(spark, tmp_path):
    log = [("w", "a.ts", 1), ("w", "b.ts", 1_000), ("w", "a.ts", 2_400), ("w", "c.ts", 4_000), ("w", "d.md", 18_000), ("w", "dist/x.ts", 18_500), ("w", "e.bin", 18_600), ("w", "a.ts", 18_900), ("v", "a.py", 3_900), (None, "a.ts", 5)]
    log += [("u", f"f{i:02}.ts", 100 + i) for i in range(45)]
    want = [
        ("u", 0, 1_644, [f"f{i:02}.ts" for i in range(20)]), ("u", 1, 16_644, [f"f{i:02}.ts" for i in range(20, 40)]), ("u", 2, 31_644, [f"f{i:02}.ts" for i in range(40, 45)]),
        ("v", 0, 5_400, ["a.py"]),
        ("w", 0, 3_900, ["a.ts", "b.ts"]), ("w", 1, 20_400, ["c.ts", "d.md", "a.ts"]),
    ]
    # c.ts at 4,000 would be due at 5,500, is put off to 18,900 by the cooldown, and by d.md and a.ts to 20,400
    assert drained(spark, str(tmp_path), [log[:4], log[4:], [END]]) == want
    assert plain([c for c in log if c[0] and "dist" not in c[1] and "bin" not in c[1]], 1_500, 15_000, 20, 10**9) == want


def test_batches_of_a_whole_log(spark, sf_dir, tmp_path):
    rows = [(r.workspace, r.file_path, r.ts) for r in edges(spark, sf_dir).collect()]
    until = max(t for _, _, t in rows) - 600_000
    how = {"debounce_ms": 900_000, "cooldown_ms": 9_000_000, "most": 3}
    log = sorted(rows, key=lambda r: r[2])
    got = drained(spark, str(tmp_path), [log[:400], log[400:]], **how)
    assert got == plain(rows, 900_000, 9_000_000, 3, until)
    assert len(got) > 50 and max(len(f) for *_, f in got) == 3


def test_quiet_files(spark, tmp_path):
    log = [("w", "a", 0, 1, "x"), ("w", "a", 4_000, 2, "y"), ("w", "a", 9_001, 3, "z"), ("w", "b", 4_000, 5, "p"), ("w", "b", 4_000, 4, "q"), ("w", None, 1, 6, None), ("z", "end", 10_000_000, 7, "e")]
    schema = "workspace string, file_path string, at timestamp, id long, kind string"
    spark.createDataFrame([(w, p, when(t), i, k) for w, p, t, i, k in log], schema).write.parquet(str(tmp_path / "in"))
    out = T.collected(R.quiet_changes(T.open_stream(spark, str(tmp_path / "in"), schema)), "append", spark, str(tmp_path))
    got = sorted((r.file_path or "", r.ms, r.changes, r.id, r.kind) for r in out.withColumn("ms", F.unix_millis("due_at")).collect())
    assert got == [("", 5_001, 1, 6, None), ("a", 9_000, 2, 2, "y"), ("a", 14_001, 1, 3, "z"), ("b", 9_000, 2, 5, "p")]
