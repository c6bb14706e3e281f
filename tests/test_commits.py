"""Admission of commits against a plain version that looks back over the whole log of a file."""

from __future__ import annotations

from collections import Counter, defaultdict

from tessera.operators.commits import admit
from tessera.plans.analysis import commit_requests

SCHEMA = "id long, workspace string, file_path string, holder string, summary string, file_hash string, ts long, released_at long"


def plain(rows):
    out, by = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        let_in = by[r["workspace"], r["file_path"]]  # of this file, in order
        same = [x for x in let_in if (x["summary"], x["file_hash"]) == (r["summary"], r["file_hash"]) and r["ts"] - x["ts"] <= 30_000]
        last = let_in[-1] if let_in else None
        if same:
            out[r["id"]] = ("duplicate", same[-1]["id"])
        elif last and last["holder"] != r["holder"] and r["ts"] - last["ts"] < 30_000 and (last["released_at"] is None or r["ts"] < last["released_at"]):
            out[r["id"]] = ("claimed", last["id"])
        else:
            let_in.append(r)
            out[r["id"]] = ("accepted", r["id"])
    return out


def test_whole_log(spark, sf_dir):
    log = commit_requests(spark, sf_dir)
    got = {r["id"]: (r["decision"], r["cause"]) for r in admit(log.repartition(5)).collect()}
    assert got == plain([r.asDict() for r in log.collect()])
    assert min(Counter(d for d, _ in got.values()).get(d, 0) for d in ("accepted", "duplicate", "claimed")) > 20


def test_a_replayed_log(spark):
    log = [
        (1, "w", "f", "a", "s", "h", 0, None), (2, "w", "f", "a", "s", "h", 30_000, None), (3, "w", "f", "a", "s", "h", 30_001, 31_000), (4, "w", "f", "b", "t", None, 30_500, None),
        (5, "w", "f", "b", "t", None, 31_000, None), (6, "w", "f", "b", "t", None, 31_000, None), (7, "w", "f", "a", "u", "h", 60_999, None), (8, "w", "f", "a", "u", "h", 61_000, None), (9, "v", "f", "c", "s", "h", 10, None), (10, None, None, None, None, None, 5, None),
    ]
    got = {r["id"]: (r["decision"], r["cause"]) for r in admit(spark.createDataFrame(log, SCHEMA)).collect()}
    assert got == {
        1: ("accepted", 1), 2: ("duplicate", 1), 3: ("accepted", 3), 4: ("claimed", 3), 5: ("accepted", 5), 6: ("duplicate", 5), 7: ("claimed", 5), 8: ("accepted", 8), 9: ("accepted", 9), 10: ("accepted", 10),
    }
    assert admit(spark.createDataFrame([], SCHEMA)).collect() == []
