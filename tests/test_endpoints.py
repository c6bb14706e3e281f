"""Endpoints of diffs, marked entries, usages of symbols and what is loaded in vain, against plain versions on small tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis as A
from tessera.operators import changelog as C
from tessera.operators import code as K
from tessera.operators import files as P

DAY = [datetime.datetime(2024, 1, d) for d in range(1, 29)]


def chosen(endpoint, entries):
    newest = sorted(entries, key=lambda e: (e[1], e[0]), reverse=True)
    if endpoint in ("latest", "prev"):
        return newest[endpoint == "prev" :][:1]
    if endpoint.isdigit():
        return [e for e in newest if e[0] == int(endpoint)][:1]
    try:
        time = datetime.datetime.fromisoformat(endpoint)
    except ValueError:
        return []
    return [e for e in newest if e[1] <= time][:1]


def test_endpoints_equal_a_plain_version(spark):
    entries = [("a", i, DAY[(i * 7) % 20]) for i in range(1, 30)] + [("b", 50, DAY[3]), ("b", 51, DAY[3]), ("hot", 60, DAY[9])]
    held = [e for e in entries if e[1] % 3] + [("b", 7, DAY[2])]
    held = [e for e in held if e[0] != "hot"]
    ends = ["latest", "prev", "2024-01-05", "2024-01-05 00:00:01", "2023-01-01", "nonsense", "1", "3", "51", "99", "60"]
    asked = [(f"{f}|{e}", f, e) for f in ("a", "b", "hot", "none") for e in ends]
    want = []
    for request, f, end in asked:
        for i, at in chosen(end, [(i, at) for g, i, at in entries if g == f]):
            exact = [s for s in held if s[0] == f and s[1] == i and s[2] <= at]
            near = sorted((s[2], s[1]) for s in held if s[0] == f and s[2] <= at)
            want.append((request, i, i if exact else near[-1][1] if near else None, "exact_snapshot" if exact else "nearest_snapshot" if near else None))
    schema = "file_path string, id bigint, at timestamp"
    frames = [spark.createDataFrame(rows, schema) for rows in (entries, held)]
    got = A.resolve_endpoints(spark.createDataFrame(asked * 2, "request string, file_path string, endpoint string"), *frames)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_last_entries_of_one_file_are_marked(spark):
    rows = [(i, f, DAY[i % 5], "pending") for i in range(12) for f in ("a", "b")] + [(None, None, None, None)]
    own = spark.createDataFrame(rows, "id bigint, file_path string, created_at timestamp, verification_status string")
    got = C.verify_last(own, "a", 3, "verified")
    assert got.columns == own.columns and got.count() == len(rows)
    last = sorted((r for r in rows if r[1] == "a"), key=lambda r: (r[2], r[0]), reverse=True)[:3]
    assert sorted((r["id"], r["file_path"]) for r in got.where("verification_status = 'verified'").collect()) == sorted((r[0], "a") for r in last)


@pytest.mark.parametrize("most", [0, 100])
def test_usages_with_names_broadcast_or_not(spark, monkeypatch, most):
    monkeypatch.setattr(P, "BROADCAST_NAMES", most)
    files = spark.createDataFrame([("a", "foo foo bar foobar"), ("b", "foo $x foo.bar"), ("c", None), ("d", "")], "file_path string, content string")
    names = spark.createDataFrame([("foo", "a"), ("foo", "a"), ("$x", "a"), ("bar", "b"), (None, "a"), ("gone", "c")], "name string, file_path string")
    assert sorted(map(tuple, P.symbol_usages(files, names).collect())) == [("$x", "a", "b", 1), ("bar", "b", "a", 1), ("foo", "a", "b", 2)]


def test_loaded_symbols(spark):
    flows = [
        ("a", 0, "loads `x1` then LOADED UserRow, fetches rows, derives fooBar, load a, fetch `z`"), ("a", 1, "see `other` and `x1`; derived the Used"), ("a", 2, "loads `other`"),
        ("a", 3, "loads MAX_SIZE, loaded Foo_bar, preload Thing, loads $abc"), ("b", 0, None), ("b", 1, ""), (None, 0, "loads `y2`"),
    ]
    got = K.loaded_symbols(spark.createDataFrame(flows, "file_path string, position int, flow string")).collect()
    names = {r["name"]: r["flow"] for r in got if r["file_path"]}
    assert set(names) == {"x1", "UserRow", "fooBar", "other", "MAX_SIZE", "Foo_bar"}
    assert names["other"] == "loads `other`" and names["x1"] == flows[0][2] and len(got) == 7


def test_loaded_but_used_nowhere_downstream(spark):
    links = [(f"f{i}", f"f{i + 1}") for i in range(9)] + [("f9", "f7"), ("f5", "f5"), (None, "f1"), ("f1", None), ("x", "f3")]
    loaded = [(f"f{i}", name) for i in range(10) for name in ("A", "B", "C")] + [("lone", "A"), (None, "A")]
    used = [("f3", "A"), ("f8", "B"), ("x", "C"), ("f0", "other"), (None, "A")]
    reach, grown = {u for u in used if u[0]}, True
    while grown:
        more = {(t, n) for f, n in reach for s, t in links if s == f and t} - reach
        reach, grown = reach | more, bool(more)
    frames = spark.createDataFrame(loaded, "file_path string, name string").withColumn("flow", F.lit("loads")), spark.createDataFrame(used, "file_path string, name string"), spark.createDataFrame(links, "source_file string, target_file string")
    got = {(r["file_path"], r["name"]) for r in K.loaded_not_used(*frames).collect()}
    assert got == {x for x in loaded if x not in reach}
    assert K.loaded_not_used(frames[0].where("false"), *frames[1:]).count() == 0
