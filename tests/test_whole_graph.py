"""The graph of all events and the searches over it against brute force on small logs."""

from __future__ import annotations

import datetime
import random
from collections import Counter

from tessera.operators import graph as G
from tessera.plans import catalog
from tessera.sources.tables import follow_graph


def _log(spark, folder, users):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i // 3), u) for i, u in enumerate(users)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").repartition(3).write.parquet(f"{folder}/events.parquet")
    return Counter((a, b) for a, b in zip(users, users[1:]) if a != b)


def _reached(edges, start):
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        new = {d for s, d in edges if s == a} - seen
        seen |= new
        todo += new
    return seen


def test_every_event_is_in_the_graph(spark, tmp_path):
    rng = random.Random(4)
    users = [rng.randrange(12) for _ in range(60)] + [rng.randrange(20, 30) for _ in range(60)]
    want = _log(spark, tmp_path, users)
    got = {(r.src, r.dst): r.usage for r in follow_graph(spark, str(tmp_path)).collect()}
    assert got == dict(want)
    nodes = {n for e in want for n in e}
    reach = {n: _reached(want, n) for n in nodes}
    parts = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    calls = catalog.queries()
    assert {r.node: r.component for r in calls["gr_11_cycle_sizes"](spark, str(tmp_path)).collect()} == parts
    sizes = {c: n for c, n in Counter(parts.values()).items() if n > 1}
    inside = Counter(parts[a] for a, b in want if parts[a] == parts[b])
    assert {r.component: (r.size, r.edges) for r in calls["gr_10_cycles"](spark, str(tmp_path)).collect()} == {c: (n, inside[c]) for c, n in sizes.items()}
    assert {r.component for r in calls["gr_15_components"](spark, str(tmp_path)).collect()} == {min(nodes)}


def test_a_path_may_be_longer_than_twenty_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert [r.node for r in G.shortest_path(edges, 0, 26, max_hops=None).orderBy("position").collect()] == list(range(27))
