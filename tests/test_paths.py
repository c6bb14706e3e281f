"""Cheapest paths and chains against plain versions."""

from __future__ import annotations

import random

from tessera.operators import graph as G


def cheapest(ways, start, end, most):
    """Of all paths of at most so many hops, by layers: the least (cost, hops, nodes)."""
    layer, best = {start: (0.0, [start])}, None
    for hops in range(most + 1):
        if end in layer and (best is None or (layer[end][0], hops) < best[:2]):
            best = (layer[end][0], hops, layer[end][1])
        step = {}
        for (a, b), w in ways.items():
            if a in layer:
                new = (round(layer[a][0] + w, 9), [*layer[a][1], b])
                step[b] = min(step.get(b, new), new)
        layer = step
    return best and best[2]


def test_paths_of_random_graphs(spark):
    rng = random.Random(8)
    for n, back, most in ((9, None, 20), (14, 1.5, 20), (12, 2.0, 3)):
        rows = [(rng.randrange(n), rng.randrange(n), rng.choice((1.0, 2.0, 3.0))) for _ in range(2 * n)]
        ways = {}
        for a, b, w in rows:
            for x, y, v in [(a, b, w), (b, a, w * (back or float("inf")))]:
                if x != y and v < float("inf"):
                    ways[x, y] = min(v, ways.get((x, y), v))
        edges = spark.createDataFrame(rows, "src long, dst long, w double")
        for start, end in ((0, n - 1), (1, 2), (3, 3)):
            got = G.shortest_path(edges, start, end, weight="w", back=back, max_hops=most).orderBy("position").collect()
            want = cheapest(ways, start, end, min(most, n))
            assert [r.node for r in got] == (want or [])
            assert [r.position for r in got] == list(range(len(got)))
            assert not want or {r.cost for r in got} == {sum(ways[s] for s in zip(want, want[1:]))}


def test_chains(spark):
    def nodes(links, start, **how):
        return [(r.depth, r.node) for r in G.chain(spark.createDataFrame(links, "node string, parent string"), start, **how).orderBy("depth").collect()]

    line = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    for limit in (1, 5, 20):
        assert nodes(line, "n03", limit=limit) == [(d, f"n{d + 3:02}") for d in range(min(limit, 38))]
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "x"), (None, "a"), ("e", None), ("s", "s")]
    assert nodes(ring, "a") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert [nodes(ring, x) for x in ("e", "s", "unknown", None)] == [[(0, "e")], [(0, "s")], [(0, "unknown")], []]
    assert nodes([], "a") == [(0, "a")]
