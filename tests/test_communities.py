"""Communities and their names against plain versions."""

from __future__ import annotations

import random
import struct
import time
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.operators import communities as C
from tessera.operators import graph as G
from tessera.sources.shared import Scratch
from tessera.sources.tables import follow_graph


def spark_hash(community, turn):
    h = xxhash.xxh64(struct.pack("<q", community), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", turn), seed=h).intdigest()


def plain_parts(nodes, linked):
    left, out = set(nodes), []
    while left:
        part, stack = set(), [min(left)]
        while stack:
            n = stack.pop()
            if n in left:
                left.discard(n)
                part.add(n)
                stack += [m for m in linked[n] if m in left]
        out.append(part)
    return out


def plain_communities(edges, rounds=6):
    """The same rounds over dictionaries, one node and one community at a time."""
    weight = defaultdict(Counter)
    for a, b, u in edges:
        if a != b:
            weight[a][b] += max(1, int(u))
            weight[b][a] += max(1, int(u))
    member = {n: n for n in weight}
    m2 = sum(sum(c.values()) for c in weight.values())
    while True:
        k = {n: sum(c.values()) for n, c in weight.items()}
        label, moved = {n: n for n in weight}, False
        for turn in range(rounds):
            total = Counter()
            for n, c in label.items():
                total[c] += k[n]
            near = {n: Counter() for n in weight}
            for n, c in weight.items():
                for m, w in c.items():
                    if m != n:
                        near[n][label[m]] += w
            gain = {(n, c): m2 * (w - near[n][label[n]]) - k[n] * (total[c] - total[label[n]] + k[n]) for n in weight for c, w in list(near[n].items()) if c != label[n]}
            gain = {x: g for x, g in gain.items() if g > 0}
            best = {}
            for (n, c), g in gain.items():
                if spark_hash(label[n], turn) % 2 == 0 and spark_hash(c, turn) % 2 == 1:
                    best[n] = min(best.get(n, (1, 0)), (-g, c))
            into, out = Counter(), Counter()
            for n, (_, c) in best.items():
                into[c] += k[n]
                out[label[n]] += k[n]
            top = min(best, key=lambda n: (best[n][0], n), default=None)
            for n in [n for n, (g, c) in best.items() if n == top or -g > k[n] * (into[c] + out[label[n]] - 2 * k[n])]:
                label[n] = best[n][1]
                moved = True
        if not moved and gain:
            n, c = min(gain, key=lambda x: (-gain[x], x))
            label[n], moved = c, True
        if not moved:
            return member
        groups = defaultdict(list)
        for n, c in label.items():
            groups[c].append(n)
        name = {}
        for own in groups.values():
            for part in plain_parts(own, {n: [m for m in weight[n] if label[m] == label[n]] for n in own}):
                name |= dict.fromkeys(part, min(part))
        member = {n: name[c] for n, c in member.items()}
        smaller = defaultdict(Counter)
        for n, c in weight.items():
            for m, w in c.items():
                smaller[name[n]][name[m]] += w
        weight = smaller


def quality(edges, of):
    weight, total, inside = 0, Counter(), 0
    for a, b, u in edges:
        if a != b:
            w = max(1, int(u))
            weight += 2 * w
            total[of[a]] += w
            total[of[b]] += w
            inside += 2 * w * (of[a] == of[b])
    return inside / weight - sum((t / weight) ** 2 for t in total.values())


def cliques(*sizes):
    out, at = [], 0
    for size in sizes:
        out += [(at + i, at + j, 1.0) for i in range(size) for j in range(i)]
        at += size
    return out


RANDOM = random.Random(5)
GRAPHS = {
    "two cliques and a bridge": [*cliques(5, 5), (0, 5, 1.0), (3, 3, 50.0)],
    "star": [(0, i, 1.0) for i in range(1, 12)],
    "planted": [(a, b, 3.7 if a % 4 == b % 4 else 0.1) for a in range(40) for b in range(a) if RANDOM.random() < (0.6 if a % 4 == b % 4 else 0.05)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_communities(spark, name):
    edges = GRAPHS[name]
    got = {r["node"]: r["community"] for r in C.communities(spark.createDataFrame(edges, "src long, dst long, usage double")).collect()}
    assert got == plain_communities(edges)
    if name == "two cliques and a bridge":
        assert got == {n: n // 5 * 5 for n in range(10)}
    if name == "planted":
        assert quality(edges, got) > 0.9 * quality(edges, {n: n % 4 for n in range(40)})


def test_better_than_labels(spark, sf_dir):
    graph = follow_graph(spark, sf_dir).cache()
    edges = [tuple(r) for r in graph.collect()]
    found = C.communities(graph).cache()
    ours, labels = ({r["node"]: r["community"] for r in f.collect()} for f in (found, G.communities(graph)))
    assert set(ours) == set(labels) and quality(edges, ours) >= quality(edges, labels)
    assert abs(G.modularity(graph.withColumn("w", F.col("usage")), found).first()["q"] - quality(edges, ours)) < 1e-5


def test_rounds_do_not_shuffle_links_again(spark):
    """Every round reads the links where one shuffle put them; labels and moves are all that is shuffled besides."""
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(3000), rng.randrange(3000), 1.0) for _ in range(60000)], "src long, dst long, usage double")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(run):
        before = store.executorList(True).apply(0).totalShuffleWrite()
        run()
        time.sleep(1)  # the store hears of a task's figures after its end
        return store.executorList(True).apply(0).totalShuffleWrite() - before

    with Scratch(spark) as scratch:
        graph = scratch.cut(C.undirected(edges))
        m2 = graph.agg(F.sum("w")).first()[0]
        once = shuffled(lambda: graph.repartition("src").write.format("noop").mode("overwrite").save())
        assert shuffled(lambda: C._moved(scratch, graph, m2, 1.0, 6).count()) < 2 * once


def test_no_graph(spark):
    assert C.communities(spark.createDataFrame([], "src long, dst long, usage double")).collect() == []
    assert C.communities(spark.createDataFrame([(1, 1, 5.0)], "src long, dst long, usage double")).collect() == []


def test_names(spark):
    parts = {1: ["src/api/a.ts", "src/api/b.ts", "lib/x.ts"], 2: ["src/api/sub/c.ts"], 3: ["src/db/d.ts"], 4: ["root.ts"], 5: ["src/api/z.ts"], 6: ["web/q.ts"], 7: ["web-2/q.ts"], 8: ["web/r.ts"], 9: ["alone.ts"], 10: ["more.ts"]}
    edges = [("src/api/a.ts", "src/api/b.ts"), ("src/api/b.ts", "lib/x.ts"), ("lib/x.ts", "src/api/sub/c.ts"), ("src/api/sub/c.ts", "src/db/d.ts"), ("alone.ts", "more.ts")]
    members = spark.createDataFrame([(c, f) for c, own in parts.items() for f in own], "community long, file_path string")
    got = {r["community"]: r["name"] for r in C.cluster_names(members, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {1: "api/cluster-1", 2: "api/cluster-2", 3: "api/db", 4: "cluster-3", 5: "api", 6: "web", 7: "web-2", 8: "web-3", 9: "cluster-1/cluster-1-1", 10: "cluster-1/cluster-1-2"}
