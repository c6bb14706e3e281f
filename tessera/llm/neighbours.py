"""Approximate nearest neighbours by cosine: a vantage-point tree for each shard of the vectors.

On unit vectors the largest cosine is the least Euclidean distance, for which the triangle inequality
bounds what a subtree can hold: a subtree keeps the ranges of its points' distances from all vantage points
above it. It is left out if the largest of these bounds, times ``relax``, is beyond the k-th nearest vector
found so far: 1 searches exactly; larger factors prune more and may miss some.

The same bounds route queries to shards. The upper levels of one tree, fitted on a bounded sample, deal every
vector to a shard; a query's nearest sampled vectors bound its k-th distance from the start, and it is sent only
to shards that can hold something nearer. A shard's tree is built once for each BLOCK of the queries sent to it,
which stream past it. Equal vectors are one point of a tree, which keeps the smallest ids of them, as no others
can be among the nearest.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; rows that repeat an id count once, with the greatest vector; ties go
to the smaller id; with fewer candidates than asked for, all are returned; an empty table gives an empty
result; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, parts, partitions

LEAF = 64
#: Queries that are searched in one pass over a shard's tree, and those for which a shard's tree is built once.
AT_ONCE, BLOCK = 1_024, 50_000
#: Differences of cosines and of distances that rounding may make.
COSINE_NOISE, DISTANCE_NOISE = 1e-12, 1e-7


def _scaled(x: np.ndarray) -> np.ndarray:
    """The rows by a power of two each, which rounds nothing, so that no square overflows and the largest doesn't vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(-1), 0))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for the same two vectors wherever they stand."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


@dataclass
class Node:
    """Rows start..end of the ordered vectors, their ranges of distances from the vantage points above, and for an inner node its own."""

    start: int
    end: int
    low: np.ndarray
    high: np.ndarray
    vantage: np.ndarray | None = None
    below: list[Node] = field(default_factory=list)


class Best:
    """The k nearest found so far for each of some queries, by falling score, then id."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k = names, k
        self.scores, self.ids = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of query number ``which``; an id that is there already or is the query's own is left out."""
        other = ids != self.names[which]
        some = np.unique(which)
        who = np.concatenate([np.repeat(some, self.k), which[other]])
        score, name = np.concatenate([self.scores[some].ravel(), scores[other]]), np.concatenate([self.ids[some].ravel(), ids[other]])
        order = np.lexsort((name, -score, who))
        who, score, name = who[order], score[order], name[order]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (name[1:] != name[:-1]) | (name[1:] == np.iinfo(np.int64).max)
        who, score, name = who[fresh], score[fresh], name[fresh]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = place < self.k
        self.scores[who[kept], place[kept]], self.ids[who[kept], place[kept]] = score[kept], name[kept]


class Tree:
    """A vantage-point tree of distinct vectors, each with its smallest ids, searched for many queries at once."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF, seed: int = 0):
        self.order, self.leaf, self.random = np.arange(len(points)), leaf, np.random.default_rng(seed)
        self.unit = _unit(points)
        self.root = self._build(0, len(points), np.zeros((0, len(points))))
        self.unit, self.points = self.unit[self.order], points[self.order]
        ids = [ids[i] for i in self.order]
        self.count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first, self.ids = np.cumsum(self.count) - self.count, np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        self.leaves, self.visited, self.asked = self._count(self.root), 0, 0

    def _build(self, start: int, end: int, above: np.ndarray) -> Node:
        """``above``: distances of the rows start..end, in order, from the vantage points of all nodes above."""
        node = Node(start, end, *(above.min(1), above.max(1)) if end > start else (np.zeros(0), np.zeros(0)))
        if end - start <= self.leaf:
            return node
        mine = self.order[start:end]
        tried = [self.unit[mine[i]] for i in self.random.integers(len(mine), size=4)]
        some = self.unit[mine[self.random.integers(len(mine), size=min(len(mine), 200))]]
        node.vantage = max(tried, key=lambda v: _distances(some, v).std())
        apart = _distances(self.unit[mine], node.vantage)
        ranks, half = np.argsort(apart, kind="stable"), (end - start) // 2
        self.order[start:end] = mine[ranks]
        above = np.concatenate([above, apart[None]])[:, ranks]
        node.below = [self._build(start, start + half, above[:, :half]), self._build(start + half, end, above[:, half:])]
        return node

    def _count(self, node: Node) -> int:
        return sum(map(self._count, node.below)) if node.below else 1

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, relax: float, scores: np.ndarray | None = None) -> Best:
        """The k nearest found; ``scores`` bounds the k-th of each query from below, where it is known.

        Each query first goes down to the leaf that it would belong to, which gives it a first bound; then all
        go through the tree together, which costs each node one step however the queries scatter.
        """
        best, unit = Best(names, k), _unit(queries)
        least = np.full(len(names), -np.inf) if scores is None else scores.copy()
        self.asked += len(names)

        def settle(node: Node, who: np.ndarray) -> None:
            if not len(who):
                return
            if not node.below:
                self._leaf(node, who, queries, unit, best, least)
                return
            near = _distances(unit[who], node.vantage) <= (node.below[0].high[-1] + node.below[1].low[-1]) / 2
            settle(node.below[0], who[near])
            settle(node.below[1], who[~near])

        def visit(node: Node, who: np.ndarray, seen: np.ndarray) -> None:
            if not node.below:
                self.visited += len(who)
                self._leaf(node, who, queries, unit, best, least)
                return
            seen = np.concatenate([seen, _distances(unit[who], node.vantage)[:, None]], 1)
            for one in node.below:
                bound = np.maximum(one.low - seen, seen - one.high).max(1)
                near = bound * relax <= np.sqrt(np.maximum(2 - 2 * least[who], 0)) + DISTANCE_NOISE
                if near.any():
                    visit(one, who[near], seen[near])

        everyone = np.arange(len(names))
        settle(self.root, everyone)
        visit(self.root, everyone, np.zeros((len(names), 0)))
        return best

    def _leaf(self, node: Node, who: np.ndarray, queries: np.ndarray, unit: np.ndarray, best: Best, least: np.ndarray) -> None:
        close = unit[who] @ self.unit[node.start : node.end].T
        own = close.shape[1]
        limit = least[who]
        if own > best.k + 1:  # one of the points may be the query itself
            limit = np.maximum(limit, np.partition(close, own - best.k - 1, 1)[:, own - best.k - 1])
        which, point = np.nonzero(close >= limit[:, None] - COSINE_NOISE)
        if not len(which):
            return
        which, point = who[which], point + node.start
        score = cosines(queries[which], self.points[point])
        many = self.count[point]
        spread = np.repeat(self.first[point] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        best.add(np.repeat(which, many), np.repeat(score, many), self.ids[spread])
        least[who] = np.maximum(least[who], best.scores[who, -1])


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Router:
    """The upper levels of a tree over a sample: which shard a vector belongs to, and which shards a query must see."""

    def __init__(self, tree: Tree):
        self.tree, self.shards = tree, []
        self._collect(tree.root)

    def _collect(self, node: Node) -> None:
        if node.below:
            for one in node.below:
                self._collect(one)
        else:
            self.shards.append(node)

    @property
    def levels(self) -> int:
        return max(len(s.low) for s in self.shards)

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, distances from the vantage points above it, NaN beyond them) of each point."""
        unit, shard, apart = _unit(points), np.zeros(len(points), np.int32), np.full((len(points), self.levels), np.nan)
        number = {id(s): i for i, s in enumerate(self.shards)}

        def down(node: Node, who: np.ndarray, depth: int) -> None:
            if not node.below or not len(who):
                shard[who] = number.get(id(node), 0)
                return
            apart[who, depth] = d = _distances(unit[who], node.vantage)
            near = d <= (node.below[0].high[-1] + node.below[1].low[-1]) / 2
            down(node.below[0], who[near], depth + 1)
            down(node.below[1], who[~near], depth + 1)

        down(self.tree.root, np.arange(len(points)), 0)
        return shard, apart

    def measured(self, low: list[list[float]], high: list[list[float]]) -> None:
        """Takes the ranges of all vectors in place of the sample's; shards without vectors are never visited."""
        for s, a, b in zip(self.shards, low, high, strict=True):
            s.low, s.high = (np.array(x[: len(s.low)] if x else [np.inf] * len(s.low), float) for x in (a, b))

    def visits(self, queries: np.ndarray, names: np.ndarray, k: int, relax: float) -> tuple[Best, np.ndarray, np.ndarray]:
        """(nearest of the sample, query number, shard) of all shards that may hold something nearer."""
        tree, unit = self.tree, _unit(queries)
        best = Best(names, k)
        everyone = Node(0, len(tree.unit), np.zeros(0), np.zeros(0))
        tree._leaf(everyone, np.arange(len(names)), queries, unit, best, np.full(len(names), -np.inf))
        reach = np.sqrt(np.maximum(2 - 2 * np.maximum(best.scores[:, -1], -1), 0)) + DISTANCE_NOISE
        bound, number = np.zeros((len(names), len(self.shards))), {id(s): i for i, s in enumerate(self.shards)}

        def down(node: Node, seen: np.ndarray) -> None:
            if not node.below:
                gaps = np.maximum(node.low - seen, seen - node.high)
                bound[:, number[id(node)]] = np.maximum(gaps.max(1), 0) if gaps.shape[1] else 0
                return
            seen = np.concatenate([seen, _distances(unit, node.vantage)[:, None]], 1)
            for one in node.below:
                down(one, seen)

        down(tree.root, np.zeros((len(names), 0)))
        return best, *np.nonzero(bound * relax <= reach[:, None])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.asarray(column.value_lengths()))[:-1]) if len(column) else []


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, relax: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 4_096, sample: int = 2_048
) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found among ``vectors`` for each row of ``queries``, itself left out.

    Every row is indexed. ``sample`` bounds the vectors that the upper levels are fitted on, ``shard_rows`` is
    what a shard holds: a shard that comes out larger is dealt on by hash. Keys are numbers.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    once = lambda df: df.where(usable(F.col(vector)) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(vector).alias("v"))
    own, ask = once(vectors), once(queries)
    length = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, score double")
    own, ask = own.where(F.size("v") == length["n"]), ask.where(F.size("v") == length["n"])
    # a limit by rank is taken before the shuffle too, so that a vector that very many rows share sends k + 1 of each partition
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = own.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = checkpointed(points.withColumn("hash", F.xxhash64("v")))
    total = points.count()
    few = points.orderBy("hash", "v").limit(sample).collect()  # a bounded sample
    fitted = np.array([r["v"] for r in few], float)
    router = Router(Tree(fitted, [np.array(r["ids"]) for r in few], leaf=max(8, len(few) * shard_rows // max(total, 1))))
    levels = router.levels

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2_000):
            shard, apart = router.place(_matrix(batch.column("v")))
            yield pa.record_batch([*batch.columns, pa.array(shard), pa.array(list(apart), pa.list_(pa.float64()))], [*batch.schema.names, "shard", "apart"])

    v_kind = points.schema["v"].dataType.simpleString()
    placed = checkpointed(points.mapInArrow(assign, f"v {v_kind}, ids array<long>, hash long, shard int, apart array<double>"))
    ranges = {r["shard"]: r for r in placed.groupBy("shard").agg(F.count("*").alias("n"), *(f(F.col("apart")[i]).alias(f"{f.__name__}{i}") for i in range(levels) for f in (F.min, F.max))).collect()}
    got = [ranges.get(s) for s in range(len(router.shards))]  # no more rows than the sample has
    router.measured(*([[r[f"{f}{i}"] for i in range(levels)] if r else [] for r in got] for f in ("min", "max")))
    pieces = np.array([-(-r["n"] // shard_rows) if r else 1 for r in got], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            names, v = batch.column("id").to_numpy(), batch.column("v")
            best, which, shard = router.visits(_matrix(v), names, k, relax)
            many = pieces[shard]
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            which, shard = np.repeat(which, many), np.repeat(shard, many)
            found, rank = np.nonzero(best.scores > -np.inf)
            n, m = len(which), len(found)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([names[which], names[found]])), pa.array(np.concatenate([shard, np.full(m, -1)]).astype(np.int32)), pa.array(np.concatenate([piece, np.zeros(m)]).astype(np.int32)),
                    pa.concat_arrays([v.take(pa.array(which)), pa.nulls(m, v.type)]), pa.array(np.concatenate([best.scores[which, -1], best.scores[found, rank]])), pa.array(np.concatenate([np.zeros(n, np.int64), best.ids[found, rank]])),
                ],
                ["query_id", "shard", "piece", "v", "score", "id"],
            )

    routed = checkpointed(ask.mapInArrow(route, f"query_id long, shard int, piece int, v {v_kind}, score double, id long"))
    asked = routed.where("shard >= 0")
    sent = {(r["shard"], r["piece"]): -(-r["n"] // BLOCK) for r in asked.groupBy("shard", "piece").agg(F.count("*").alias("n")).collect()}
    blocks = F.coalesce(F.lit([[sent.get((s, p), 0) for p in range(pieces[s])] for s in range(len(pieces))])[F.col("shard")][F.col("piece")], F.lit(0)) if sent else F.lit(0)
    points = placed.withColumn("piece", F.pmod("hash", F.lit(pieces.tolist())[F.col("shard")]).cast("int"))
    points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.when(blocks > 0, blocks - 1)))).select("shard", "piece", F.col("block").cast("int"), F.lit(0).alias("asks"), "ids", "v", F.lit(0).cast("long").alias("query_id"), F.lit(0.0).alias("score"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).select("shard", "piece", "block", F.lit(1).alias("asks"), F.array().cast("array<long>").alias("ids"), "v", "query_id", "score")
    rows = points.unionByName(asked).repartition(partitions(spark), "shard", "piece", "block").sortWithinPartitions("shard", "piece", "block", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, tree = None, [], [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("shard", "piece", "block", "asks")], 1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                if tuple(place[start, :3]) != at:
                    at, held, ids, tree = tuple(place[start, :3]), [], [], None
                if not place[start, 3]:
                    held.append(_matrix(part.column("v")))
                    ids += _lists(part.column("ids"))
                    continue
                if not held:
                    continue
                tree = tree or Tree(np.concatenate(held), ids)
                for some in parts([part], AT_ONCE):
                    names = some.column("query_id").to_numpy()
                    best = tree.search(_matrix(some.column("v")), names, k, relax, some.column("score").to_numpy())
                    which, rank = np.nonzero(best.scores > -np.inf)
                    yield pa.record_batch([pa.array(names[which]), pa.array(best.ids[which, rank]), pa.array(best.scores[which, rank])], ["query_id", "id", "score"])

    found = rows.mapInArrow(search, "query_id long, id long, score double").unionByName(routed.where("shard < 0").select("query_id", "id", "score"))
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").cast(kind), "rank", F.col("id").cast(kind).alias(key), "score")
