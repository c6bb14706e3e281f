"""Graph operators over edge tables (src, dst): iterative joins, checkpointed each round.

Frontiers, labels and parents stay distributed; the driver sees only whether a round changed anything.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import Scratch, cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, sources: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(node, depth): every node reached from the sources (node) along src -> dst, and its least number of steps."""
    reached = cut(sources.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def neighbors(edges: DataFrame, node, *, depth: int = 1) -> DataFrame:
    """(node, depth) within some steps of a node, in either direction."""
    start = edges.sparkSession.createDataFrame([(node,)], f"node {edges.schema['src'].dataType.simpleString()}")
    return bfs(both_ways(edges), start, max_depth=depth).where("depth > 0")


def subgraph(edges: DataFrame, node, *, depth: int, direction: str = "out") -> DataFrame:
    """The distinct edges between nodes within some steps of a node."""
    way = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": both_ways(edges)}[direction]
    start = edges.sparkSession.createDataFrame([(node,)], f"node {edges.schema['src'].dataType.simpleString()}")
    near = bfs(way, start, max_depth=depth)
    inside = edges.select("src", "dst").distinct().join(near.select(F.col("node").alias("src")), "src", "left_semi")
    return inside.join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def impact(edges: DataFrame, node, *, depth: int = 3, limit: int = 50) -> DataFrame:
    """Who depends on a node: for each consumer its least depth, and usages of its edges into the tree, weighed down by depth."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = edges.sparkSession.createDataFrame([(node,)], f"node {edges.schema['src'].dataType.simpleString()}")
    near = bfs(back, start, max_depth=depth)
    inner = near.select(F.col("node").alias("dst"), F.col("depth").alias("below"))
    hits = edges.join(inner.where(F.col("below") < depth), "dst").where(F.col("src") != F.lit(node)).withColumn("at", F.col("below") + 1)
    out = hits.groupBy(F.col("src").alias("node")).agg(F.min("at").alias("depth"), F.sum("usage").alias("usages"), F.round(F.sum(F.col("usage") / F.col("at")), 6).alias("score"))
    return out.orderBy(F.desc("score"), F.desc("usages"), "node").limit(limit)


def shortest_path(edges: DataFrame, start, end, *, weight: str | None = None, back: float | None = None, max_hops: int | None = 20) -> DataFrame:
    """(position, node, cost) along the cheapest path: least total weight, then fewest hops, then least by its nodes in turn.

    Weights are not negative; ``back`` makes every edge passable against its direction at that many times its weight.
    Rounds go from the end backwards and give each node that got nearer its cost to the end and its next node; of equal
    next ones the least, which makes the whole path least. What costs no less than the start does already is left out.
    Each round's nodes are kept as they were, so a path is read by following (node, hops) in doubled steps. Without
    ``max_hops`` it goes on until no node gets nearer.
    """
    spark = edges.sparkSession
    cost = F.col(weight).cast("double") if weight else F.lit(1.0)
    ways = edges.select("src", "dst", cost.alias("w"))
    if back is not None:
        ways = ways.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (cost * back).alias("w")))
    kind = edges.schema["src"].dataType.simpleString()
    with Scratch(spark) as scratch:
        ways = scratch.cut(ways.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
        best = frontier = spark.createDataFrame([(end, 0.0, 0, None)], f"node {kind}, cost double, hops int, next {kind}")
        rounds = [frontier]
        for hops in itertools.count(1):
            if max_hops is not None and hops > max_hops:
                break
            found = best.where(F.col("node") == F.lit(start)).agg(F.min("cost").alias("enough"))
            step = ways.join(frontier.select(F.col("node").alias("dst"), "cost"), "dst")
            step = step.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(F.round(F.col("cost") + F.col("w"), 9).alias("cost"), F.lit(hops).alias("hops"), F.col("dst").alias("next"))).alias("b"))
            step = step.select("node", "b.*").join(F.broadcast(found)).where("enough is null or cost < enough").drop("enough")
            # hops grow from round to round, so only less cost is nearer
            frontier = scratch.cut(step.join(best.select("node", F.col("cost").alias("old")), "node", "left").where("old is null or cost < old").drop("old"))
            if frontier.isEmpty():
                break
            rounds.append(frontier)
            best = scratch.cut(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))
        length = best.where(F.col("node") == F.lit(start)).select("cost", "hops").first()
        if length is None:
            return spark.createDataFrame([], f"position int, node {kind}, cost double")
        steps = functools.reduce(DataFrame.unionByName, rounds).where("next is not null")
        links = steps.select(F.struct("node", "hops").alias("node"), F.struct(F.col("next").alias("node"), (F.col("hops") - 1).alias("hops")).alias("parent"))
        path = chain(links, (start, length["hops"]), limit=length["hops"] + 1)
        return cut(path.select(F.col("depth").alias("position"), "node.node", F.lit(length["cost"]).alias("cost")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components, each named by its least node."""
    with Scratch(edges.sparkSession) as scratch:
        return cut(connected(scratch, scratch.cut(both_ways(edges))))


def connected(scratch: Scratch, both: DataFrame) -> DataFrame:
    """(node, component) of written edges that are there once in each direction, to be read before ``scratch`` ends.

    Each round a node goes to the first of itself and its neighbours in an order that is drawn anew, and on to where those go, four steps in all; what is left is
    a smaller graph of the places reached. Rounds grow with the logarithm of the nodes, and all rounds together read a few times what the first one does.
    """
    links, moves = both.where("src <> dst"), []
    while not links.isEmpty():
        place = lambda c, turn=len(moves): F.struct(F.xxhash64(c, F.lit(turn)).alias("drawn"), F.col(c).alias("node"))
        first = links.groupBy(F.col("src").alias("node")).agg(F.min(place("dst")).alias("near"))
        move = scratch.cut(first.select("node", F.least("near", place("node"))["node"].alias("to")))
        for _ in range(2):
            move = move.join(move.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        moves.append(scratch.cut(move))
        ends = [moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("src", "dst")]
        links = links.join(ends[0], "src").join(ends[1], "dst").where("src_to <> dst_to").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct()
        links = scratch.cut(links)
    label = both.select(F.col("src").alias("node")).distinct().withColumn("to", F.col("node")) if not moves else moves.pop()
    for move in reversed(moves):
        label = scratch.cut(move.join(label.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to")))
    every = both.select(F.col("src").alias("node")).distinct().join(label, "node", "left").select("node", F.coalesce("to", "node").alias("to"))
    least = every.groupBy("to").agg(F.min("node").alias("component"))
    return every.join(least, "to").select("node", "component")


def _spread(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Each node's least label of the nodes that it can be reached from, itself included, within its group."""
    labels = nodes.select("node", "group", F.col("node").alias(label))
    while True:
        step = edges.join(labels.select(F.col("node").alias("src"), "group", F.col(label).alias("given")), "src").select(F.col("dst").alias("node"), "group", "given")
        better = labels.join(step.groupBy("node", "group").agg(F.min("given").alias("given")), ["node", "group"], "left")
        new = cut(better.select("node", "group", F.col(label).alias("old"), F.least(label, F.coalesce("given", label)).alias(label)))
        if new.where(F.col("old") != F.col(label)).isEmpty():
            return new.select("node", "group", label)
        labels = new.select("node", "group", label)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, each named by its least node.

    Forward-backward colouring: least labels spread along the edges; of each colour, the nodes that reach
    its least node back form a component and leave; the rest goes on, within its colour.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("group", F.lit(0).cast(edges.schema["src"].dataType)))
    done = None
    while not nodes.isEmpty():
        inside = edges.join(nodes.select(F.col("node").alias("src"), F.col("group").alias("gs")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("group").alias("gd")), "dst")
        inside = cut(inside.where("gs = gd").select("src", "dst"))
        colour = _spread(inside, nodes, "colour")
        same = inside.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        back = cut(same.where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        own = bfs(back, colour.where("node = colour").select("node")).select("node")
        found = cut(colour.join(own, "node", "left_semi").select("node", F.col("colour").alias("component")))
        done = found if done is None else done.unionByName(found)
        nodes = cut(colour.join(found, "node", "left_anti").select("node", F.col("colour").alias("group")))
    return done if done is not None else nodes.select("node", F.col("group").alias("component"))


def cycles(edges: DataFrame, *, min_size: int = 2) -> DataFrame:
    """Strong components of a least size: their nodes, and the edges inside them."""
    parts = cut(strong_components(edges))
    inside = edges.select("src", "dst").distinct().where("src <> dst").join(parts.select(F.col("node").alias("src"), F.col("component")), "src")
    inside = inside.join(parts.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst").where("component = cd").groupBy("component").agg(F.count("*").alias("edges"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return sizes.join(inside, "component", "left").select("component", "size", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


def degrees(edges: DataFrame, *, distinct: bool = False) -> DataFrame:
    """(node, fan_in, fan_out, coupling) in one aggregation; ``distinct`` counts each edge once."""
    own = edges.select("src", "dst")
    own = own.distinct() if distinct else own
    ends = own.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    out = ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return out.withColumn("coupling", F.col("fan_in") + F.col("fan_out"))


def entrypoints(nodes: DataFrame, edges: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Nodes that nothing imports, or whose path fits a pattern; the first that fits names the bucket."""
    bucket = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        bucket = F.when(F.col("node").cast("string").rlike(pattern), name).otherwise(bucket)
    imported = edges.select(F.col("dst").alias("node"), F.lit(True).alias("imported")).distinct()
    named = nodes.select("node").distinct().withColumn("bucket", bucket).join(imported, "node", "left")
    return named.where("bucket is not null or imported is null").select("node", F.coalesce("bucket", F.lit("no_importers")).alias("bucket"))


def dead(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no entrypoint reaches."""
    return nodes.select("node").distinct().join(bfs(edges, entries.select("node")).select("node"), "node", "left_anti")


def rollup(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between the groups (node, cluster) of their ends, with their number."""
    named = edges.join(of.select(F.col("node").alias("src"), F.col("cluster").alias("source_cluster")), "src").join(of.select(F.col("node").alias("dst"), F.col("cluster").alias("target_cluster")), "dst")
    return named.groupBy("source_cluster", "target_cluster").agg(F.count("*").alias("edges"))


def modularity(edges: DataFrame, of: DataFrame, *, gamma: float = 1.0) -> DataFrame:
    """Q of a partition (node, community) of the undirected graph of edges (src, dst, w)."""
    w = edges.where("src <> dst").select("src", "dst", F.col("w").cast("double"))
    total = w.agg((2 * F.sum("w")).alias("m2"))
    named = w.join(of.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(of.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    inside = named.where("cs = cd").groupBy(F.col("cs").alias("community")).agg((2 * F.sum("w")).alias("inside"))
    ends = named.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "w"), F.struct(F.col("cd").alias("c"), "w"))).alias("e")).groupBy(F.col("e.c").alias("community")).agg(F.sum("e.w").alias("ends"))
    both = ends.join(inside, "community", "left").join(F.broadcast(total))
    part = F.coalesce("inside", F.lit(0.0)) / F.col("m2") - gamma * (F.col("ends") / F.col("m2")) ** 2
    return both.agg(F.round(F.sum(part), 6).alias("q"))


def communities(edges: DataFrame, *, rounds: int = 12) -> DataFrame:
    """(node, community) by synchronous weighted label propagation of edges (src, dst, usage); connected within.

    Every round each node takes the label with most weight around it (its own counts with one unit, of equal
    ones the least), half of the nodes at a time, which keeps two neighbours from swapping for ever.
    """
    u = F.greatest(F.lit(1), F.floor("usage"))
    w = edges.where("src <> dst").select("src", "dst", u.alias("w"))
    both = cut(w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    labels = cut(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for turn in range(2 * rounds):
        seen = both.join(labels.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "w")
        own = labels.select("node", "community", F.lit(1).alias("w"))
        votes = seen.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("community").cast("long")).alias("c"))).alias("b")).select("node", (-F.col("b.c")).cast(labels.schema["community"].dataType).alias("best"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        new = cut(labels.join(best, "node").select("node", F.col("community").alias("old"), F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community")))
        still = new.where("community <> old").isEmpty()
        labels = new.select("node", "community")
        if still and turn:
            break
    inside = both.join(labels.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst").where("cs = cd")
    parts = components(inside.select("src", "dst")).withColumnRenamed("component", "community")
    alone = labels.join(parts, "node", "left_anti").select("node", F.col("node").alias("community"))
    return parts.unionByName(alone)


def chain(links: DataFrame, start, *, limit: int = 20) -> DataFrame:
    """(depth, node) back along (node, parent) from a node, at most ``limit`` of them, stopping at a repeat.

    ``start`` is a value or a frame of one row with the column node; a null one has no chain. Of several parents the least
    counts. Steps double: a round joins what points 1, 2, 4, ... nodes back, and what is found, with those pointers once.
    """
    spark, kind = links.sparkSession, links.schema["node"].dataType.simpleString()
    begin = start if isinstance(start, DataFrame) else spark.createDataFrame([(start,)], f"node {kind}")
    found = begin.where("node is not null").select(F.lit(0).alias("depth"), "node")
    with Scratch(spark) as scratch:
        pointers = scratch.cut(links.where("node is not null").groupBy("node").agg(F.min("parent").alias("to")).where("to is not null"))
        span = 1
        while span < limit:
            walkers = found.select("depth", F.lit(None).cast(kind).alias("from"), F.col("node").alias("at"))
            if 2 * span < limit:  # a last round moves only what is found
                walkers = walkers.unionByName(pointers.select(F.lit(None).cast("int").alias("depth"), F.col("node").alias("from"), F.col("to").alias("at")))
            moved = scratch.cut(walkers.join(pointers, F.col("at") == F.col("node")).select(F.col("depth") + span, "from", "to").toDF("depth", "from", "to"))
            found = found.unionByName(moved.where("depth is not null").select("depth", F.col("to").alias("node")))
            pointers = moved.where("depth is null").select(F.col("from").alias("node"), "to")
            span *= 2
        # a node has one parent, so from the first repeat on all are repeats
        return cut(found.where(F.col("depth") < limit).groupBy("node").agg(F.min("depth").alias("depth")).select("depth", "node"))


def clamp(value: Column) -> Column:
    return F.least(value, F.lit(1.0))


def blast_radius(edges: DataFrame) -> DataFrame:
    """Each target with its number of distinct consumers and a class of it."""
    n = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("consumers"))
    level = F.when(F.col("consumers") <= 1, "low").when(F.col("consumers") <= 5, "medium").when(F.col("consumers") <= 15, "high").otherwise("critical")
    return n.withColumn("blast_radius", level)


def plan_context(edges: DataFrame, seeds: DataFrame, *, hops: int = 2, per_node: int = 50, limit: int = 60) -> DataFrame:
    """Seeds (node, score) and what is within some hops of them, with degrees; neighbours score 0.01."""
    both = both_ways(edges)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    few = both.withColumn("place", place).where(F.col("place") <= per_node).select("src", "dst")
    near = bfs(few, seeds.select("node"), max_depth=hops)
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    out = near.join(seeds, "node", "left").join(degree, "node", "left")
    out = out.select("node", "depth", F.coalesce("score", F.lit(0.01)).alias("score"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    return out.orderBy(F.desc("score"), "depth", "node").limit(limit)
