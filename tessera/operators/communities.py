"""Communities of a weighted graph by local moving, splitting and contraction, and names for them.

A node moves to the neighbouring community where modularity gains most. Moves are made in rounds, all at once: in a
round every community is either one that gives nodes or one that takes them, by a hash of its name and the round, and a move is
made only if its gain is left when every other move into the same or out of the same community is charged against
it; the one that gains most is always made. So each round raises modularity, whatever is made together. When no move is left, communities that aren't connected are split
and each becomes one node of a smaller graph, whose nodes move in turn.

Defined results: a node without edges to others is no part of the result; loops are ignored; weights below 1 count as 1, else
their whole part; edges count in both directions and add up; an empty graph gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import components, connected
from tessera.sources.shared import Scratch, cut

#: Gains in units of 2 / m2 ** 2 that rounding may make.
NOISE = 1e-9
#: Links up to which a graph's rounds take longer to plan than to run.
FEW = 500_000


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of both directions, without loops."""
    w = edges.where("src <> dst").select("src", "dst", F.greatest(F.lit(1), F.floor("usage")).cast("double").alias("w"))
    return w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def gives(community: Column, turn: int) -> Column:
    """Whether a community gives nodes in this round, or takes them."""
    return F.pmod(F.xxhash64(community, F.lit(turn)), F.lit(2)) == 0


def _gains(links: DataFrame, labels: DataFrame, m2: float, gamma: float, turn: int | None = None) -> DataFrame:
    """(node, k, old, new, gain) of every move to a neighbouring community that gains; of a round, those from a community that gives to one that takes.

    Links that no such move needs leave before the sums. Where links are dealt by src and labels are small, nothing else is shuffled.
    """
    of = labels.select(F.col("node").alias("src"), "k", F.col("community").alias("old"), F.col("all").alias("from_all"))
    to = labels.select(F.col("node").alias("dst"), F.col("community").alias("new"), F.col("all").alias("to_all"))
    near = links.join(of if turn is None else of.where(gives(F.col("old"), turn)), "src").join(to, "dst")
    if turn is not None:
        near = near.where((F.col("old") == F.col("new")) | ~gives(F.col("new"), turn))
    near = near.groupBy(F.col("src").alias("node"), "k", "old", "from_all", "new", "to_all").agg(F.sum("w").alias("w"))
    held = F.sum(F.when(F.col("old") == F.col("new"), F.col("w"))).over(Window.partitionBy("node"))
    gain = m2 * (F.col("w") - F.coalesce("held", F.lit(0.0))) - gamma * F.col("k") * (F.col("to_all") - F.col("from_all") + F.col("k"))
    return near.withColumn("held", held).where("old <> new").select("node", "k", "old", "new", gain.alias("gain")).where(F.col("gain") > NOISE * m2)


def _moved(scratch: Scratch, graph: DataFrame, m2: float, gamma: float, rounds: int) -> DataFrame | None:
    """(node, community) after local moving from single nodes; None if nothing moved."""
    links = graph.where("src <> dst").repartition("src").persist()  # every round reads them by src
    links.count()
    labels = scratch.cut(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", "k", F.col("node").alias("community"), F.col("k").alias("all")))
    moved = False
    for turn in range(rounds):
        best = _gains(links, labels, m2, gamma, turn).groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "new", "old", "k")).alias("b"))
        best = best.select("node", "b.new", "b.old", "b.k", (-F.col("b.loss")).alias("gain")).persist()
        first = best.agg(F.min(F.struct((-F.col("gain")).alias("loss"), "node"))["node"]).first()[0]
        if first is not None:
            into, out = (F.sum("k").over(Window.partitionBy(c)) for c in ("new", "old"))
            safe = F.col("gain") > gamma * F.col("k") * (F.col("into") + F.col("out") - 2 * F.col("k"))
            made = best.withColumn("into", into).withColumn("out", out).where(safe | (F.col("node") == F.lit(first))).select("node", "new")
            labels = labels.join(made, "node", "left").select("node", "k", F.coalesce("new", "community").alias("community"))
            labels = scratch.cut(labels.withColumn("all", F.sum("k").over(Window.partitionBy("community"))))
            moved = True
        best.unpersist()
    if not moved:  # no two communities that met fell on different sides
        one = scratch.cut(_gains(links, labels, m2, gamma).orderBy(F.desc("gain"), "node", "new").limit(1).select("node", "new"))
        moved = not one.isEmpty()
        labels = labels.join(one, "node", "left").select("node", F.coalesce("new", "community").alias("community"))
    links.unpersist()
    return labels.select("node", "community") if moved else None


def split(scratch: Scratch, graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, community): each community's connected parts, named by their least node."""
    of, to = labels.select(F.col("node").alias("src"), F.col("community").alias("cs")), labels.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    inside = graph.where("src <> dst").join(of, "src").join(to, "dst").where("cs = cd").select("src", "dst")
    parts = scratch.cut(connected(scratch, scratch.cut(inside)).select("node", F.col("component").alias("community")))
    return parts.unionByName(labels.join(parts, "node", "left_anti").select("node", F.col("node").alias("community")))


def _steady(spark: SparkSession) -> SparkSession:
    """A session beside this one for graphs whose rounds take longer to plan than to run: few partitions, and each plan is made once."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "4")
    return own


def communities(edges: DataFrame, *, gamma: float = 1.0, rounds: int = 6, levels: int = 24) -> DataFrame:
    """(node, community) of edges (src, dst, usage), each community named by its least node.

    ``rounds`` is the number of rounds of a level and ``levels`` bounds the levels; it ends when no node of the contracted graph gains by moving.
    """
    with Scratch(edges.sparkSession) as whole, Scratch(_steady(edges.sparkSession)) as few:
        scratch, graph = whole, whole.cut(undirected(edges))
        members = graph.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
        m2 = graph.agg(F.sum("w")).first()[0] or 0.0
        for level in range(levels if m2 else 0):
            if scratch is whole and graph.count() <= FEW:
                scratch, graph = few, few.cut(graph)
            labels = _moved(scratch, graph, m2, gamma, rounds)
            if labels is None:
                break
            labels = scratch.cut(split(scratch, graph, labels))
            of, to = labels.select(F.col("node").alias("src"), F.col("community").alias("cs")), labels.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
            members = members.join(labels.select(F.col("node").alias("community"), F.col("community").alias("now")), "community").select("node", F.col("now").alias("community"))
            if level % 6 == 5:  # plans stay short
                members = whole.cut(members)
            graph = scratch.cut(graph.join(of, "src").join(to, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))
        return cut(members)


def ranked(scratch: Scratch, rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place from 1 by ``order``, numbered within ranges of it that follow each other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.cut(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    ahead = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_place", place).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_place")).drop("_range", "_place", "_ahead")


def _slug(directory: Column, fallback: Column) -> Column:
    """The directory without ``src/`` in front and slashes around, or the fallback."""
    plain = F.regexp_replace(F.regexp_replace(directory, "^src/", ""), "^/+|/+$", "")
    return F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(fallback)


def _dominant(rows: DataFrame, key: str) -> DataFrame:
    """The most frequent directory of each group, of equal ones the least."""
    counts = rows.groupBy(key, "directory").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by("directory", F.struct((-F.col("n")).alias("n"), "directory")).alias("directory"))


def cluster_names(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, name) of communities (community, file_path) within the components of the graph of edges (src, dst) between files.

    A component is named by its dominant directory, or by its number in the order of least files. A community that is alone in its component has
    that name; others have it in front of their own dominant directory, or of their number where that says nothing new. Of equal names, in
    the order of components and least files, the second and later get the next number from 2 on that makes no name that another has.
    """
    with Scratch(members.sparkSession) as scratch:
        whole = scratch.cut(components(edges.where("src <> dst").select("src", "dst")).select(F.col("node").alias("file_path"), F.col("component")))
        placed = members.join(whole, "file_path", "left").withColumn("component", F.coalesce("component", "file_path"))
        folder = F.regexp_replace(F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(""), r"^\./+", "")
        placed = placed.withColumn("directory", folder)
        own = scratch.cut(placed.groupBy("community").agg(F.min("file_path").alias("least"), F.min_by("component", "file_path").alias("component")))
        placed = placed.drop("component").join(own.select("community", "component"), "community")
        parents = own.groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("children")).join(_dominant(placed, "component"), "component")
        parents = ranked(scratch, parents, "least", "number").select("component", "children", "number", _slug(F.col("directory"), F.concat(F.lit("cluster-"), F.col("number"))).alias("parent"))
        child = F.row_number().over(Window.partitionBy("component").orderBy("least"))
        rows = own.withColumn("child", child).join(parents, "component").join(_dominant(placed, "community"), "community")
        said = _slug(F.col("directory"), F.concat_ws("-", F.lit("cluster"), "number", "child"))
        told = F.when((said == F.col("parent")) | said.startswith(F.concat("parent", F.lit("/"))), F.concat(F.lit("cluster-"), F.col("child"))).otherwise(said)
        base = F.when(F.col("children") == 1, F.col("parent")).otherwise(F.concat_ws("/", "parent", told))
        rows = scratch.cut(rows.select("community", "number", "child", base.alias("base")))
        numbered = rows.withColumn("again", F.row_number().over(Window.partitionBy("base").orderBy("number", "child")))
        taken = rows.select(F.regexp_extract("base", r"^(.+)-(\d{1,9})$", 1).alias("base"), F.regexp_extract("base", r"^(.+)-(\d{1,9})$", 2).alias("n")).where("base <> ''")
        taken = taken.groupBy("base").agg(F.collect_set(F.col("n").cast("int")).alias("taken"))
        free = F.filter(F.sequence(F.lit(2), F.col("again") + 1 + F.coalesce(F.size("taken"), F.lit(0))), lambda n: ~F.coalesce(F.array_contains("taken", n), F.lit(False)))
        named = numbered.where("again > 1").join(taken, "base", "left").select("community", F.concat_ws("-", "base", F.element_at(free, F.col("again") - 1).cast("string")).alias("name"))
        return cut(numbered.where("again = 1").select("community", F.col("base").alias("name")).unionByName(named))
