"""Queries over graphs: an import graph of parts and a cyclic graph of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import communities as C
from tessera.operators import graph as G
from tessera.operators import views as V
from tessera.plans.registry import query
from tessera.sources.tables import FILES_SQL, files, FOLLOW_GRAPH_SQL, IMPORTS_SQL, follow_graph, imports, read

_BOTH = "both_ways AS (SELECT src, dst FROM imports UNION SELECT dst, src FROM imports)"


def _reach(edges, start, depth, forward=True):
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""(WITH RECURSIVE r(node, depth) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT e.{b}, r.depth + 1 FROM r JOIN {edges} e ON e.{a} = r.node WHERE r.depth < {depth})
      SELECT node, min(depth) AS depth FROM r GROUP BY node)"""


@query(f"SELECT node, depth FROM {_reach('both_ways', 7, 2)} WHERE depth > 0", IMPORTS_SQL, _BOTH)
def gr_01_neighbors(spark, sf_dir):
    return G.neighbors(imports(spark, sf_dir), 7, depth=2)


@query()
def gr_13_communities(spark, sf_dir):
    return C.communities(follow_graph(spark, sf_dir))


@query(
    """SELECT community, CASE WHEN again = 1 THEN base ELSE base || '-' || again END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY number, child) AS again FROM (
      SELECT community, number, child, CASE WHEN children = 1 THEN parent ELSE parent || '/' || CASE WHEN said = parent OR starts_with(said, parent || '/') THEN 'cluster-' || child ELSE said END END AS base
      FROM (SELECT c.community, r.number, r.children, row_number() OVER (PARTITION BY c.component ORDER BY least) AS child, regexp_replace(r.directory, '^src/', '') AS parent, regexp_replace(c.directory, '^src/', '') AS said
        FROM (SELECT community, any_value(component) AS component, min(file_path) AS least, (SELECT directory FROM placed q WHERE q.community = p.community GROUP BY directory ORDER BY count(*) DESC, directory LIMIT 1) AS directory FROM placed p GROUP BY community) c
        JOIN (SELECT component, row_number() OVER (ORDER BY min(file_path)) AS number, count(DISTINCT community) AS children,
              (SELECT directory FROM placed q WHERE q.component = p.component GROUP BY directory ORDER BY count(*) DESC, directory LIMIT 1) AS directory FROM placed p GROUP BY component) r USING (component))))""",
    FILES_SQL, "placed AS (SELECT id % 37 AS component, id % 37 * 4 + id // 37 % (1 + id % 37 % 4) AS community, file_path, regexp_replace(file_path, '/[^/]*$', '') AS directory FROM files)",
)
def gr_16_two_level_names(spark, sf_dir):
    """Files that import the one 37 numbers on: 37 components, in one to four communities each."""
    own = files(spark, sf_dir).select("id", "file_path")
    kin = F.col("id") % 37
    members = own.select((kin * 4 + F.floor(F.col("id") / 37) % (1 + kin % 4)).alias("community"), "file_path")
    links = own.select(F.col("file_path").alias("src"), (F.col("id") + 37).alias("id")).join(own.select("id", F.col("file_path").alias("dst")), "id").select("src", "dst")
    return C.cluster_names(members, links)


@query("SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i + o) AS BIGINT) AS coupling FROM (SELECT src AS node, 0 AS i, 1 AS o FROM imports UNION ALL SELECT dst, 1, 0 FROM imports) GROUP BY node", IMPORTS_SQL)
def ag_12_degrees(spark, sf_dir):
    return G.degrees(imports(spark, sf_dir))


@query("SELECT dst AS node, count(DISTINCT src) AS consumers, CASE WHEN count(DISTINCT src) <= 1 THEN 'low' WHEN count(DISTINCT src) <= 5 THEN 'medium' WHEN count(DISTINCT src) <= 15 THEN 'high' ELSE 'critical' END AS blast_radius FROM imports GROUP BY dst", IMPORTS_SQL)
def ag_26_blast_radius(spark, sf_dir):
    return G.blast_radius(imports(spark, sf_dir))


@query("SELECT a.p_brand AS source_cluster, b.p_brand AS target_cluster, count(*) AS edges FROM imports i JOIN part a ON a.p_partkey = i.src JOIN part b ON b.p_partkey = i.dst GROUP BY ALL", IMPORTS_SQL)
def jn_19_cluster_rollup(spark, sf_dir):
    of = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return G.rollup(imports(spark, sf_dir), of)


@query("""SELECT CAST(depth AS INTEGER) AS depth, node FROM (WITH RECURSIVE r(depth, node) AS (SELECT 0, max(conv_id) FROM conversations
    UNION ALL SELECT depth + 1, node - 2 FROM r WHERE node > 2 AND depth < 19) SELECT depth, node FROM r)""")
def gr_17_session_chain(spark, sf_dir):
    """Each conversation continues the one two before it; the chain of the latest one."""
    sessions = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("node")).distinct()
    links = sessions.withColumn("parent", F.when(F.col("node") > 2, F.col("node") - 2))
    return G.chain(links, sessions.agg(F.max("node").alias("node")))


@query()
def rf_10_plan_context(spark, sf_dir):
    seeds = spark.createDataFrame([(3, 1.0), (9, 0.8)], "node long, score double")
    return G.plan_context(follow_graph(spark, sf_dir), seeds, hops=1)


# Over the graph of all events. Those without SQL are too slow as recursion; tests hold them against plain versions.


def _nodes(g):
    return g.select(F.col("src").alias("node")).union(g.select("dst"))


@query(f"SELECT DISTINCT src, dst FROM graph WHERE src IN (SELECT node FROM {_reach('graph', 3, 2)}) AND dst IN (SELECT node FROM {_reach('graph', 3, 2)})", FOLLOW_GRAPH_SQL)
def gr_02_subgraph(spark, sf_dir):
    return G.subgraph(follow_graph(spark, sf_dir), 3, depth=2)


@query(
    f"""SELECT src AS node, min(level) AS depth, CAST(sum(usage) AS BIGINT) AS usages, round(sum(usage / level), 6) AS score FROM (
      SELECT e.src, e.usage, n.depth + 1 AS level FROM graph e JOIN {_reach("graph", 5, 3, False)} n ON e.dst = n.node WHERE n.depth < 3 AND e.src <> 5)
    GROUP BY 1 ORDER BY score DESC, usages DESC, node LIMIT 50""",
    FOLLOW_GRAPH_SQL,
)
def gr_04_impact(spark, sf_dir):
    return G.impact(follow_graph(spark, sf_dir), 5, depth=3)


@query()
def gr_05_weighted_trace(spark, sf_dir):
    return G.shortest_path(follow_graph(spark, sf_dir).withColumn("w", 1.0 / F.col("usage")), 3, 9, weight="w", back=1.5, max_hops=None)


@query()
def gr_06_shortest_path(spark, sf_dir):
    return G.shortest_path(follow_graph(spark, sf_dir), 3, 9, max_hops=None)


@query(
    """SELECT node, CASE WHEN regexp_matches(CAST(node AS VARCHAR), '7$') THEN 'seven' WHEN regexp_matches(CAST(node AS VARCHAR), '^1') THEN 'one' ELSE 'no_importers' END AS bucket
    FROM (SELECT src AS node FROM graph UNION SELECT dst FROM graph) WHERE regexp_matches(CAST(node AS VARCHAR), '7$|^1') OR node NOT IN (SELECT dst FROM graph)""",
    FOLLOW_GRAPH_SQL,
)
def gr_07_entrypoints(spark, sf_dir):
    g = follow_graph(spark, sf_dir)
    return G.entrypoints(_nodes(g), g, {"seven": "7$", "one": "^1"})


@query(
    """SELECT node FROM (SELECT src AS node FROM graph UNION SELECT dst FROM graph) WHERE node NOT IN (
      WITH RECURSIVE r(node) AS (SELECT DISTINCT src FROM graph WHERE src % 10 = 1 UNION SELECT e.dst FROM r JOIN graph e ON e.src = r.node) SELECT node FROM r)""",
    FOLLOW_GRAPH_SQL,
)
def gr_08_dead_nodes(spark, sf_dir):
    g = follow_graph(spark, sf_dir)
    return G.dead(_nodes(g), g, g.where("src % 10 = 1").select(F.col("src").alias("node")))


@query()
def gr_10_cycles(spark, sf_dir):
    return G.cycles(follow_graph(spark, sf_dir))


@query()
def gr_11_cycle_sizes(spark, sf_dir):
    parts = G.strong_components(follow_graph(spark, sf_dir))
    return parts.join(parts.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


@query(f"SELECT node, depth FROM {_reach('graph', 4, 30, False)}", FOLLOW_GRAPH_SQL)
def gr_12_transitive_consumers(spark, sf_dir):
    g = follow_graph(spark, sf_dir)
    return G.bfs(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(4,)], "node long"))


@query(
    """SELECT round(sum(coalesce(i.inside, 0) / m2 - (ends / m2) * (ends / m2)), 6) AS q FROM (SELECT c, sum(w) AS ends FROM (SELECT src % 5 AS c, CAST(usage AS DOUBLE) AS w FROM graph UNION ALL SELECT dst % 5, usage FROM graph) GROUP BY c) e
    LEFT JOIN (SELECT src % 5 AS c, 2 * sum(CAST(usage AS DOUBLE)) AS inside FROM graph WHERE src % 5 = dst % 5 GROUP BY 1) i USING (c), (SELECT 2 * sum(CAST(usage AS DOUBLE)) AS m2 FROM graph)""",
    FOLLOW_GRAPH_SQL,
)
def gr_14_modularity(spark, sf_dir):
    g = follow_graph(spark, sf_dir)
    return G.modularity(g.withColumn("w", F.col("usage")), _nodes(g).distinct().withColumn("community", F.col("node") % 5))


@query()
def gr_15_components(spark, sf_dir):
    return G.components(follow_graph(spark, sf_dir))


@query("SELECT node, usage, usage >= 0.75 * max(usage) OVER () AS heavy FROM (SELECT node, CAST(sum(usage) AS BIGINT) AS usage FROM (SELECT src AS node, usage FROM graph UNION ALL SELECT dst, usage FROM graph) GROUP BY 1)", FOLLOW_GRAPH_SQL)
def ag_14_reference_usage(spark, sf_dir):
    return V.usage_marks(follow_graph(spark, sf_dir))
