"""Graph operators: walks, depth profiles, closures, meta graphs, communities, naming votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load, nations


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which keeps plans of loops short and survives lost executors; the folder must be set."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        raise ValueError("spark.checkpoint.dir is unset: loops are cut in a folder that the driver and all executors share")
    return df.checkpoint()


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """Nodes (node, depth) within `depth` steps of the seeds (node) along edges (a, b), at their least depth; without depth all that can be reached.

    A round joins only the last round's nodes and drops those seen before, so cycles end; each round is written, and an empty one is the last.
    """
    seen = front = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    k = 0
    while depth is None or k < depth:
        k += 1
        met = edges.join(front.select("node"), edges["a"] == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        front = cut(met.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """All (source, ancestor, distance: the least) along edges (a, b) from the sources (node), whatever their depth; cycles end."""
    front = cut(edges.join(sources, edges["a"] == sources["node"]).select(F.col("a").alias("source"), F.col("b").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct())
    seen, k = front, 1
    while not front.isEmpty():
        k += 1
        met = front.join(edges, front["ancestor"] == edges["a"]).select("source", F.col("b").alias("ancestor"), F.lit(k).cast("long").alias("distance")).distinct()
        front = cut(met.join(seen, ["source", "ancestor"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Customer and supplier nodes joined by an order, both directions."""
    big = load(spark, d, "lineitem").join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = big.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("s1").alias("node"))


def subgraph_k_hop(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two steps of a supplier, with their degree in the whole graph."""
    edges = _trade(spark, d)
    return walk(edges, _seeds(spark), 2).join(edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")), "node", "left").select("node", F.col("depth").cast("long").alias("depth"), F.coalesce("degree", F.lit(0)).alias("degree"))


def depth_profile(spark: SparkSession, d: str) -> DataFrame:
    return walk(_trade(spark, d), _seeds(spark), 4).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n_nodes"))


def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the nodes of the two-step subgraph, each once."""
    edges, nodes = _trade(spark, d), walk(_trade(spark, d), _seeds(spark), 2).select("node")
    return edges.where("a < b").join(nodes, F.col("a") == F.col("node"), "left_semi").join(nodes, F.col("b") == F.col("node"), "left_semi")


def trace_flow(spark: SparkSession, d: str) -> DataFrame:
    """From one customer's orders to the parts they touch and on to the suppliers of these, with the stage that reached each first."""
    orders = load(spark, d, "orders").where("o_custkey = 1").select("o_orderkey")
    items = load(spark, d, "lineitem")
    own = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    parts = own.select("l_partkey").distinct()
    others = items.join(parts, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("key")).distinct()
    stages = [orders.select(F.lit(1).alias("stage"), F.lit("Order").alias("kind"), F.col("o_orderkey").alias("key")), parts.select(F.lit(2), F.lit("Part"), "l_partkey"), own.select(F.lit(2), F.lit("Supplier"), "l_suppkey"), others.select(F.lit(3), F.lit("Supplier"), "key")]
    out = stages[0]
    for s in stages[1:]:
        out = out.union(s)
    return out.groupBy("kind", "key").agg(F.min("stage").alias("stage"))


def topology_meta_graph(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges between regions, weighted by orders across them."""
    home = F.broadcast(nations(spark, d).select("n_nationkey", "r_name"))
    c = load(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("x"))
    s = load(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("y"))
    every = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return every.where("x <> y").groupBy(F.least("x", "y").alias("segment_a"), F.greatest("x", "y").alias("segment_b")).agg(F.count("*").alias("n_links"), F.count_distinct("l_orderkey").alias("n_orders"))


def fk_closure(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of the suppliers along foreign keys, with their distance."""
    up = load(spark, d, "supplier").select(F.concat(F.lit("Supplier::"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("Nation::"), F.col("s_nationkey").cast("string")).alias("b")).union(load(spark, d, "nation").select(F.concat(F.lit("Nation::"), F.col("n_nationkey").cast("string")), F.concat(F.lit("Region::"), F.col("n_regionkey").cast("string"))))
    return closure(up, load(spark, d, "supplier").select(F.concat(F.lit("Supplier::"), F.col("s_suppkey").cast("string")).alias("node")))


def community_names(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's most frequent segment, ties by name, and the eight customers with most orders."""
    by = load(spark, d, "customer").join(load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("degree")), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    mode = by.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment"))).where("r = 1").select("c_nationkey", F.col("c_mktsegment").alias("name"))
    top = by.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("degree"), "c_name"))).where("r <= 8")
    labels = top.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c_name"))), lambda x: x["c_name"]), ",").alias("labels"))
    return mode.join(labels, "c_nationkey")


def vote(shares: DataFrame, purity: float = 0.6, coverage: float = 0.5) -> DataFrame:
    """One-to-one names for clusters from shares (cluster, name, n): the name with most votes, if it has a share of the cluster (purity)
    and the cluster a share of the name (coverage); of several clusters with one name that with most votes keeps it. Ties go by cluster and name."""
    total = lambda c: F.sum("n").over(Window.partitionBy(c))
    best = lambda c, tie: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("n"), tie))
    ranked = shares.withColumn("purity", F.col("n") / total("cluster")).withColumn("coverage", F.col("n") / total("name"))
    ranked = ranked.withColumn("a", best("cluster", "name")).where("a = 1").where((F.col("purity") >= purity) & (F.col("coverage") >= coverage))
    return ranked.withColumn("b", best("name", "cluster")).where("b = 1").select("cluster", "name", "n", F.round("purity", 6).alias("purity"), F.round("coverage", 6).alias("coverage"))


def name_vote(spark: SparkSession, d: str) -> DataFrame:
    """Names of the nations of customers by their orders, some of which have drifted to the next name."""
    drift = F.when(F.col("o_orderkey") % 10 < F.col("c_nationkey") % 6, 1).otherwise(0)
    by = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return vote(by.groupBy(F.col("c_nationkey").alias("cluster"), F.concat(F.lit("N"), (F.col("c_nationkey") + drift).cast("string")).alias("name")).agg(F.count("*").alias("n")))


def communities(spark: SparkSession, d: str) -> DataFrame:
    """Label propagation over the trade graph, four rounds: a node takes its neighbours' most frequent label, the smallest at a tie."""
    edges = cut(_trade(spark, d))
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(4):
        seen = edges.join(labels, edges["b"] == F.col("node")).groupBy("a", "label").agg(F.count("*").alias("n"))
        labels = cut(seen.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")))
    return labels


def modularity_moves(edges: DataFrame, rounds: int = 8, resolution: float = 1.0) -> DataFrame:
    """Communities (node, label) of weighted edges (a, b, w; both directions) by the local moves of the Louvain method, done for all nodes of a half at once.

    In a round the nodes of one half, by a hash of node and round, move to the neighbouring community with the largest gain in modularity
    (ties to the smallest label), so that neighbours don't swap for ever; community sums are aggregated anew. It ends when both halves stay.
    """
    edges = cut(edges)
    strength = cut(edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    labels, still = strength.select("node", F.col("node").alias("label")), 0
    for turn in range(2 * rounds):
        of = labels.join(strength, "node")
        sums = of.groupBy("label").agg(F.sum("k").alias("size"))
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        own = of.select("node", F.col("label").alias("now"), "k")
        every = near.join(own, "node").unionByName(own.select("node", F.col("now").alias("label"), F.lit(0.0).alias("w"), "now", "k")).groupBy("node", "label", "now", "k").agg(F.sum("w").alias("w"))
        rest = F.col("size") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / total, 9)
        best = every.join(sums, "label").groupBy("node", "now").agg(F.min_by("label", F.struct(-gain, "label")).alias("best"))
        mine = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        labels = cut(best.select("node", F.when(mine, F.col("best")).otherwise(F.col("now")).alias("label"), (mine & (F.col("best") != F.col("now"))).alias("moved")))
        still = 0 if labels.where("moved").limit(1).count() else still + 1
        labels = labels.select("node", "label")
        if still == 2:
            break
    return labels


QUERIES = {f.__name__: f for f in (subgraph_k_hop, depth_profile, subgraph_edges, trace_flow, topology_meta_graph, fk_closure, community_names, name_vote, communities)}
_TRADE = "p AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)"
_WALK = f"WITH RECURSIVE {_TRADE}, w(node, depth) AS (SELECT 's1', 0 UNION SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.node WHERE depth < %d), m AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY 1)"
_LABELS = f"WITH {_TRADE}, l0 AS (SELECT DISTINCT a AS node, a AS label FROM e)" + "".join(f", n{i} AS (SELECT e.a AS node, l.label, count(*) AS n FROM e JOIN l{i - 1} l ON e.b = l.node GROUP BY ALL), l{i} AS (SELECT node, label FROM n{i} QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)" for i in range(1, 5)) + " SELECT node, label FROM l4"
ORACLE_SQL = {
    "subgraph_k_hop": _WALK % 2 + " SELECT node, depth, (SELECT count(*) FROM e WHERE a = node) AS degree FROM m",
    "depth_profile": _WALK % 4 + " SELECT depth, count(*) AS n_nodes FROM m GROUP BY 1",
    "subgraph_edges": _WALK % 2 + " SELECT a, b FROM e WHERE a < b AND a IN (SELECT node FROM m) AND b IN (SELECT node FROM m)",
    "trace_flow": "WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey = 1), i AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), s AS (SELECT 1 AS stage, 'Order' AS kind, o_orderkey AS key FROM o UNION ALL SELECT 2, 'Part', l_partkey FROM i UNION ALL SELECT 2, 'Supplier', l_suppkey FROM i UNION ALL SELECT 3, 'Supplier', l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM i)) SELECT kind, key, min(stage) AS stage FROM s GROUP BY ALL",
    "topology_meta_graph": "WITH h AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT least(a.r_name, b.r_name) AS segment_a, greatest(a.r_name, b.r_name) AS segment_b, count(*) AS n_links, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN h a ON a.n_nationkey = c_nationkey JOIN h b ON b.n_nationkey = s_nationkey WHERE a.r_name <> b.r_name GROUP BY ALL",
    "fk_closure": "WITH RECURSIVE u AS (SELECT 'Supplier::' || s_suppkey AS a, 'Nation::' || s_nationkey AS b FROM supplier UNION ALL SELECT 'Nation::' || n_nationkey, 'Region::' || n_regionkey FROM nation), c(source, ancestor, distance) AS (SELECT a, b, CAST(1 AS BIGINT) FROM u WHERE a LIKE 'Supplier%' UNION SELECT source, b, distance + 1 FROM c JOIN u ON u.a = c.ancestor) SELECT * FROM c",
    "community_names": "WITH g AS (SELECT c.*, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS degree FROM customer c), m AS (SELECT c_nationkey, c_mktsegment AS name FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1), t AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY degree DESC, c_name) AS r FROM g) SELECT m.c_nationkey, name, string_agg(c_name, ',' ORDER BY r) AS labels FROM m JOIN t ON t.c_nationkey = m.c_nationkey AND r <= 8 GROUP BY ALL",
    "name_vote": "WITH s AS (SELECT c_nationkey AS cluster, 'N' || (c_nationkey + CASE WHEN o_orderkey % 10 < c_nationkey % 6 THEN 1 ELSE 0 END) AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS purity, n / sum(n) OVER (PARTITION BY name) AS coverage FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, name) = 1) SELECT cluster, name, n, round(purity, 6) AS purity, round(coverage, 6) AS coverage FROM r WHERE purity >= 0.6 AND coverage >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, cluster) = 1",
    "communities": _LABELS,
}
