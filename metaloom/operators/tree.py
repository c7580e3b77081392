"""Table occurrences in the relationship graph: classes by what their branches lead to, and usage by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import edges
from .graph import cut, walk


def prune(edges_: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops unused leaves (nodes with one neighbour at most) again and again; edges_ (a, b) in both directions, used (node).

    Returns the remaining edges and the dropped ones (node, toward: the neighbour by which it hung). What remains lies between used
    nodes or on a cycle. A round touches what the last one left; rounds are as many as the longest unused branch, however many branches there are.
    """
    left, gone = edges_, None
    while True:
        leaves = left.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("b").alias("toward")).where("n = 1")
        leaves = cut(leaves.join(used, "node", "left_anti").select("node", "toward"))
        if leaves.isEmpty():
            return left, gone if gone is not None else leaves
        gone = leaves if gone is None else gone.unionByName(leaves)
        out = leaves.select("node")
        left = cut(left.join(out, left["a"] == out["node"], "left_anti").join(out, F.col("b") == out["node"], "left_anti"))


def classes(nodes: DataFrame, edges_: DataFrame, used: DataFrame, cascaded: DataFrame) -> DataFrame:
    """Class of every node (node): used directly; bridge of relationships by cascading rules alone; and of the others by their branches with use:
    bridge (two or more), dead_branch (one), dead_island (none), unused where it has no relationship at all.

    edges_ (a, b) need not be in both directions; loops and repeated ones take no part. On trees branches are exact; a node on a cycle counts as bridge
    where its component has a use.
    """
    pairs = edges_.where("a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    used = used.select("node").distinct()
    left, gone = prune(both, used)
    reached = walk(both, used, None).select("node", F.lit(True).alias("reached"))
    staying = left.select(F.col("a").alias("node")).union(used).distinct().withColumn("stays", F.lit(True))
    out = nodes.select("node").distinct().join(used.withColumn("direct", F.lit(True)), "node", "left").join(cascaded.select("node").distinct().withColumn("by_rule", F.lit(True)), "node", "left")
    out = out.join(both.select(F.col("a").alias("node")).distinct().withColumn("linked", F.lit(True)), "node", "left").join(reached, "node", "left").join(staying, "node", "left")
    kind = F.when(F.col("direct"), "used").when(F.col("by_rule"), "relationship_bridge").when(F.col("linked").isNull(), "unused").when(F.col("reached").isNull(), "dead_island")
    return out.select("node", kind.when(F.col("stays"), "bridge").otherwise("dead_branch").alias("to_class"))


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as occurrences: a node hangs below a third of its number, but for some that begin an island."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    links = c.where("node >= 3 and node % 7 <> 0").select(F.col("node").alias("a"), F.expr("node div 3").alias("b"))
    return c, links, c.where("node % 23 = 0"), c.where("node % 29 = 0")


def to_class(spark: SparkSession, d: str) -> DataFrame:
    return classes(*_forest(spark, d))


def to_usage(spark: SparkSession, d: str) -> DataFrame:
    """References to each table occurrence by category (role, and what uses it), with the number of users."""
    links = edges.object_links(edges.relations(spark, d, ("relationships", "fields", "layouts", "layout_objects", "steps", "value_lists")))
    mine = links.where("target_type = 'TableOccurrence'").select("target_uuid", F.concat_ws(":", "source_type", "link_role", "link_subrole").alias("category"), "source_uuid")
    return mine.groupBy(F.col("target_uuid").alias("occurrence"), "category").agg(F.count("*").alias("n"), F.count_distinct("source_uuid").alias("users"))


QUERIES = {f.__name__: f for f in (to_class, to_usage)}
_TO = ("relationships", "fields", "layouts", "layout_objects", "steps", "value_lists")
ORACLE_SQL = {
    "to_class": """WITH RECURSIVE p AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey >= 3 AND c_custkey % 7 <> 0), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
w(candidate, branch, node) AS (SELECT a, b, b FROM e WHERE a % 23 <> 0 AND a % 29 <> 0 UNION SELECT w.candidate, w.branch, e.b FROM w JOIN e ON e.a = w.node WHERE e.b <> w.candidate),
k AS (SELECT candidate, count(DISTINCT branch) FILTER (node % 23 = 0) AS branches FROM w GROUP BY 1)
SELECT c_custkey AS node, CASE WHEN c_custkey % 23 = 0 THEN 'used' WHEN c_custkey % 29 = 0 THEN 'relationship_bridge' WHEN k.candidate IS NULL THEN 'unused' WHEN branches >= 2 THEN 'bridge' WHEN branches = 1 THEN 'dead_branch' ELSE 'dead_island' END AS to_class
FROM customer LEFT JOIN k ON k.candidate = c_custkey""",
    "to_usage": edges._links_sql(_TO) + " SELECT target_uuid AS occurrence, concat_ws(':', source_type, link_role, link_subrole) AS category, count(*) AS n, count(DISTINCT source_uuid) AS users FROM links WHERE target_type = 'TableOccurrence' GROUP BY ALL",
}
