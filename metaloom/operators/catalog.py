"""Catalog operators: typed unions, where-used, usage classes, clone arbitration, homes, logical links, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import LINKS_SQL, OBJECTS_SQL, links, load, nations, objects


def object_catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).groupBy("object_type", "file_name").agg(F.count("*").alias("n_objects"), F.count_distinct("object_name").alias("n_names"))


def where_used_top(spark: SparkSession, d: str) -> DataFrame:
    """Objects with the most distinct users, a top-50 report."""
    used = links(spark, d).where("link_kind = 'usage'").groupBy("target_uuid", "target_type").agg(F.count_distinct("source_uuid").alias("n_users"), F.count("*").alias("n_links"))
    return used.orderBy(F.desc("n_users"), F.desc("n_links"), "target_uuid").limit(50)


def object_usage_class(spark: SparkSession, d: str) -> DataFrame:
    """Users, roles and usage class of every object; objects without any usage are entries when they use others, else unused."""
    every = links(spark, d).where("link_kind = 'usage'")
    used = every.groupBy(F.col("target_uuid").alias("object_uuid")).agg(F.count_distinct("source_uuid").alias("n_users"), F.array_join(F.array_sort(F.collect_set("link_role")), ",").alias("roles"))
    using = every.groupBy(F.col("source_uuid").alias("object_uuid")).agg(F.count("*").alias("n_uses"))
    out = objects(spark, d).select("object_uuid", "object_type").join(used, "object_uuid", "left").join(using, "object_uuid", "left")
    kind = F.when(F.col("n_users") > 0, "used").when(F.col("n_uses") > 0, "entry").otherwise("unused")
    return out.select("object_uuid", "object_type", F.coalesce("n_users", F.lit(0)).alias("n_users"), F.coalesce("roles", F.lit("")).alias("roles"), kind.alias("usage_class"))


def unused_parts_in_year(spark: SparkSession, d: str) -> DataFrame:
    """Parts without a reference in the shipments of the last year."""
    items = load(spark, d, "lineitem")
    last = F.broadcast(items.agg(F.max(F.year("l_shipdate")).alias("y")))
    recent = items.join(last, F.year("l_shipdate") == F.col("y"), "left_semi").select("l_partkey")
    return load(spark, d, "part").join(recent, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name", "p_brand")


def _supply(spark: SparkSession, d: str) -> DataFrame:
    """Order-to-supplier links with the files of both ends."""
    home = F.broadcast(nations(spark, d).select("n_nationkey", F.col("r_name").alias("file")))
    orders = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(home, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("file").alias("source_file"))
    suppliers = load(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("file").alias("target_file"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", "source_file", "target_file")


_SUPPLY_SQL = """supply AS (SELECT DISTINCT l_orderkey, l_suppkey, hc.r_name AS source_file, hs.r_name AS target_file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN home hs ON s_nationkey = hs.n_nationkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN home hc ON c_nationkey = hc.n_nationkey)"""


def links_with_prefer_local(spark: SparkSession, d: str) -> DataFrame:
    """Of a source's links the ones to its own file, if there are any; else all."""
    own = Window.partitionBy("l_orderkey")
    local = (F.col("source_file") == F.col("target_file")).cast("int")
    return _supply(spark, d).withColumn("local", local).withColumn("any_local", F.max("local").over(own)).where("local = any_local").select("l_orderkey", "l_suppkey", "source_file", "target_file")


def arbitrate(links: DataFrame, key: list[str], target_file: str, source_file: str, declared: str) -> DataFrame:
    """Edge arbitration among links that agree in the key: those to the source's own file, if there are any; else those to the one declared file,
    if exactly one of the group's files is declared; else all stay (kept across files). `declared` says whether the link's target file is declared."""
    group = Window.partitionBy(*key)
    local = F.coalesce((F.col(source_file) == F.col(target_file)).cast("int"), F.lit(0))
    files = F.size(F.collect_set(F.when(F.col(declared), F.col(target_file))).over(group))
    out = links.withColumn("_local", local).withColumn("_any", F.max("_local").over(group)).withColumn("_files", files)
    kept = F.when(F.col("_any") == 1, F.col("_local") == 1).when(F.col("_files") == 1, F.coalesce(F.col(declared), F.lit(False))).otherwise(F.lit(True))
    out = out.where(kept).withColumn("arbitration", F.when(F.col("_any") == 1, "local").when(F.col("_files") == 1, "declared").otherwise("kept"))
    return out.drop("_local", "_any", "_files")


def links_prefer_declared(spark: SparkSession, d: str) -> DataFrame:
    """Of an order's links the ones to its own file; else those to the one file that its file declares as a source; else all."""
    declared = F.substring("target_file", 1, 1).isin("A", "E") & (F.col("source_file") != "ASIA")
    return arbitrate(_supply(spark, d).withColumn("declared", declared), ["l_orderkey"], "target_file", "source_file", "declared").select("l_orderkey", "l_suppkey", "source_file", "target_file", "arbitration")


def object_homes(spark: SparkSession, d: str) -> DataFrame:
    """Home segment of each nation: the one with most customers."""
    counts = load(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_fields"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n_fields"), "c_mktsegment"))).where("r = 1").drop("r")


def logical_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders hoisted to their customers: customer to part and supplier, distinct."""
    items = load(spark, d, "lineitem").join(load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    to = lambda kind, key: items.select(F.col("o_custkey").alias("source_key"), F.lit(kind).alias("target_type"), F.col(key).alias("target_key"))
    return to("Part", "l_partkey").unionByName(to("Supplier", "l_suppkey")).distinct()


def node_universe(spark: SparkSession, d: str) -> DataFrame:
    ends = logical_links(spark, d).select(F.explode(F.array(F.struct(F.lit("Customer").alias("node_type"), F.col("source_key").alias("node_key")), F.struct(F.col("target_type").alias("node_type"), F.col("target_key").alias("node_key")))).alias("e"))
    return ends.select("e.*").distinct()


def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose neighbours span at least four files and lie in their own file to at most 40 percent."""
    by = _supply(spark, d).groupBy("l_suppkey").agg(F.count_distinct("source_file").alias("n_files"), F.avg((F.col("source_file") == F.col("target_file")).cast("double")).alias("own"))
    return by.where("n_files >= 4 and own <= 0.4").select("l_suppkey", "n_files", F.round("own", 6).alias("own_share"))


def duplicate_census(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("survivor")).where("n > 1")


def heal_twins(spark: SparkSession, d: str) -> DataFrame:
    """Rows that share a text keep its digest if they are the first, and get a replacement digest otherwise."""
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    healed = F.when(F.col("doc_id") == F.col("first"), F.col("digest")).otherwise(F.md5(F.concat_ws("::", "digest", F.col("doc_id").cast("string"))))
    first = first.withColumnRenamed("digest", "_digest")
    return docs.join(first, F.col("digest").eqNullSafe(F.col("_digest"))).select("doc_id", healed.alias("healed_uuid"), (F.col("doc_id") != F.col("first")).alias("is_healed"))


def heal_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Healed digests carried into a table that refers to the documents."""
    return load(spark, d, "labels").join(heal_twins(spark, d), "doc_id", "left").select("doc_id", "quality", "healed_uuid")


def usage_by_category(spark: SparkSession, d: str) -> DataFrame:
    used = links(spark, d).where("link_kind = 'usage'").select(F.col("target_uuid").alias("object_uuid")).groupBy("object_uuid").agg(F.count("*").alias("n"))
    every = objects(spark, d).join(used, "object_uuid", "left")
    return every.groupBy("object_type").agg(F.count("*").alias("n_objects"), F.count("n").alias("n_used"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"), F.coalesce(F.max("n"), F.lit(0)).alias("most_links"))


def full_join_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Order counts of each customer in two years side by side; absent on one side is null."""
    orders = load(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    a, b = (orders.where(F.col("y") == y).select("o_custkey", F.col("n").alias(name)) for y, name in ((1995, "n_before"), (1996, "n_after")))
    return a.join(b, "o_custkey", "full").select("o_custkey", "n_before", "n_after", F.when(F.col("n_before").isNull(), "added").when(F.col("n_after").isNull(), "removed").when(F.col("n_before") == F.col("n_after"), "same").otherwise("changed").alias("state"))


def check_orphans(spark: SparkSession, d: str) -> DataFrame:
    known = objects(spark, d).select("object_uuid")
    every = links(spark, d)
    bad = every.join(known, F.col("target_uuid") == F.col("object_uuid"), "left_anti").groupBy("link_role").agg(F.count("*").alias("n"))
    return every.groupBy("link_role").agg(F.count("*").alias("n_links")).join(bad, "link_role", "left").select("link_role", "n_links", F.coalesce("n", F.lit(0)).alias("n_orphans"))


def check_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Structural roles must have one target for each source."""
    per = links(spark, d).where("link_kind = 'structure'").groupBy("link_role", "source_uuid").agg(F.count_distinct("target_uuid").alias("n"))
    return per.groupBy("link_role").agg(F.count("*").alias("n_sources"), F.count_if(F.col("n") > 1).alias("n_fan_out"))


def check_unregistered_roles(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("parent_region",), ("parent_nation",), ("placed_by",), ("uses_part",)], "link_role string")
    return links(spark, d).join(F.broadcast(registry), "link_role", "left_anti").groupBy("link_role").agg(F.count("*").alias("n_links"))


def check_counts(spark: SparkSession, d: str) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [load(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")])


_W = f"WITH {OBJECTS_SQL}, {LINKS_SQL}, {_SUPPLY_SQL}\n"
QUERIES = {f.__name__: f for f in (object_catalog_counts, where_used_top, object_usage_class, unused_parts_in_year, links_with_prefer_local, links_prefer_declared, object_homes, logical_links, node_universe, god_nodes, duplicate_census, heal_twins, heal_cascade, usage_by_category, full_join_catalogs, check_orphans, check_cardinality, check_unregistered_roles, check_counts)}
_LOGICAL = "SELECT DISTINCT o_custkey AS source_key, 'Part' AS target_type, l_partkey AS target_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT o_custkey, 'Supplier', l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_HEAL = "SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY md5(text)) THEN md5(text) ELSE md5(md5(text) || '::' || doc_id) END AS healed_uuid, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS is_healed FROM documents"
ORACLE_SQL = {
    "object_catalog_counts": _W + "SELECT object_type, file_name, count(*) AS n_objects, count(DISTINCT object_name) AS n_names FROM objects GROUP BY ALL",
    "where_used_top": _W + "SELECT target_uuid, target_type, count(DISTINCT source_uuid) AS n_users, count(*) AS n_links FROM links WHERE link_kind = 'usage' GROUP BY ALL ORDER BY n_users DESC, n_links DESC, target_uuid LIMIT 50",
    "object_usage_class": _W + """, u AS (SELECT target_uuid, count(DISTINCT source_uuid) AS n_users, string_agg(DISTINCT link_role, ',' ORDER BY link_role) AS roles FROM links WHERE link_kind = 'usage' GROUP BY 1)
SELECT object_uuid, object_type, coalesce(n_users, 0) AS n_users, coalesce(roles, '') AS roles, CASE WHEN n_users > 0 THEN 'used' WHEN EXISTS (SELECT 1 FROM links l WHERE l.link_kind = 'usage' AND l.source_uuid = object_uuid) THEN 'entry' ELSE 'unused' END AS usage_class FROM objects LEFT JOIN u ON target_uuid = object_uuid""",
    "unused_parts_in_year": "SELECT p_partkey, p_name, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem))",
    "links_with_prefer_local": _W + "SELECT * FROM supply QUALIFY (source_file = target_file) = bool_or(source_file = target_file) OVER (PARTITION BY l_orderkey)",
    "links_prefer_declared": f"WITH {OBJECTS_SQL.split(', objects')[0] if ', objects' in OBJECTS_SQL else OBJECTS_SQL.split(',' + chr(10) + 'objects')[0]}, {_SUPPLY_SQL}, f AS (SELECT *, left(target_file, 1) IN ('A', 'E') AND source_file <> 'ASIA' AS declared, source_file = target_file AS is_local FROM supply), g AS (SELECT l_orderkey, bool_or(is_local) AS any_local, count(DISTINCT target_file) FILTER (declared) AS files FROM f GROUP BY 1) SELECT f.l_orderkey, l_suppkey, source_file, target_file, CASE WHEN any_local THEN 'local' WHEN files = 1 THEN 'declared' ELSE 'kept' END AS arbitration FROM f JOIN g ON f.l_orderkey = g.l_orderkey WHERE CASE WHEN any_local THEN is_local WHEN files = 1 THEN declared ELSE true END",
    "object_homes": "SELECT c_nationkey, c_mktsegment, n_fields FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n_fields FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n_fields DESC, c_mktsegment) = 1",
    "logical_links": _LOGICAL,
    "node_universe": f"WITH l AS ({_LOGICAL}) SELECT 'Customer' AS node_type, source_key AS node_key FROM l UNION SELECT target_type, target_key FROM l",
    "god_nodes": _W + "SELECT l_suppkey, count(DISTINCT source_file) AS n_files, round(avg(CASE WHEN source_file = target_file THEN 1.0 ELSE 0.0 END), 6) AS own_share FROM supply GROUP BY 1 HAVING n_files >= 4 AND avg(CASE WHEN source_file = target_file THEN 1.0 ELSE 0.0 END) <= 0.4",
    "duplicate_census": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS survivor FROM documents GROUP BY 1 HAVING count(*) > 1",
    "heal_twins": _HEAL,
    "heal_cascade": f"WITH h AS ({_HEAL}) SELECT l.doc_id, quality, healed_uuid FROM labels l LEFT JOIN h ON h.doc_id = l.doc_id",
    "usage_by_category": _W + ", u AS (SELECT target_uuid, count(*) AS n FROM links WHERE link_kind = 'usage' GROUP BY 1) SELECT object_type, count(*) AS n_objects, count(n) AS n_used, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_links, coalesce(max(n), 0) AS most_links FROM objects LEFT JOIN u ON target_uuid = object_uuid GROUP BY 1",
    "full_join_catalogs": "WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT * FROM o WHERE y = 1995), b AS (SELECT * FROM o WHERE y = 1996) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS n_before, b.n AS n_after, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey",
    "check_orphans": _W + "SELECT link_role, count(*) AS n_links, count(*) FILTER (NOT EXISTS (SELECT 1 FROM objects o WHERE o.object_uuid = target_uuid)) AS n_orphans FROM links GROUP BY 1",
    "check_cardinality": _W + "SELECT link_role, count(*) AS n_sources, count(*) FILTER (n > 1) AS n_fan_out FROM (SELECT link_role, source_uuid, count(DISTINCT target_uuid) AS n FROM links WHERE link_kind = 'structure' GROUP BY ALL) GROUP BY 1",
    "check_unregistered_roles": _W + "SELECT link_role, count(*) AS n_links FROM links WHERE link_role NOT IN ('parent_region', 'parent_nation', 'placed_by', 'uses_part') GROUP BY 1",
    "check_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")),
}
