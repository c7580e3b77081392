"""Source adapter: relational tables as a catalog of typed objects and typed links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid(kind: str, key: Column) -> Column:
    """Stable identity of an object: the digest of its type and key."""
    return F.md5(F.concat(F.lit(f"{kind}::"), key.cast("string")))


def nations(spark: SparkSession, d: str, how: str = "inner") -> DataFrame:
    return load(spark, d, "nation").join(F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), how)


def objects(spark: SparkSession, d: str) -> DataFrame:
    """object_uuid, object_type, object_name, file_name (owning region; null for parts, and for rows whose parent is missing), object_id."""
    home = F.broadcast(nations(spark, d).select("n_nationkey", "r_name"))
    customers = load(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"), "left")

    def of(df: DataFrame, kind: str, key: str, name: Column, file: Column) -> DataFrame:
        return df.select(uuid(kind, F.col(key)).alias("object_uuid"), F.lit(kind).alias("object_type"), name.alias("object_name"), file.cast("string").alias("file_name"), F.col(key).cast("long").alias("object_id"))

    return reduce(DataFrame.unionByName, [
        of(load(spark, d, "region"), "Region", "r_regionkey", F.col("r_name"), F.col("r_name")),
        of(nations(spark, d, "left"), "Nation", "n_nationkey", F.col("n_name"), F.col("r_name")),
        of(customers, "Customer", "c_custkey", F.col("c_name"), F.col("r_name")),
        of(load(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"), "left"), "Supplier", "s_suppkey", F.col("s_name"), F.col("r_name")),
        of(load(spark, d, "part"), "Part", "p_partkey", F.col("p_name"), F.lit(None)),
        of(load(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left"), "Order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.col("r_name")),
    ])


def links(spark: SparkSession, d: str) -> DataFrame:
    """source_uuid, source_type, target_uuid, target_type, link_role, link_kind (usage or structure); one row for each reference."""

    def of(df: DataFrame, source: tuple[str, str], target: tuple[str, str], role: str, kind: str) -> DataFrame:
        return df.select(uuid(source[0], F.col(source[1])).alias("source_uuid"), F.lit(source[0]).alias("source_type"), uuid(target[0], F.col(target[1])).alias("target_uuid"), F.lit(target[0]).alias("target_type"), F.lit(role).alias("link_role"), F.lit(kind).alias("link_kind"))

    items = load(spark, d, "lineitem")
    return reduce(DataFrame.unionByName, [
        of(load(spark, d, "nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "parent_region", "structure"),
        of(load(spark, d, "customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "parent_nation", "structure"),
        of(load(spark, d, "supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "parent_nation", "structure"),
        of(load(spark, d, "orders"), ("Order", "o_orderkey"), ("Customer", "o_custkey"), "placed_by", "usage"),
        of(items, ("Order", "l_orderkey"), ("Part", "l_partkey"), "uses_part", "usage"),
        of(items, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), "uses_supplier", "usage"),
    ])


#: The same relations in DuckDB SQL, for the oracles.
OBJECTS_SQL = """home AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
objects AS (
SELECT md5('Region::' || r_regionkey) AS object_uuid, 'Region' AS object_type, r_name AS object_name, r_name AS file_name, CAST(r_regionkey AS BIGINT) AS object_id FROM region
UNION ALL SELECT md5('Nation::' || n.n_nationkey), 'Nation', n.n_name, h.r_name, n.n_nationkey FROM nation n LEFT JOIN home h ON n.n_nationkey = h.n_nationkey
UNION ALL SELECT md5('Customer::' || c_custkey), 'Customer', c_name, r_name, c_custkey FROM customer LEFT JOIN home ON c_nationkey = n_nationkey
UNION ALL SELECT md5('Supplier::' || s_suppkey), 'Supplier', s_name, r_name, s_suppkey FROM supplier LEFT JOIN home ON s_nationkey = n_nationkey
UNION ALL SELECT md5('Part::' || p_partkey), 'Part', p_name, NULL, p_partkey FROM part
UNION ALL SELECT md5('Order::' || o_orderkey), 'Order', 'Order ' || o_orderkey, r_name, o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN home ON c_nationkey = n_nationkey)"""
LINKS_SQL = """links AS (
SELECT md5('Nation::' || n_nationkey) AS source_uuid, 'Nation' AS source_type, md5('Region::' || n_regionkey) AS target_uuid, 'Region' AS target_type, 'parent_region' AS link_role, 'structure' AS link_kind FROM nation
UNION ALL SELECT md5('Customer::' || c_custkey), 'Customer', md5('Nation::' || c_nationkey), 'Nation', 'parent_nation', 'structure' FROM customer
UNION ALL SELECT md5('Supplier::' || s_suppkey), 'Supplier', md5('Nation::' || s_nationkey), 'Nation', 'parent_nation', 'structure' FROM supplier
UNION ALL SELECT md5('Order::' || o_orderkey), 'Order', md5('Customer::' || o_custkey), 'Customer', 'placed_by', 'usage' FROM orders
UNION ALL SELECT md5('Order::' || l_orderkey), 'Order', md5('Part::' || l_partkey), 'Part', 'uses_part', 'usage' FROM lineitem
UNION ALL SELECT md5('Order::' || l_orderkey), 'Order', md5('Supplier::' || l_suppkey), 'Supplier', 'uses_supplier', 'usage' FROM lineitem)"""
