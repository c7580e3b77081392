"""Query-service operators: paging, safe sort, whole-row search, ranked search, rules with unknown values, roll-ups, interval cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load


def search(df: DataFrame, text: str | None) -> DataFrame:
    """Rows that contain the text in any column, without regard to case."""
    if not text:
        return df
    return df.where(F.contains(F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in df.columns])), F.lit(text.strip().lower())))


def page(df: DataFrame, sort: str, number: int = 1, size: int = 500, descending: bool = False) -> DataFrame:
    """One page in a stable order, nulls last, the number held within the pages there are; adds _row_total and _page."""
    if sort not in df.columns or sort.startswith("_"):
        raise ValueError(f"no column to sort by: {sort}")
    total = df.count()
    number = max(1, min(number, -(-total // size)))
    key = F.lower(F.col(sort)) if dict(df.dtypes)[sort] == "string" else F.col(sort)
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in df.columns]]
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumns({"_row_total": F.lit(total).cast("long"), "_page": F.lit(number).cast("long")})


def paged_search_sorted(spark: SparkSession, d: str) -> DataFrame:
    found = search(load(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "1")
    return page(found, "p_name", number=2, size=50)


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers and parts whose key or name holds the text, each once at its best rank."""
    text = "12"
    every = load(spark, d, "customer").select(F.lit("Customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).union(load(spark, d, "supplier").select(F.lit("Supplier"), "s_suppkey", "s_name")).union(load(spark, d, "part").select(F.lit("Part"), "p_partkey", "p_name"))
    rank = F.when(F.col("key").cast("string") == text, 1).when(F.col("key").cast("string").startswith(text), 2).when(F.contains(F.lower("name"), F.lit(text)), 3)
    return every.withColumn("rank", rank).where("rank is not null")


def compat_tristate(spark: SparkSession, d: str) -> DataFrame:
    """Events held against a table of what is supported: yes, no, partly (null) or unlisted."""
    rules = spark.createDataFrame([("click", True), ("view", False), ("error", None)], "kind string, ok boolean")
    joined = load(spark, d, "events").join(F.broadcast(rules.withColumn("listed", F.lit(True))), F.col("event_type") == F.col("kind"), "left")
    state = F.when(F.col("listed").isNull(), "info").when(F.col("ok").isNull(), "warning").when(F.col("ok"), "ok").otherwise("error")
    return joined.groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"))


def result_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts and worst state for every prefix of the parts' type path."""
    words = F.split("p_type", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), "/"))
    level = F.when(F.col("p_size") >= 45, 2).when(F.col("p_size") >= 30, 1).otherwise(0)
    rows = load(spark, d, "part").select(F.explode(prefixes).alias("path"), level.alias("level"), "p_size")
    worst = F.max("level")
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"), F.count_if(F.col("level") == 2).alias("n_error"), F.when(worst == 2, "error").when(worst == 1, "warning").otherwise("ok").alias("worst"))


def box_cover(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose interval of price and size lies in that of another part of the brand and size; a range join behind an equal key."""
    box = load(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_partkey") % 50).alias("hi"))
    a, b = box.alias("a"), box.alias("b")
    return a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.lo") >= F.col("b.lo")) & (F.col("a.hi") <= F.col("b.hi")) & (F.col("a.p_partkey") != F.col("b.p_partkey"))).groupBy("a.p_partkey").agg(F.count("*").alias("n_covers"), F.min("b.p_partkey").alias("first_cover"))


def list_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facet counts of parts by brand and size class."""
    size = F.when(F.col("p_size") < 15, "small").when(F.col("p_size") < 35, "medium").otherwise("large")
    return load(spark, d, "part").groupBy("p_brand", size.alias("size_class")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("n_types"), F.round(F.median("p_retailprice"), 4).alias("median_price"))


def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Orders by a list of states and an optional customer; a filter that isn't given leaves no trace in the plan."""
    given = {"states": ["F", "P"], "customer": None}
    out = load(spark, d, "orders")
    out = out.where(F.col("o_orderstatus").isin(given["states"])) if given["states"] else out
    out = out.where(F.col("o_custkey") == given["customer"]) if given["customer"] is not None else out
    return out.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (paged_search_sorted, search_ranked, compat_tristate, result_rollup, box_cover, list_facets, optional_filters)}
ORACLE_SQL = {
    "paged_search_sorted": "WITH f AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE contains(lower(concat_ws(chr(31), p_partkey, p_name, p_brand, p_type, p_size)), '1')) SELECT *, (SELECT count(*) FROM f) AS _row_total, CAST(least(2, greatest(1, ceil((SELECT count(*) FROM f) / 50.0))) AS BIGINT) AS _page FROM f ORDER BY lower(p_name), p_partkey LIMIT 50 OFFSET (SELECT CAST(least(1, greatest(0, ceil(count(*) / 50.0) - 1)) * 50 AS BIGINT) FROM f)",
    "search_ranked": "WITH a AS (SELECT 'Customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'Part', p_partkey, p_name FROM part), r AS (SELECT *, 1 AS rank FROM a WHERE key = 12 UNION ALL SELECT *, 2 FROM a WHERE CAST(key AS VARCHAR) LIKE '12%' UNION ALL SELECT *, 3 FROM a WHERE name LIKE '%12%') SELECT kind, key, name, min(rank) AS rank FROM r GROUP BY ALL",
    "compat_tristate": "WITH r(kind, ok) AS (VALUES ('click', true), ('view', false), ('error', NULL)) SELECT event_type, CASE WHEN kind IS NULL THEN 'info' WHEN ok IS NULL THEN 'warning' WHEN ok THEN 'ok' ELSE 'error' END AS state, count(*) AS n FROM events LEFT JOIN r ON kind = event_type GROUP BY ALL",
    "result_rollup": "WITH w AS (SELECT string_split(p_type, ' ') AS w, p_size, CASE WHEN p_size >= 45 THEN 2 WHEN p_size >= 30 THEN 1 ELSE 0 END AS level FROM part), p AS (SELECT array_to_string(list_slice(w, 1, k), '/') AS path, p_size, level FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)) SELECT path, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, count(*) FILTER (level = 2) AS n_error, CASE max(level) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS worst FROM p GROUP BY 1",
    "box_cover": "WITH b AS (SELECT p_partkey, p_brand, p_size, p_retailprice AS lo, p_retailprice + p_partkey % 50 AS hi FROM part) SELECT x.p_partkey, count(*) AS n_covers, min(y.p_partkey) AS first_cover FROM b x JOIN b y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.lo >= y.lo AND x.hi <= y.hi AND x.p_partkey <> y.p_partkey GROUP BY 1",
    "list_facets": "SELECT p_brand, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n, count(DISTINCT p_type) AS n_types, round(median(p_retailprice), 4) AS median_price FROM part GROUP BY ALL",
    "optional_filters": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL",
}
