"""Rules of static analysis over the driver's tables, one for each family of findings: style, documentation, errors, layout, speed, dead code, schema, coupling, change.

Findings are rows; `rule_summary` gives each rule's number of findings and worst severity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load, nations

#: Names of parts are words of lower-case letters with single spaces; lines of texts have so many characters at most; orders so many items.
NAME, LINE, ITEMS = "^[a-z]+( [a-z]+)*$", 2000, 6


def rule_naming(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name breaks the convention, by brand."""
    return load(spark, d, "part").where(~F.col("p_name").rlike(NAME)).groupBy("p_brand").agg(F.count("*").alias("n_findings"), F.min("p_partkey").alias("first_part"))


def rule_long_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents with overlong lines: how many, and the longest."""
    sizes = load(spark, d, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.length).alias("sizes"))
    return sizes.select("doc_id", F.size(F.filter("sizes", lambda x: x > LINE)).cast("long").alias("n_long"), F.array_max("sizes").cast("long").alias("longest")).where("n_long > 0")


def rule_trailing_space(spark: SparkSession, d: str) -> DataFrame:
    """Texts that begin or end with white space, by source."""
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"^[ \t\n\r]|[ \t\n\r]\z")).alias("n_findings"))


def rule_undocumented(spark: SparkSession, d: str) -> DataFrame:
    """Documents without label, by language and source."""
    labels = load(spark, d, "labels").select("doc_id").distinct()
    return load(spark, d, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left_anti").groupBy("lang", "source").agg(F.count("*").alias("n_findings"))


def rule_unhandled_error(spark: SparkSession, d: str) -> DataFrame:
    """Error events that the same user's next event isn't a view of, by that event's type (none at the end)."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, d, "events").select("user_id", "event_type", following.alias("following"))
    return rows.where("event_type = 'error' and following is distinct from 'view'").groupBy(F.coalesce("following", F.lit("none")).alias("following")).agg(F.count("*").alias("n_findings"), F.count_distinct("user_id").alias("n_users"))


def rule_repeated_step(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three events or more of one type by one user: runs and the longest, by type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("long").alias("starts"))
    runs = marked.withColumn("run", F.sum("starts").over(w)).groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n")).where("n >= 3")
    return runs.groupBy("event_type").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


def rule_inconsistent_dates(spark: SparkSession, d: str) -> DataFrame:
    """Items shipped before their order, by priority."""
    items = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.groupBy("o_orderpriority").agg(F.count("*").alias("n_items"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_findings"))


def rule_large_objects(spark: SparkSession, d: str) -> DataFrame:
    """Orders with too many items: how many have how many."""
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items")).where(F.col("n_items") > ITEMS).groupBy("n_items").agg(F.count("*").alias("n_findings"))


def rule_unused_in_segment(spark: SparkSession, d: str) -> DataFrame:
    """Nations and segments without customer or without any order."""
    segments = load(spark, d, "customer").select("c_mktsegment").distinct()
    spine = load(spark, d, "nation").select("n_nationkey", F.lit(1).alias("k")).join(segments.withColumn("k", F.lit(1)), "k").drop("k")
    ordering = load(spark, d, "customer").join(load(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    return spine.join(ordering, ["n_nationkey", "c_mktsegment"], "left_anti")


def rule_schema_spread(spark: SparkSession, d: str) -> DataFrame:
    """Part types by number of brands, sizes and parts; a type that is spread over all brands is a finding."""
    parts = load(spark, d, "part")
    per = parts.groupBy("p_type").agg(F.count("*").alias("n_parts"), F.count_distinct("p_brand").alias("n_brands"), F.count_distinct("p_size").alias("n_sizes"))
    return per.join(F.broadcast(parts.agg(F.count_distinct("p_brand").alias("n_all"))), F.lit(True)).select("p_type", "n_parts", "n_brands", "n_sizes", (F.col("n_brands") == F.col("n_all")).alias("is_finding"))


def rule_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Coupling of regions by orders: uses of other regions' suppliers, uses by others, and own ones; instability in whole percent."""
    home = F.broadcast(nations(spark, d).select("n_nationkey", "r_name"))
    c = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(home, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("r_name").alias("user"))
    s = load(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("used"))
    pairs = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("user", "used").agg(F.count("*").alias("n"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("user").alias("region"), F.when(F.expr("user <> used"), F.col("n")).otherwise(0).alias("outgoing"), F.lit(0).cast("long").alias("incoming"), F.when(F.expr("user = used"), F.col("n")).otherwise(0).alias("own")), F.struct(F.col("used").alias("region"), F.lit(0).cast("long").alias("outgoing"), F.when(F.expr("user <> used"), F.col("n")).otherwise(0).alias("incoming"), F.lit(0).cast("long").alias("own")))).alias("e")).select("e.*")
    per = ends.groupBy("region").agg(*[F.sum(x).alias(x) for x in ("outgoing", "incoming", "own")])
    return per.select("*", F.expr("CASE WHEN outgoing + incoming > 0 THEN 100 * outgoing div (outgoing + incoming) END").alias("instability"))


def rule_churn(spark: SparkSession, d: str) -> DataFrame:
    """Orders by month with the change from the month before and the share of the year in thousandths."""
    per = load(spark, d, "orders").where("o_orderdate is not null").groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.count("*").alias("n"))
    change = F.col("n") - F.lag("n").over(Window.partitionBy("year").orderBy("month"))
    return per.select("year", "month", "n", change.alias("change"), F.expr("1000 * n div sum(n) OVER (PARTITION BY year)").alias("per_mille"))


_COUNTED = {"rule_naming": ("sum(n_findings)", "warning"), "rule_long_lines": ("sum(n_long)", "info"), "rule_undocumented": ("sum(n_findings)", "info"), "rule_unhandled_error": ("sum(n_findings)", "error"), "rule_inconsistent_dates": ("sum(n_findings)", "error"), "rule_large_objects": ("sum(n_findings)", "warning")}


def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each rule, and its severity where it has any."""
    found = [globals()[rule](spark, d).agg(F.lit(rule).alias("rule"), F.expr(f"coalesce({number}, 0)").cast("long").alias("n_findings")).withColumn("severity", F.when(F.col("n_findings") > 0, severity).otherwise("ok")) for rule, (number, severity) in _COUNTED.items()]
    return reduce(DataFrame.unionByName, found)


QUERIES = {f.__name__: f for f in (rule_naming, rule_long_lines, rule_trailing_space, rule_undocumented, rule_unhandled_error, rule_repeated_step, rule_inconsistent_dates, rule_large_objects, rule_unused_in_segment, rule_schema_spread, rule_coupling, rule_churn, rule_summary)}
ORACLE_SQL = {
    "rule_naming": f"SELECT p_brand, count(*) AS n_findings, min(p_partkey) AS first_part FROM part WHERE NOT regexp_matches(p_name, '{NAME}') GROUP BY 1",
    "rule_long_lines": f"WITH s AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS sizes FROM documents) SELECT doc_id, len(list_filter(sizes, lambda x: x > {LINE})) AS n_long, list_max(sizes) AS longest FROM s WHERE len(list_filter(sizes, lambda x: x > {LINE})) > 0",
    "rule_trailing_space": r"SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '^[ \t\n\r]|[ \t\n\r]\z')) AS n_findings FROM documents GROUP BY 1",
    "rule_undocumented": "SELECT lang, source, count(*) AS n_findings FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY ALL",
    "rule_unhandled_error": "SELECT coalesce(f, 'none') AS following, count(*) AS n_findings, count(DISTINCT user_id) AS n_users FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE event_type = 'error' AND f IS DISTINCT FROM 'view' GROUP BY 1",
    "rule_repeated_step": "WITH m AS (SELECT *, CAST(lag(event_type) OVER w IS DISTINCT FROM event_type AS INT) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, event_type, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m), n AS (SELECT event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type HAVING count(*) >= 3) SELECT event_type, count(*) AS n_runs, max(n) AS longest FROM n GROUP BY 1",
    "rule_inconsistent_dates": "SELECT o_orderpriority, count(*) AS n_items, count(*) FILTER (l_shipdate < o_orderdate) AS n_findings FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "rule_large_objects": f"SELECT n_items, count(*) AS n_findings FROM (SELECT count(*) AS n_items FROM lineitem GROUP BY l_orderkey) WHERE n_items > {ITEMS} GROUP BY 1",
    "rule_unused_in_segment": "SELECT n_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer c JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment)",
    "rule_schema_spread": "SELECT p_type, count(*) AS n_parts, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_size) AS n_sizes, count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part) AS is_finding FROM part GROUP BY 1",
    "rule_coupling": "WITH h AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT a.r_name AS u, b.r_name AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN h a ON a.n_nationkey = c_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN h b ON b.n_nationkey = s_nationkey GROUP BY ALL), e AS (SELECT u AS region, CASE WHEN u <> v THEN n ELSE 0 END AS outgoing, 0 AS incoming, CASE WHEN u = v THEN n ELSE 0 END AS own FROM p UNION ALL SELECT v, 0, CASE WHEN u <> v THEN n ELSE 0 END, 0 FROM p), s AS (SELECT region, CAST(sum(outgoing) AS BIGINT) AS outgoing, CAST(sum(incoming) AS BIGINT) AS incoming, CAST(sum(own) AS BIGINT) AS own FROM e GROUP BY 1) SELECT *, CASE WHEN outgoing + incoming > 0 THEN 100 * outgoing // (outgoing + incoming) END AS instability FROM s",
    "rule_churn": "WITH p AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL) SELECT *, n - lag(n) OVER (PARTITION BY year ORDER BY month) AS change, CAST(1000 * n // sum(n) OVER (PARTITION BY year) AS BIGINT) AS per_mille FROM p",
}
ORACLE_SQL["rule_summary"] = " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(coalesce({number}, 0) AS BIGINT) AS n_findings, CASE WHEN coalesce({number}, 0) > 0 THEN '{severity}' ELSE 'ok' END AS severity FROM ({ORACLE_SQL[rule]})" for rule, (number, severity) in _COUNTED.items())
