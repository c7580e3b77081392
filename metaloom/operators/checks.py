"""Validation operators: one-row or few-row aggregates over the catalog model and the tables behind it.

Each reports how much was looked at and how much of it is bad; nothing is dropped or repaired. Whether a number is a warning or an
error is decided by `check_summary` alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import LINKS_SQL, OBJECTS_SQL, links, load, objects
from .catalog import _SUPPLY_SQL, _supply

#: Declared data sources: the file pairs between which links may cross.
DECLARED = [("AFRICA", "EUROPE"), ("AMERICA", "ASIA"), ("AMERICA", "EUROPE"), ("ASIA", "MIDDLE EAST"), ("EUROPE", "AFRICA"), ("MIDDLE EAST", "ASIA")]
#: Event types in the canon.
CANON = ["click", "purchase", "signup", "view"]
#: Source table of each object type.
_TABLES = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders"}


def _long(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long").alias(name)


def check_catalog_dups(spark: SparkSession, d: str) -> DataFrame:
    """Objects of each type, those whose identity repeats, and those whose name repeats within a file."""
    by_id = objects(spark, d).groupBy("object_type", "object_uuid").agg(F.count("*").alias("n"))
    by_name = objects(spark, d).groupBy("object_type", "file_name", "object_name").agg(F.count("*").alias("n"))
    ids = by_id.groupBy("object_type").agg(F.sum("n").alias("n_objects"), _long(F.sum(F.when(F.col("n") > 1, F.col("n"))), "n_dup_ids"))
    names = by_name.groupBy("object_type").agg(_long(F.sum(F.when(F.col("n") > 1, F.col("n"))), "n_dup_names"))
    return ids.join(names, "object_type")


def check_orphan_sources(spark: SparkSession, d: str) -> DataFrame:
    """Links whose source is not in the catalog, by its type; links are summed up for each source before the join."""
    per = links(spark, d).groupBy("source_type", "source_uuid").agg(F.count("*").alias("n"))
    known = objects(spark, d).select(F.col("object_uuid").alias("source_uuid"), F.lit(True).alias("known")).distinct()
    return per.join(known, "source_uuid", "left").groupBy("source_type").agg(F.sum("n").alias("n_links"), _long(F.sum(F.when(F.col("known").isNull(), F.col("n"))), "n_orphans"))


def check_phantom_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between different files that no declared data source backs."""
    declared = F.broadcast(spark.createDataFrame(DECLARED, "source_file string, target_file string"))
    crossing = _supply(spark, d).where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.count("*").alias("n_links"))
    return crossing.join(declared, ["source_file", "target_file"], "left_anti")


def check_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source table against the objects derived from them."""
    expected = reduce(DataFrame.unionByName, [load(spark, d, t).agg(F.lit(k).alias("object_type"), F.count("*").alias("n_expected")) for k, t in _TABLES.items()])
    actual = objects(spark, d).groupBy("object_type").agg(F.count("*").alias("n"))
    return expected.join(actual, "object_type", "left").select("object_type", "n_expected", _long(F.col("n"), "n_actual"), (F.col("n_expected") == F.coalesce("n", F.lit(0))).alias("is_complete"))


def check_absorbed_dups(spark: SparkSession, d: str) -> DataFrame:
    """What would be lost if texts were the identity of documents, by language; and that the counts add up."""
    per = load(spark, d, "documents").groupBy("lang", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_kept"), _long(F.sum(F.col("n") - 1), "n_absorbed"), _long(F.count_if(F.col("n") > 1), "n_groups"), F.max("n").alias("largest_group"))


def check_census_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Census against catalog: rows are what is kept and what is absorbed."""
    census = check_absorbed_dups(spark, d)
    return census.select("lang", (F.col("n_rows") == F.col("n_kept") + F.col("n_absorbed")).alias("adds_up"), ((F.col("n_absorbed") == 0) == (F.col("n_groups") == 0)).alias("groups_agree"))


def check_change_meta(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of orders by year: without stamp, sharing a stamp with another order, and later than the first shipment."""
    shipped = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_shipment"))
    stamps = load(spark, d, "orders").select("o_orderkey", "o_orderdate").join(shipped, "o_orderkey", "left")
    per = stamps.groupBy("o_orderdate").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") > F.col("first_shipment")).alias("late"))
    return per.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("n").alias("n_orders"), F.count("o_orderdate").alias("n_stamps"), _long(F.sum(F.when(F.col("n") > 1, F.col("n"))), "n_shared"), _long(F.sum("late"), "n_after_shipment"))


def check_resolution(spark: SparkSession, d: str) -> DataFrame:
    """References by name and number: users of events among customers, labels among documents; resolved and not."""
    users = load(spark, d, "events").groupBy("event_type", F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    users = users.join(load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(True).alias("known")), "key", "left").select(F.concat(F.lit("event."), "event_type").alias("ref_type"), "n", "known")
    labels = load(spark, d, "labels").select(F.col("doc_id").alias("key")).join(load(spark, d, "documents").select(F.col("doc_id").alias("key"), F.lit(True).alias("known")), "key", "left").select(F.lit("label").alias("ref_type"), F.lit(1).cast("long").alias("n"), "known")
    return users.unionByName(labels).groupBy("ref_type").agg(F.sum("n").alias("n_refs"), _long(F.sum(F.when(F.col("known"), F.col("n"))), "n_resolved"), _long(F.sum(F.when(F.col("known").isNull(), F.col("n"))), "n_unresolved"))


def check_numeric_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of their domain, column by column."""
    rules = {"part": {"p_size": "p_size <= 0", "p_retailprice": "p_retailprice <= 0"}, "orders": {"o_totalprice": "o_totalprice <= 0"}, "lineitem": {"l_quantity": "l_quantity <= 0", "l_discount": "l_discount < 0 OR l_discount > 1"}, "customer": {"c_acctbal": "c_acctbal < 0"}, "supplier": {"s_acctbal": "s_acctbal < 0"}}

    def of(name: str, columns: dict[str, str]) -> DataFrame:
        counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.expr(rule)).alias("n_out"), F.count_if(F.col(c).isNull()).alias("n_null")) for c, rule in columns.items()]
        return load(spark, d, name).agg(F.array(*counts).alias("c")).select(F.lit(name).alias("table_name"), F.inline("c"))

    return reduce(DataFrame.unionByName, [of(t, c) for t, c in rules.items()])


def check_unknown_object_types(spark: SparkSession, d: str) -> DataFrame:
    """Types outside the canon with their numbers and first appearance."""
    return load(spark, d, "events").where(~F.col("event_type").isin(CANON)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.min("event_id").alias("first_event"))


def check_reference_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of orders whose highest place differs from their length, by how much."""
    per = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("most"))
    return per.groupBy((F.col("most") - F.col("n")).alias("difference")).agg(F.count("*").alias("n_lists"))


def check_declared_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Declared length of documents against the real one, by language."""
    size = F.length(F.coalesce("text", F.lit("")))
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") != size).alias("n_mismatched"), F.sum(size).cast("long").alias("total_chars"))


def check_mirror_symmetry(spark: SparkSession, d: str) -> DataFrame:
    """Each user's turn is mirrored by the next turn of the assistant; conversations where that fails."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("next_role", F.lead("role").over(w))
    bad = (F.col("role") == "user") & ~F.col("next_role").eqNullSafe("assistant")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(bad).alias("n_unmirrored")).where("n_unmirrored > 0")


def check_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by whether their turns are numbered without gap and repetition."""
    per = load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("turn").alias("n_distinct"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    return per.groupBy((F.col("n") == F.col("n_distinct")).alias("is_unique"), (F.col("n_distinct") == F.col("span")).alias("is_gapless")).agg(F.count("*").alias("n_conversations"))


def check_owner_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests that stand for texts of different lengths or languages."""
    per = load(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.count_distinct(F.length("text")).alias("n_lengths"), F.count_distinct("lang").alias("n_langs"))
    return per.agg(F.count("*").alias("n_digests"), F.count_if(F.col("n_lengths") > 1).alias("n_mixed_lengths"), F.count_if(F.col("n_langs") > 1).alias("n_mixed_langs"))


def check_file_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Files and what they hold of each type; files that lack a type are told by zero."""
    held = objects(spark, d).where("object_type in ('Customer', 'Supplier', 'Order')").groupBy("file_name").agg(*[F.count_if(F.col("object_type") == k).alias(f"n_{k.lower()}s") for k in ("Customer", "Supplier", "Order")])
    files = load(spark, d, "region").select(F.col("r_name").alias("file_name"))
    return files.join(held, "file_name", "left").select("file_name", *[_long(F.col(c), c) for c in ("n_customers", "n_suppliers", "n_orders")])


def check_summary(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of several checks as states: error where nothing may be bad, warning where something may."""

    def of(name: str, bad: DataFrame, otherwise: str) -> DataFrame:
        return bad.select(F.lit(name).alias("check_name"), _long(F.col("n"), "n_bad"), F.when(F.coalesce("n", F.lit(0)) == 0, "ok").otherwise(otherwise).alias("state"))

    return reduce(DataFrame.unionByName, [
        of("orphan_sources", check_orphan_sources(spark, d).agg(F.sum("n_orphans").alias("n")), "error"),
        of("catalog_dups", check_catalog_dups(spark, d).agg(F.sum("n_dup_ids").alias("n")), "error"),
        of("phantom_links", check_phantom_links(spark, d).agg(F.sum("n_links").alias("n")), "warning"),
        of("absorbed_dups", check_absorbed_dups(spark, d).agg(F.sum("n_absorbed").alias("n")), "warning"),
        of("declared_sizes", check_declared_sizes(spark, d).agg(F.sum("n_mismatched").alias("n")), "error"),
        of("unknown_types", check_unknown_object_types(spark, d).agg(F.sum("n").alias("n")), "info"),
    ])


QUERIES = {f.__name__: f for f in (check_catalog_dups, check_orphan_sources, check_phantom_links, check_synthetic, check_absorbed_dups, check_census_integrity, check_change_meta, check_resolution, check_numeric_sentinels, check_unknown_object_types, check_reference_lists, check_declared_sizes, check_mirror_symmetry, check_ordinals, check_owner_hash, check_file_coverage, check_summary)}
_W = f"WITH {OBJECTS_SQL}, {LINKS_SQL}, {_SUPPLY_SQL}"
_DECLARED_SQL = "declared(sf, tf) AS (VALUES " + ", ".join(str(pair) for pair in DECLARED) + ")"
_DUPS = """SELECT object_type, CAST(sum(n) AS BIGINT) AS n_objects, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_dup_ids FROM (SELECT object_type, object_uuid, count(*) AS n FROM objects GROUP BY ALL) GROUP BY 1"""
_ORPHANS = "SELECT source_type, count(*) AS n_links, count(*) FILTER (NOT EXISTS (SELECT 1 FROM objects o WHERE o.object_uuid = source_uuid)) AS n_orphans FROM links GROUP BY 1"
_PHANTOMS = "SELECT source_file, target_file, count(*) AS n_links FROM supply WHERE source_file <> target_file AND NOT EXISTS (SELECT 1 FROM declared WHERE sf = source_file AND tf = target_file) GROUP BY ALL"
_ABSORBED = "SELECT lang, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_kept, CAST(sum(n - 1) AS BIGINT) AS n_absorbed, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest_group FROM (SELECT lang, md5(text) AS digest, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1"
_SIZES = "SELECT lang, count(*) AS n, count(*) FILTER (n_chars <> length(coalesce(text, ''))) AS n_mismatched, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total_chars FROM documents GROUP BY 1"
_UNKNOWN = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, min(event_id) AS first_event FROM events WHERE event_type NOT IN (" + ", ".join(f"'{c}'" for c in CANON) + ") GROUP BY 1"


def _sentinel(table: str, column: str, rule: str) -> str:
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) FILTER ({rule}) AS n_out, count(*) FILTER ({column} IS NULL) AS n_null FROM {table}"


def _state(name: str, number: str, otherwise: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(coalesce(n, 0) AS BIGINT) AS n_bad, CASE WHEN coalesce(n, 0) = 0 THEN 'ok' ELSE '{otherwise}' END AS state FROM (SELECT {number})"


ORACLE_SQL = {
    "check_catalog_dups": f"{_W}, i AS ({_DUPS}), m AS (SELECT object_type, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_dup_names FROM (SELECT object_type, file_name, object_name, count(*) AS n FROM objects GROUP BY ALL) GROUP BY 1) SELECT i.*, n_dup_names FROM i JOIN m ON i.object_type = m.object_type",
    "check_orphan_sources": f"{_W} {_ORPHANS}",
    "check_phantom_links": f"{_W}, {_DECLARED_SQL} {_PHANTOMS}",
    "check_synthetic": f"{_W}, e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS object_type, count(*) AS n_expected FROM {t}" for k, t in _TABLES.items()) + "), a AS (SELECT object_type, count(*) AS n FROM objects GROUP BY 1) SELECT e.object_type, n_expected, coalesce(n, 0) AS n_actual, n_expected = coalesce(n, 0) AS is_complete FROM e LEFT JOIN a ON e.object_type = a.object_type",
    "check_absorbed_dups": _ABSORBED,
    "check_census_integrity": f"SELECT lang, n_rows = n_kept + n_absorbed AS adds_up, (n_absorbed = 0) = (n_groups = 0) AS groups_agree FROM ({_ABSORBED})",
    "check_change_meta": "WITH s AS (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem GROUP BY 1), p AS (SELECT o_orderdate, count(*) AS n, count(*) FILTER (o_orderdate > f) AS late FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1) SELECT year(o_orderdate) AS year, CAST(sum(n) AS BIGINT) AS n_orders, count(o_orderdate) AS n_stamps, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_shared, CAST(sum(late) AS BIGINT) AS n_after_shipment FROM p GROUP BY 1",
    "check_resolution": "WITH r AS (SELECT 'event.' || event_type AS ref_type, EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) AS known FROM events UNION ALL SELECT 'label', EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) FROM labels l) SELECT ref_type, count(*) AS n_refs, count(*) FILTER (known) AS n_resolved, count(*) FILTER (NOT known) AS n_unresolved FROM r GROUP BY 1",
    "check_numeric_sentinels": " UNION ALL ".join([_sentinel("part", "p_size", "p_size <= 0"), _sentinel("part", "p_retailprice", "p_retailprice <= 0"), _sentinel("orders", "o_totalprice", "o_totalprice <= 0"), _sentinel("lineitem", "l_quantity", "l_quantity <= 0"), _sentinel("lineitem", "l_discount", "l_discount < 0 OR l_discount > 1"), _sentinel("customer", "c_acctbal", "c_acctbal < 0"), _sentinel("supplier", "s_acctbal", "s_acctbal < 0")]),
    "check_unknown_object_types": _UNKNOWN,
    "check_reference_lists": "SELECT most - n AS difference, count(*) AS n_lists FROM (SELECT l_orderkey, count(*) AS n, CAST(max(l_linenumber) AS BIGINT) AS most FROM lineitem GROUP BY 1) GROUP BY 1",
    "check_declared_sizes": _SIZES,
    "check_mirror_symmetry": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user' AND next_role IS DISTINCT FROM 'assistant') AS n_unmirrored FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next_role FROM conversations) GROUP BY 1 HAVING n_unmirrored > 0",
    "check_ordinals": "SELECT n = n_distinct AS is_unique, n_distinct = span AS is_gapless, count(*) AS n_conversations FROM (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS n_distinct, max(turn) - min(turn) + 1 AS span FROM conversations GROUP BY 1) GROUP BY ALL",
    "check_owner_hash": "SELECT count(*) AS n_digests, count(*) FILTER (n_lengths > 1) AS n_mixed_lengths, count(*) FILTER (n_langs > 1) AS n_mixed_langs FROM (SELECT md5(text), count(DISTINCT length(text)) AS n_lengths, count(DISTINCT lang) AS n_langs FROM documents WHERE text IS NOT NULL GROUP BY 1)",
    "check_file_coverage": f"{_W} SELECT r_name AS file_name, count(*) FILTER (object_type = 'Customer') AS n_customers, count(*) FILTER (object_type = 'Supplier') AS n_suppliers, count(*) FILTER (object_type = 'Order') AS n_orders FROM region LEFT JOIN objects ON file_name = r_name GROUP BY 1",
    "check_summary": f"{_W}, {_DECLARED_SQL} " + " UNION ALL ".join([
        _state("orphan_sources", f"sum(n_orphans) AS n FROM ({_ORPHANS})", "error"),
        _state("catalog_dups", f"sum(n_dup_ids) AS n FROM ({_DUPS})", "error"),
        _state("phantom_links", f"sum(n_links) AS n FROM ({_PHANTOMS})", "warning"),
        _state("absorbed_dups", f"sum(n_absorbed) AS n FROM ({_ABSORBED})", "warning"),
        _state("declared_sizes", f"sum(n_mismatched) AS n FROM ({_SIZES})", "error"),
        _state("unknown_types", f"sum(n) AS n FROM ({_UNKNOWN})", "info"),
    ]),
}
