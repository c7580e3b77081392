"""Queries that hold the functions against SQL over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load
from . import dialect as f


def fn_strings(spark: SparkSession, d: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return load(spark, d, "part").select(
        "p_partkey",
        F.element_at(f.split_literal(brand, "#"), -1).alias("after_sign"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second_word"),
        f.full_match(brand, "Brand#[0-9]+").alias("is_brand"),
        f.replace_first(name, "[aeiou]", "_").alias("first_vowel_replaced"),
        F.regexp_replace(name, "[aeiou]", "_").alias("vowels_replaced"),
        f.substring_from(brand, 0, 4).alias("from_zero"),
        f.url_encode(F.concat_ws(" &*~", "p_name", "p_type")).alias("encoded"),
        f.xml_unescape(F.concat(F.lit("&lt;"), name, F.lit("&amp;lt;"))).alias("unescaped"),
        F.instr(name, "e").cast("long").alias("place_of_e"),
        F.upper(F.left(name, F.lit(3))).alias("head"),
        F.format_string("%05d|%s", "p_size", F.lpad(brand, 12, ".")).alias("printed"),
        f.derived_uuid(name, F.nullif(brand, F.lit("Brand#12")), F.col("p_size")).alias("derived"),
    )


def fn_dates(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_orderdate"), F.lit("1995-06-15 12:30:00").cast("timestamp_ntz")
    units = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
    return load(spark, d, "orders").select("o_orderkey", *[f.boundaries(u, a, b).alias(f"{u}s") for u in units], f.iso_weekday(a).cast("long").alias("weekday"), f.format_date(a, "%Y-%m-%d at %H:%M").alias("printed"), f.epoch(a).alias("since_epoch"))


def fn_event_times(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between a user's events with their fractions, and boundaries crossed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = load(spark, d, "events").select("event_id", "user_id", "ts", F.lag("ts").over(w).alias("before")).where("before is not null")
    return before.select("event_id", (f.epoch_micros(F.col("ts")) - f.epoch_micros(F.col("before"))).alias("gap_micros"), *[f.boundaries(u, F.col("before"), F.col("ts")).alias(f"{u}s") for u in ("minute", "hour", "day", "week")])


def fn_lists(spark: SparkSession, d: str) -> DataFrame:
    flag = F.nullif("l_returnflag", F.lit("N"))
    per = load(spark, d, "lineitem").groupBy("l_orderkey").agg(f.list_ordered(flag, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("flags"), f.list_ordered(F.col("l_partkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("parts"), f.first_ordered(F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey")).alias("first_supplier"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",", "?")
    parts = F.col("parts")
    return per.select("l_orderkey", text(F.col("flags")).alias("flags"), f.list_count(F.col("flags")).cast("long").alias("n_flags"), text(f.list_slice(parts, 2, 3)).alias("middle"), text(f.list_slice(parts, -2, -1)).alias("tail"), text(F.array_sort(F.array_distinct(F.transform(parts, lambda x: x % 10)))).alias("ends"), F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), "first_supplier")


def fn_casts(spark: SparkSession, d: str) -> DataFrame:
    cents = F.format_string("%.2f", "l_extendedprice")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f.round_to_long(F.col("l_quantity") / 4).alias("quarter"), F.col("l_returnflag").try_cast("int").alias("nothing"), F.expr("l_partkey div 7").alias("seventh"), F.greatest("l_partkey", "l_suppkey").alias("larger"), F.ceil(F.col("l_quantity") / 8).alias("up"), f.parse_long(F.replace(cents, F.lit(".50"), F.lit(".51"))).alias("whole_price"))


def fn_modes(spark: SparkSession, d: str) -> DataFrame:
    return f.mode_smallest(load(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("long")), ["year", "o_orderstatus"], "o_orderpriority")


def fn_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles and ordered picks of few-valued columns."""
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.median("l_quantity").alias("median_quantity"),
        F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90"),
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity)").alias("p25"),
        F.bool_or(F.col("l_discount") > 0.09).alias("any_high"),
        F.bool_and(F.col("l_tax") < 0.09).alias("all_low"),
        F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("latest_order"),
        F.array_join(F.array_sort(F.collect_set(F.year("l_shipdate").cast("string"))), "/").alias("years"),
    )


def fn_text_more(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, d, "part").select(
        "p_partkey", F.char(F.lit(65) + F.col("p_size") % 26).alias("letter"), F.ascii(name).alias("first_code"), F.rtrim(F.concat(name, F.lit("  "))).alias("trimmed"), F.repeat(F.left("p_brand", F.lit(2)), F.col("p_size") % 4).alias("repeated"),
        F.abs(F.col("p_size") - 25).alias("off_middle"), F.regexp_like("p_brand", f.escape_pattern(F.col("p_brand"))).alias("escaped"), f.html_unescape(F.concat(F.lit("&eacute;&amp;"), name)).alias("plain"),
        F.hex(F.col("p_brand")).alias("hexed"), F.contains(name, F.lit("e")).alias("has_e"), F.startswith(name, F.lit("P")).alias("starts"), f.restore_lines(F.concat(name, F.lit("x"))).alias("restored"),
    )


def fn_lists_more(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.col("l_linenumber").cast("long")))
    per = load(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("n"), F.min("l_suppkey").alias("s"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return per.select(
        "l_orderkey", text(F.array_append("n", F.lit(99).cast("long"))).alias("appended"), text(F.reverse("n")).alias("reversed"), F.array_contains("n", F.lit(3).cast("long")).alias("has_three"),
        F.arrays_overlap("n", F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("has_any"), text(F.flatten(F.array("n", F.array("s")))).alias("flat"),
        F.map_from_entries(F.array(F.struct(F.lit("a").alias("k"), F.size("n").cast("long").alias("v")), F.struct(F.lit("b").alias("k"), F.col("s").alias("v"))))["b"].alias("of_b"), F.to_json(F.struct(F.col("s").alias("s"), F.size("n").alias("k"))).alias("json"),
        F.struct(F.col("s").alias("a")).withField("b", F.size("n").cast("long"))["b"].alias("inserted"), F.size("n").cast("long").alias("len"),
    )


def fn_windows(spark: SparkSession, d: str) -> DataFrame:
    """Dense ranks, and the share of parts with fewer orders, from sums over the few distinct counts."""
    by = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    counts = by.groupBy("n").agg(F.count("*").alias("c"))
    order = Window.orderBy("n")  # over one row for each distinct count
    below = counts.select("n", (F.sum("c").over(order) - F.col("c")).alias("below"), F.dense_rank().over(order).cast("long").alias("level"))
    return by.join(F.broadcast(below), "n").select("l_partkey", "n", "below", "level")


def fn_predicates(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN over a list with nulls finds nothing; without them it does; literal percent signs are escaped; shared subqueries are computed once."""
    orders, customers = load(spark, d, "orders"), load(spark, d, "customer")
    return spark.sql(
        """WITH per AS (SELECT o_custkey, count(*) AS n, any_value(o_orderstatus IN ('F', 'O', 'P')) AS known, max(CAST(day(o_orderdate) AS BIGINT)) AS last_day FROM {orders} GROUP BY 1),
        listed AS (SELECT CASE WHEN n > 15 THEN o_custkey END AS k FROM per)
        SELECT c_custkey, coalesce(n, 0) AS n, known, last_day, c_custkey NOT IN (SELECT k FROM listed WHERE k IS NOT NULL) AS absent, coalesce(c_custkey NOT IN (SELECT k FROM listed), false) AS absent_with_nulls,
               c_name LIKE 'Customer!_%' ESCAPE '!' AS literal_underscore, lower(c_mktsegment) ILIKE 'AUTO%' AS auto
        FROM {customers} LEFT JOIN per ON o_custkey = c_custkey""",
        orders=orders, customers=customers,
    )


def fn_clock(spark: SparkSession, d: str) -> DataFrame:
    """Clock, environment and session variables: they exist, and one statement has one time."""
    import os

    spark.conf.set("metaloom.variable", "x")
    named = spark.range(1).select(F.lit(os.environ.get("PATH") is not None).alias("has_environment"), F.lit(spark.conf.get("metaloom.variable")).alias("variable"))
    return named.select("*", (F.now() == F.current_timestamp()).alias("one_time"), (F.localtimestamp() <= F.localtimestamp()).alias("local_time"), (F.day(F.current_date()) > 0).alias("has_day"))


QUERIES = {q.__name__: q for q in (fn_strings, fn_dates, fn_event_times, fn_lists, fn_casts, fn_modes, fn_aggregates, fn_text_more, fn_lists_more, fn_windows, fn_predicates, fn_clock)}
_UNITS = ", ".join(f"date_diff('{u}', o_orderdate, TIMESTAMP '1995-06-15 12:30:00') AS {u}s" for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"))
_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey"
ORACLE_SQL = {
    "fn_strings": "SELECT p_partkey, string_split(p_brand, '#')[-1] AS after_sign, split_part(p_name, ' ', 2) AS second_word, regexp_full_match(p_brand, 'Brand#[0-9]+') AS is_brand, regexp_replace(p_name, '[aeiou]', '_') AS first_vowel_replaced, regexp_replace(p_name, '[aeiou]', '_', 'g') AS vowels_replaced, substr(p_brand, 0, 4) AS from_zero, url_encode(concat_ws(' &*~', p_name, p_type)) AS encoded, '<' || p_name || '&lt;' AS unescaped, CAST(strpos(p_name, 'e') AS BIGINT) AS place_of_e, upper(left(p_name, 3)) AS head, printf('%05d|%s', p_size, lpad(p_brand, 12, '.')) AS printed, md5(p_name || '::' || CASE WHEN p_brand = 'Brand#12' THEN '' ELSE p_brand END || '::' || p_size) AS derived FROM part",
    "fn_dates": f"SELECT o_orderkey, {_UNITS}, isodow(o_orderdate) AS weekday, strftime(o_orderdate, '%Y-%m-%d at %H:%M') AS printed, epoch(o_orderdate) AS since_epoch FROM orders",
    "fn_event_times": "SELECT event_id, epoch_us(ts) - epoch_us(before) AS gap_micros, date_diff('minute', before, ts) AS minutes, date_diff('hour', before, ts) AS hours, date_diff('day', before, ts) AS days, date_diff('week', before, ts) AS weeks FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL",
    "fn_lists": f"WITH p AS (SELECT l_orderkey, list(nullif(l_returnflag, 'N') {_ORDER}) AS flags, list(l_partkey {_ORDER}) AS parts, first(l_suppkey ORDER BY l_shipdate, l_linenumber, l_suppkey) AS first_supplier FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(flags, lambda x: coalesce(x, '?')), ',') AS flags, len(list_filter(flags, lambda x: x IS NOT NULL)) AS n_flags, array_to_string(list_slice(parts, 2, 3), ',') AS middle, array_to_string(list_slice(parts, greatest(-2, -len(parts)), -1), ',') AS tail, array_to_string(list_sort(list_distinct(list_transform(parts, lambda x: x % 10))), ',') AS ends, CAST(list_sum(parts) AS BIGINT) AS total, first_supplier FROM p",
    "fn_casts": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity / 4 AS BIGINT) AS quarter, TRY_CAST(l_returnflag AS INT) AS nothing, l_partkey // 7 AS seventh, greatest(l_partkey, l_suppkey) AS larger, CAST(ceil(l_quantity / 8) AS BIGINT) AS up, CAST(CAST(replace(printf('%.2f', l_extendedprice), '.50', '.51') AS DECIMAL(38, 9)) AS BIGINT) AS whole_price FROM lineitem",
    "fn_modes": "SELECT year, o_orderstatus, o_orderpriority, n_mode FROM (SELECT year(o_orderdate) AS year, o_orderstatus, o_orderpriority, count(*) AS n_mode FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY year, o_orderstatus ORDER BY n_mode DESC, o_orderpriority) = 1",
    "fn_aggregates": "SELECT l_returnflag, l_linestatus, median(l_quantity) AS median_quantity, quantile_cont(l_quantity, 0.9) AS p90, quantile_disc(l_quantity, 0.25) AS p25, bool_or(l_discount > 0.09) AS any_high, bool_and(l_tax < 0.09) AS all_low, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS latest_order, string_agg(DISTINCT CAST(year(l_shipdate) AS VARCHAR), '/' ORDER BY CAST(year(l_shipdate) AS VARCHAR)) AS years FROM lineitem GROUP BY ALL",
    "fn_text_more": r"SELECT p_partkey, chr(65 + p_size % 26) AS letter, unicode(p_name) AS first_code, rtrim(p_name || '  ') AS trimmed, repeat(left(p_brand, 2), p_size % 4) AS repeated, abs(p_size - 25) AS off_middle, regexp_full_match(p_brand, regexp_escape(p_brand)) AS escaped, 'é&' || p_name AS plain, hex(p_brand) AS hexed, contains(p_name, 'e') AS has_e, starts_with(p_name, 'P') AS starts, p_name || 'x' AS restored FROM part",
    "fn_lists_more": "WITH p AS (SELECT l_orderkey, list_sort(list(CAST(l_linenumber AS BIGINT))) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_append(n, 99), ',') AS appended, array_to_string(list_reverse(n), ',') AS reversed, list_contains(n, 3) AS has_three, list_has_any(n, [5, 6]) AS has_any, array_to_string(flatten([n, [s]]), ',') AS flat, map_from_entries([('a', len(n)), ('b', s)])['b'] AS of_b, CAST(to_json(struct_pack(s := s, k := len(n))) AS VARCHAR) AS json, struct_insert(struct_pack(a := s), b := len(n)).b AS inserted, len(n) AS len FROM p",
    "fn_windows": "WITH b AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT n, count(*) AS c FROM b GROUP BY 1), k AS (SELECT n, CAST(sum(c) OVER (ORDER BY n) - c AS BIGINT) AS below, dense_rank() OVER (ORDER BY n) AS level FROM c) SELECT l_partkey, b.n, below, level FROM b JOIN k ON b.n = k.n",
    "fn_predicates": "WITH per AS MATERIALIZED (SELECT o_custkey, count(*) AS n, any_value(o_orderstatus IN ('F', 'O', 'P')) AS known, max(day(o_orderdate)) AS last_day FROM orders GROUP BY 1), listed AS (SELECT CASE WHEN n > 15 THEN o_custkey END AS k FROM per) SELECT c_custkey, coalesce(n, 0) AS n, known, last_day, c_custkey NOT IN (SELECT k FROM listed WHERE k IS NOT NULL) AS absent, coalesce(c_custkey NOT IN (SELECT k FROM listed), false) AS absent_with_nulls, c_name LIKE 'Customer!_%' ESCAPE '!' AS literal_underscore, lower(c_mktsegment) ILIKE 'AUTO%' AS auto FROM customer LEFT JOIN per ON o_custkey = c_custkey",
    "fn_clock": "SELECT true AS has_environment, 'x' AS variable, now() = now() AS one_time, current_localtimestamp() <= current_localtimestamp() AS local_time, day(current_date) > 0 AS has_day",
}
