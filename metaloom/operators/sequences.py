"""Operators over ordered rows: block trees, neighbour rules, pairing, bursts, sessions, activity and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value")


def _order():
    return Window.partitionBy("user_id").orderBy("us", "event_id")


def _until():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _with_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of blocks that a view opens and a purchase closes; closers without an opener are ignored."""
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    out = _events(spark, d).withColumn("run", F.sum(step).over(_until()).cast("long"))
    return out.withColumn("depth", F.col("run") - F.least(F.lit(0), F.min("run").over(_until())))


def block_tree(spark: SparkSession, d: str) -> DataFrame:
    return _with_depth(spark, d).select("event_id", "user_id", "event_type", "depth")


def calls_in_loop(spark: SparkSession, d: str) -> DataFrame:
    return _with_depth(spark, d).where("event_type = 'click' and depth > 0").select("event_id", "user_id", "depth")


def folder_parent(spark: SparkSession, d: str) -> DataFrame:
    """The last signup before each row."""
    opened = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(_before())
    return _events(spark, d).select("event_id", "user_id", opened.alias("parent_id"))


def step_followed_by(spark: SparkSession, d: str) -> DataFrame:
    out = _events(spark, d).withColumn("next_type", F.lead("event_type").over(_order())).withColumn("next_id", F.lead("event_id").over(_order()))
    return out.where("event_type = 'view' and next_type = 'purchase'").select("event_id", "next_id", "user_id")


def nearest_following_pair(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the first purchase after it, before the user's next click."""
    after = _order().rowsBetween(1, Window.unboundedFollowing)
    first = lambda kind: F.first(F.when(F.col("event_type") == kind, F.struct("us", "event_id")), ignorenulls=True).over(after)
    out = _events(spark, d).withColumn("bought", first("purchase")).withColumn("again", first("click"))
    return out.where((F.col("event_type") == "click") & F.col("bought").isNotNull() & (F.col("again").isNull() | (F.col("bought") < F.col("again")))).select("event_id", "user_id", F.col("bought.event_id").alias("purchase_id"))


def lookahead_pattern(spark: SparkSession, d: str) -> DataFrame:
    out = _events(spark, d)
    for k in (1, 2, 3):
        out = out.withColumn(f"t{k}", F.lead("event_type", k).over(_order()))
    return out.where("event_type = 'view' and t1 = 'click' and t2 = 'purchase'").select("event_id", "user_id", F.col("t3").alias("then_type"))


def _sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Numbers each user's sessions: a new one begins after a gap of more than gap_us."""
    fresh = F.when(F.col("us") - F.lag("us").over(_order()) <= gap_us, 0).otherwise(1)
    return events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(_until()))


def work_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(_events(spark, d), 30 * 60 * 1_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_distinct("event_type").alias("n_types"))


def change_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a type's events with gaps of at most ten minutes, from five events on.

    Windows cover a type's day, so that few types don't make few tasks; what crosses days is carried in by a table of one row for each type and day.
    """
    days = _events(spark, d).withColumn("day", F.expr("us div 86400000000"))
    own, ordered = Window.partitionBy("event_type", "day").orderBy("us", "event_id"), Window.partitionBy("event_type").orderBy("day")
    carry = days.groupBy("event_type", "day").agg(F.max("us").alias("last")).select("event_type", "day", F.lag("last").over(ordered).alias("before"))
    before = F.coalesce(F.lag("us").over(own), F.col("before"))
    marked = days.join(carry, ["event_type", "day"]).withColumn("fresh", F.when(F.col("us") - before <= 600_000_000, 0).otherwise(1))
    offsets = marked.groupBy("event_type", "day").agg(F.sum("fresh").alias("n"))
    offsets = offsets.select("event_type", "day", F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    local = F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("local", local).join(offsets, ["event_type", "day"]).withColumn("burst", F.col("local") + F.col("earlier"))
    return runs.groupBy("event_type", "burst").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).where("n_events >= 5")


def bulk_events(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of all types chained where they begin within 15 minutes of the end of what came before; of two types at least.

    Months are chained by themselves, with the largest end of earlier months and the chain that is open there carried in; a chain has
    the month in which it begins and its number there.
    """
    bursts = change_bursts(spark, d).withColumn("month", F.date_format(F.timestamp_micros("first_us"), "yyyy-MM"))
    order = Window.partitionBy("month").orderBy("first_us", "event_type", "burst")
    earlier = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # over one row a month
    ends = bursts.groupBy("month").agg(F.max("last_us").alias("end")).select("month", F.max("end").over(earlier).alias("carry"))
    reach = F.greatest(F.max("last_us").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))
    fresh = bursts.join(F.broadcast(ends), "month").withColumn("fresh", F.when(F.col("first_us") - reach <= 900_000_000, 0).otherwise(1))
    begun = F.last(F.when(F.col("n") > 0, F.struct("month", F.col("n").alias("chain"))), ignorenulls=True).over(earlier)
    starts = fresh.groupBy("month").agg(F.sum("fresh").alias("n")).select("month", begun.alias("begun"))
    local = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chained = fresh.join(F.broadcast(starts), "month").withColumn("local", local).withColumn("of", F.when(F.col("local") > 0, F.struct("month", F.col("local").alias("chain"))).otherwise(F.col("begun")))
    by = chained.groupBy(F.col("of.month").alias("month"), F.col("of.chain").alias("chain")).agg(F.count_distinct("event_type").alias("n_types"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("largest"), F.min("first_us").alias("first_us"))
    return by.where("n_types >= 2").select("month", "chain", "n_types", "n_events", "first_us", F.when(F.col("largest") >= 0.8 * F.col("n_events"), "paste").otherwise("mass").alias("kind"))


def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Type pairs by the sessions in which both occur; types are counted once a session, so pairs of rows are never formed."""
    types = _sessions(_events(spark, d), 30 * 60 * 1_000_000).select("user_id", "session", "event_type").distinct()
    a, b = (types.select("user_id", "session", F.col("event_type").alias(n)) for n in ("type_a", "type_b"))
    return a.join(b, ["user_id", "session"]).where("type_a < type_b").groupBy("type_a", "type_b").agg(F.count("*").alias("n_sessions"))


def activity_series(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type on every day between the first and the last, zero where there are none."""
    by = _events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    spine = by.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    kinds = F.broadcast(by.select("event_type").distinct())
    return spine.crossJoin(kinds).join(by, ["day", "event_type"], "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def activity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Events by weekday and hour, with a level from 1 to 4 by their share of the busiest cell."""
    by = _events(spark, d).groupBy(F.dayofweek("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    top = F.broadcast(by.agg(F.max("n").alias("top")))
    return by.crossJoin(top).select("weekday", "hour", "n", F.ceil(4 * F.col("n") / F.col("top")).cast("int").alias("level"))


def hotspot_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the percent ranks of their orders and their suppliers within the brand."""
    by = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_orders"), F.count_distinct("l_suppkey").alias("n_suppliers")).join(load(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rank = lambda c: F.percent_rank().over(Window.partitionBy("p_brand").orderBy(c))
    ranked = by.withColumn("a", rank("n_orders")).withColumn("b", rank("n_suppliers"))
    hot = lambda c: F.col(c) >= 0.9
    return ranked.select("l_partkey", "p_brand", "n_orders", "n_suppliers", F.when(hot("a") & hot("b"), "hotspot").when(hot("a"), "busy").when(hot("b"), "spread").otherwise("calm").alias("quadrant"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation turn with its reply and the turns left."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    left: Column = F.count("*").over(w.rowsBetween(1, Window.unboundedFollowing))
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("reply_role"), left.alias("n_left"))


QUERIES = {f.__name__: f for f in (block_tree, calls_in_loop, folder_parent, step_followed_by, nearest_following_pair, lookahead_pattern, work_sessions, change_bursts, bulk_events, cochange_pairs, activity_series, activity_heatmap, hotspot_quadrants)}
QUERIES["conversation_turns"] = turns
_E = "e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type FROM events)"
_O = "(PARTITION BY user_id ORDER BY us, event_id"
_DEPTH = f"""WITH {_E}, r AS (SELECT *, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER {_O} ROWS UNBOUNDED PRECEDING) AS run FROM e),
d AS (SELECT *, CAST(run - least(0, min(run) OVER {_O} ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM r)"""
_SESSIONS = f"WITH {_E}, f AS (SELECT *, CASE WHEN us - lag(us) OVER {_O}) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, CAST(sum(fresh) OVER {_O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)"
_BURSTS = f"""WITH {_E}, f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM f),
b AS (SELECT event_type, burst, count(*) AS n_events, count(DISTINCT user_id) AS n_users, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY ALL HAVING count(*) >= 5)"""
ORACLE_SQL = {
    "block_tree": _DEPTH + " SELECT event_id, user_id, event_type, depth FROM d",
    "calls_in_loop": _DEPTH + " SELECT event_id, user_id, depth FROM d WHERE event_type = 'click' AND depth > 0",
    "folder_parent": f"WITH {_E} SELECT event_id, user_id, (SELECT p.event_id FROM e p WHERE p.user_id = e.user_id AND p.event_type = 'signup' AND (p.us, p.event_id) < (e.us, e.event_id) ORDER BY p.us DESC, p.event_id DESC LIMIT 1) AS parent_id FROM e",
    "step_followed_by": f"WITH {_E} SELECT event_id, next_id, user_id FROM (SELECT *, lead(event_type) OVER {_O}) AS next_type, lead(event_id) OVER {_O}) AS next_id FROM e) WHERE event_type = 'view' AND next_type = 'purchase'",
    "nearest_following_pair": f"WITH {_E}, c AS (SELECT *, lead((us, event_id)) OVER {_O}) AS again FROM e WHERE event_type = 'click') SELECT c.event_id, c.user_id, arg_min(p.event_id, (p.us, p.event_id)) AS purchase_id FROM c JOIN e p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND (p.us, p.event_id) > (c.us, c.event_id) AND (c.again IS NULL OR (p.us, p.event_id) < c.again) GROUP BY ALL",
    "lookahead_pattern": f"WITH {_E} SELECT event_id, user_id, then_type FROM (SELECT *, lead(event_type) OVER {_O}) AS t1, lead(event_type, 2) OVER {_O}) AS t2, lead(event_type, 3) OVER {_O}) AS then_type FROM e) WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase'",
    "work_sessions": _SESSIONS + " SELECT user_id, session, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us, count(DISTINCT event_type) AS n_types FROM s GROUP BY ALL",
    "change_bursts": _BURSTS + " SELECT * FROM b",
    "bulk_events": _BURSTS + """, w AS (SELECT *, strftime(make_timestamp(first_us), '%Y-%m') AS month FROM b), g AS (SELECT *, CASE WHEN first_us - max(last_us) OVER (PARTITION BY month ORDER BY first_us, event_type, burst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 900000000 THEN 0 ELSE 1 END AS fresh FROM w),
c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY month ORDER BY first_us, event_type, burst ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM g)
SELECT month, chain, count(DISTINCT event_type) AS n_types, CAST(sum(n_events) AS BIGINT) AS n_events, min(first_us) AS first_us, CASE WHEN max(n_events) >= 0.8 * sum(n_events) THEN 'paste' ELSE 'mass' END AS kind FROM c GROUP BY month, chain HAVING count(DISTINCT event_type) >= 2""",
    "cochange_pairs": _SESSIONS + " SELECT a.event_type AS type_a, b.event_type AS type_b, count(DISTINCT (a.user_id, a.session)) AS n_sessions FROM s a JOIN s b ON a.user_id = b.user_id AND a.session = b.session AND a.event_type < b.event_type GROUP BY ALL",
    "activity_series": "WITH b AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM b), (SELECT max(day) FROM b), INTERVAL 1 DAY)) AS DATE) AS day), k AS (SELECT DISTINCT event_type FROM b) SELECT strftime(p.day, '%Y-%m-%d') AS day, k.event_type, coalesce(n, 0) AS n FROM p CROSS JOIN k LEFT JOIN b ON b.day = p.day AND b.event_type = k.event_type",
    "activity_heatmap": "WITH b AS (SELECT CAST(dayofweek(ts) + 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT weekday, hour, n, CAST(ceil(4.0 * n / (SELECT max(n) FROM b)) AS INT) AS level FROM b",
    "hotspot_quadrants": """WITH b AS (SELECT l_partkey, p_brand, count(*) AS n_orders, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, percent_rank() OVER (PARTITION BY p_brand ORDER BY n_orders) AS a, percent_rank() OVER (PARTITION BY p_brand ORDER BY n_suppliers) AS b FROM b)
SELECT l_partkey, p_brand, n_orders, n_suppliers, CASE WHEN a >= 0.9 AND b >= 0.9 THEN 'hotspot' WHEN a >= 0.9 THEN 'busy' WHEN b >= 0.9 THEN 'spread' ELSE 'calm' END AS quadrant FROM r""",
    "conversation_turns": "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_role, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_left FROM conversations",
}
