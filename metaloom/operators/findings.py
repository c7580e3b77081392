"""Findings of static analysis over the catalog's relations: control flow of scripts, objects without use, broken references, variables.

A script's steps are read in their order by one task: a script is one program text, however many scripts there are. Everything else is
joins and sums over the whole tables. Disabled steps take no part in the flow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load
from . import edges

DEEP = 2
#: Rules of one step by itself, the next one and the depths of branches and loops there (its own included).
FLOW_RULES = {
    "dead_code_after_exit": "step = 'Exit Script' AND following NOT IN ('End If', 'Else', 'Else If', 'End Loop')",
    "empty_if_branch": "step IN ('If', 'Else If') AND following IN ('Else', 'Else If', 'End If')",
    "empty_else_branch": "step = 'Else' AND following = 'End If'",
    "else_outside_if": "step IN ('Else', 'Else If') AND if_depth <= 0",
    "deep_if_nesting": f"step = 'If' AND if_depth > {DEEP}",
    "exit_script_in_loop": "step = 'Exit Script' AND loop_depth > 0",
    "show_dialog_in_loop": "step = 'Show Custom Dialog' AND loop_depth > 0",
    "exit_loop_outside_loop": "step = 'Exit Loop If' AND loop_depth <= 0",
    "transaction_left_open": "step = 'Open Transaction' AND following IS NULL",
}
#: Steps of scripts as the star schema gives them; the same SQL runs in both engines.
FLOW = """SELECT 'SCR' || o_custkey AS script, o_orderkey AS place, CASE (o_orderkey * 7 + o_custkey) % 14 WHEN 0 THEN 'If' WHEN 1 THEN 'Set Variable' WHEN 2 THEN 'End If' WHEN 3 THEN 'Loop' WHEN 4 THEN 'Exit Loop If'
WHEN 5 THEN 'End Loop' WHEN 6 THEN 'Exit Script' WHEN 7 THEN 'Show Custom Dialog' WHEN 8 THEN 'Else' WHEN 9 THEN 'If' WHEN 10 THEN 'End If' WHEN 11 THEN 'Loop' WHEN 12 THEN 'Open Transaction' ELSE 'Else If' END AS step,
o_orderstatus <> 'P' AS is_enabled FROM orders"""


def marked(steps: DataFrame) -> DataFrame:
    """Enabled steps (script, place, step) with the next one and the depths of branches and loops, the step itself included; an end closes before it counts."""
    order = Window.partitionBy("script").orderBy("place")
    depth = lambda begins, ends: F.sum(F.when(F.col("step") == begins, 1).when(F.col("step") == ends, -1).otherwise(0)).over(order)
    return steps.where("is_enabled").select("script", "place", "step", F.lead("step").over(order).alias("following"), depth("If", "End If").alias("if_depth"), depth("Loop", "End Loop").alias("loop_depth"))


def flow(steps: DataFrame) -> DataFrame:
    """Findings (rule, script, n, first_place) of all rules, from one pass over the marked steps."""
    hits = F.filter(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in FLOW_RULES.items()]), lambda x: x.isNotNull())
    return marked(steps).select("script", "place", F.explode(hits).alias("rule")).groupBy("rule", "script").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def endless_loops(steps: DataFrame) -> DataFrame:
    """Loops (script, loop_at) that no step of their own level leaves: an exit belongs to the last loop begun at its depth."""
    inner = Window.partitionBy("script", "loop_depth").orderBy("place")
    of = marked(steps).where("loop_depth > 0").withColumn("loop_at", F.max(F.when(F.col("step") == "Loop", F.col("place"))).over(inner)).where("loop_at is not null")
    return of.groupBy("script", "loop_at").agg(F.count_if(F.col("step").isin("Exit Loop If", "Exit Script")).alias("exits")).where("exits = 0").select("script", "loop_at")


def unbalanced(steps: DataFrame) -> DataFrame:
    """Scripts whose branches or loops don't close as they open: what is open at the end, and the lowest depth."""
    rows = marked(steps).groupBy("script").agg(F.max_by(F.struct("if_depth", "loop_depth"), "place").alias("last"), F.min("if_depth").alias("lowest_if"), F.min("loop_depth").alias("lowest_loop"))
    out = rows.select("script", F.col("last.if_depth").alias("open_ifs"), F.col("last.loop_depth").alias("open_loops"), "lowest_if", "lowest_loop")
    return out.where("open_ifs <> 0 or open_loops <> 0 or lowest_if < 0 or lowest_loop < 0")


def unused(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects (type, uuid) that no usage link of another object ends at; mirrors and aggregated links don't count."""
    counts = (F.col("link_kind") == "usage") & ~F.col("link_role").isin(*edges.MIRRORS) & ~F.col("link_subrole").eqNullSafe(F.lit("aggregated"))
    other = (F.col("source_type") != F.col("target_type")) | (F.col("source_uuid") != F.col("target_uuid"))
    used = links.where(counts & other).select(F.col("target_type").alias("type"), F.col("target_uuid").alias("uuid")).distinct()
    return objects.select("type", "uuid").distinct().join(used, ["type", "uuid"], "left_anti")


def variables(uses: DataFrame) -> DataFrame:
    """Variables (scope, variable, rule) that are only set or only read, within their scope: the file for names with $$, else the owner."""
    scope = F.when(F.startswith("variable", F.lit("$$")), F.col("file_name")).otherwise(F.concat_ws("::", "owner_type", "owner"))
    per = uses.groupBy(scope.alias("scope"), "variable").agg(F.max((F.col("usage") == "set").cast("int")).alias("is_set"), F.max((F.col("usage") != "set").cast("int")).alias("is_read"))
    return per.where("is_set <> is_read").select("scope", "variable", F.when(F.col("is_set") == 1, "variable_set_never_read").otherwise("variable_read_never_set").alias("rule"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(FLOW.replace("FROM orders", "FROM {orders}"), orders=load(spark, d, "orders"))


def flow_findings(spark: SparkSession, d: str) -> DataFrame:
    return flow(_steps(spark, d))


def flow_endless_loops(spark: SparkSession, d: str) -> DataFrame:
    return endless_loops(_steps(spark, d))


def flow_unbalanced(spark: SparkSession, d: str) -> DataFrame:
    return unbalanced(_steps(spark, d))


#: Objects by type: relation and condition.
OBJECTS = {"Field": ("fields", "true"), "Layout": ("layouts", "true"), "ValueList": ("value_lists", "true"), "TableOccurrence": ("occurrences", "true"), "Script": ("folders", "item_type = 'Script'")}


def unused_objects(spark: SparkSession, d: str) -> DataFrame:
    """Fields, layouts, value lists, table occurrences and scripts without use."""
    given = edges.relations(spark, d, edges.RELATIONS)
    objects = reduce(DataFrame.union, [given[r].where(c).select(F.lit(t).alias("type"), F.col("uuid").cast("string").alias("uuid")) for t, (r, c) in OBJECTS.items()])
    return unused(objects, edges.object_links(given))


def variable_findings(spark: SparkSession, d: str) -> DataFrame:
    return variables(edges.relations(spark, d, ("variable_uses",))["variable_uses"])


def object_findings(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that call themselves, layouts without objects, scripts without steps, lookups of unknown fields, relationships without a field on one side, disabled steps."""
    given = edges.relations(spark, d, ("steps", "layouts", "layout_objects", "fields", "relationships", "folders"))
    steps, fields = given["steps"], given["fields"]
    row = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("object"))
    scripts = given["folders"].where("item_type = 'Script'")
    return reduce(DataFrame.union, [
        row(steps.where("is_enabled and called_script = script"), "self_recursive_script", "script"),
        row(given["layouts"].join(given["layout_objects"].select(F.col("layout").alias("uuid")), "uuid", "left_anti"), "empty_layout", "uuid"),
        row(scripts.join(steps.select(F.col("script").alias("uuid")), "uuid", "left_anti"), "empty_script", "uuid"),
        row(fields.where("lookup_field is not null").join(fields.select(F.col("uuid").alias("lookup_field")), "lookup_field", "left_anti"), "field_broken_lookup", "uuid"),
        row(given["relationships"].where("left_field is null or right_field is null"), "cross_product_relationship", "uuid"),
        row(steps.where("not is_enabled"), "disabled_script_steps", "script"),
    ]).groupBy("rule", "object").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (flow_findings, flow_endless_loops, flow_unbalanced, unused_objects, variable_findings, object_findings)}
_MARKED = f"""WITH f AS ({FLOW}), m AS (SELECT script, place, step, lead(step) OVER w AS following, sum(CASE step WHEN 'If' THEN 1 WHEN 'End If' THEN -1 ELSE 0 END) OVER w AS if_depth,
sum(CASE step WHEN 'Loop' THEN 1 WHEN 'End Loop' THEN -1 ELSE 0 END) OVER w AS loop_depth FROM f WHERE is_enabled WINDOW w AS (PARTITION BY script ORDER BY place))"""
_COUNTS = "link_kind = 'usage' AND link_role <> 'trigger_script' AND link_subrole IS DISTINCT FROM 'aggregated' AND (source_type <> target_type OR source_uuid <> target_uuid)"
_GIVEN = "WITH " + ", ".join(f"{r} AS ({edges.RELATIONS[r]})" for r in ("steps", "layouts", "layout_objects", "fields", "relationships", "folders"))
ORACLE_SQL = {
    "flow_findings": f"{_MARKED}, h AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, script, place FROM m WHERE {c}" for r, c in FLOW_RULES.items()) + ") SELECT rule, script, count(*) AS n, min(place) AS first_place FROM h GROUP BY ALL",
    "flow_endless_loops": f"""{_MARKED}, l AS (SELECT script, loop_depth, place, (SELECT min(e.place) FROM m e WHERE e.script = b.script AND e.place > b.place AND (e.loop_depth < b.loop_depth OR (e.loop_depth = b.loop_depth AND e.step = 'Loop'))) AS ends FROM m b WHERE step = 'Loop' AND loop_depth > 0),
n AS (SELECT script, loop_depth, place, lead(place) OVER (PARTITION BY script, loop_depth ORDER BY place) AS next_place FROM l)
SELECT script, place AS loop_at FROM n WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.script = n.script AND x.loop_depth = n.loop_depth AND x.place > n.place AND (n.next_place IS NULL OR x.place < n.next_place) AND x.step IN ('Exit Loop If', 'Exit Script'))""",
    "flow_unbalanced": f"{_MARKED}, u AS (SELECT script, arg_max(if_depth, place) AS open_ifs, arg_max(loop_depth, place) AS open_loops, min(if_depth) AS lowest_if, min(loop_depth) AS lowest_loop FROM m GROUP BY 1) SELECT script, CAST(open_ifs AS BIGINT) AS open_ifs, CAST(open_loops AS BIGINT) AS open_loops, CAST(lowest_if AS BIGINT) AS lowest_if, CAST(lowest_loop AS BIGINT) AS lowest_loop FROM u WHERE open_ifs <> 0 OR open_loops <> 0 OR lowest_if < 0 OR lowest_loop < 0",
    "unused_objects": edges._links_sql(edges.RELATIONS) + ", o AS (" + " UNION ".join(f"SELECT '{t}' AS type, CAST(uuid AS VARCHAR) AS uuid FROM {r} WHERE {c}" for t, (r, c) in OBJECTS.items()) + f") SELECT type, uuid FROM o WHERE NOT EXISTS (SELECT 1 FROM links WHERE target_type = type AND target_uuid = uuid AND {_COUNTS})",
    "variable_findings": f"WITH v AS ({edges.RELATIONS['variable_uses']}), s AS (SELECT CASE WHEN variable LIKE '$$%' THEN file_name ELSE owner_type || '::' || owner END AS scope, variable, bool_or(usage = 'set') AS w, bool_or(usage <> 'set') AS r FROM v GROUP BY ALL) SELECT scope, variable, CASE WHEN w THEN 'variable_set_never_read' ELSE 'variable_read_never_set' END AS rule FROM s WHERE w <> r",
    "object_findings": f"""{_GIVEN}, h AS (SELECT 'self_recursive_script' AS rule, script AS object FROM steps WHERE is_enabled AND called_script = script
UNION ALL SELECT 'empty_layout', uuid FROM layouts WHERE uuid NOT IN (SELECT layout FROM layout_objects WHERE layout IS NOT NULL)
UNION ALL SELECT 'empty_script', uuid FROM folders WHERE item_type = 'Script' AND uuid NOT IN (SELECT script FROM steps WHERE script IS NOT NULL)
UNION ALL SELECT 'field_broken_lookup', uuid FROM fields WHERE lookup_field IS NOT NULL AND lookup_field NOT IN (SELECT uuid FROM fields)
UNION ALL SELECT 'cross_product_relationship', uuid FROM relationships WHERE left_field IS NULL OR right_field IS NULL
UNION ALL SELECT 'disabled_script_steps', script FROM steps WHERE NOT is_enabled) SELECT rule, object, count(*) AS n FROM h GROUP BY ALL""",
}
