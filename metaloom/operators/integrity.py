"""Validation over the catalog's relations, links and calculations: references without target, rows against rules, counts on two sides.

Every check gives rows (check_name, part, n_rows, n_bad): how many rows it looked at, by a part of them (a file, class or stage), and how many fail.
A part without rows is not a row. Nulls in a rule count as not failing, unless the rule asks for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import edges

# Kinds of layout parts; roles that a calculation can have.
PART_TYPES = "Top Navigation|Title Header|Header|Leading Grand Summary|Leading Sub-summary|Body|Trailing Sub-summary|Trailing Grand Summary|Footer|Title Footer|Bottom Navigation".split("|")
CALC_ROLES = """field_calculation auto_enter validation container_path validation_message display_names step_xslt step_parameter record_access menu_item_parameter
display_calculation custom_function script_trigger_parameter conditional_format hide tooltip placeholder button_label action portal_filter web_viewer_url panel_title
popover_title active_segment chart_series""".split()


def rule(df: DataFrame, name: str, part: str, bad: str) -> DataFrame:
    """Rows of df that fail, by part; part and bad are SQL."""
    rows = df.select(F.expr(part).cast("string").alias("part"), F.coalesce(F.expr(bad), F.lit(False)).alias("bad"))
    return rows.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("n_bad")).select(F.lit(name).alias("check_name"), "part", "n_rows", "n_bad")


def unresolved(df: DataFrame, name: str, part: str, reference: str, known: DataFrame) -> DataFrame:
    """References (null ones don't count) that known (key) has not, by part; references are counted before they are joined."""
    refs = df.select(F.expr(part).cast("string").alias("part"), F.expr(reference).cast("string").alias("key")).where("key is not null").groupBy("part", "key").agg(F.count("*").alias("n"))
    there = known.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct().withColumn("there", F.lit(True))
    out = refs.join(there, "key", "left").groupBy("part").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_bad"))
    return out.select(F.lit(name).alias("check_name"), "part", F.col("n_rows").cast("long"), F.col("n_bad").cast("long"))


def balance(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Keys (part, key) of which two sides have different numbers of rows, by part; keys of one side only differ too."""
    count = lambda df, n: df.select(F.col("part").cast("string").alias("part"), F.col("key").cast("string").alias("key")).groupBy("part", "key").agg(F.count("*").alias(n))
    both = count(left, "a").join(count(right, "b"), ["part", "key"], "full")
    bad = F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))
    return both.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("check_name"), "part", "n_rows", "n_bad")


_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
# Relations that only checks read, from the star schema; the same SQL runs in both engines.
RELATIONS = {
    "schema_info": "SELECT 'v' || r_regionkey AS version, r_name AS hash, CASE WHEN r_regionkey = 4 THEN NULL ELSE r_name END AS applied FROM region",
    "menu_actions": "SELECT 'MI' || s_suppkey AS uuid, CASE s_suppkey % 4 WHEN 0 THEN 'submenu' WHEN 1 THEN 'script' WHEN 2 THEN 'command' ELSE 'none' END AS action, CASE WHEN s_suppkey % 4 = 1 THEN 'SCR' || (s_suppkey % 90) END AS script, s_nationkey FROM supplier",
    "plugin_calls": "SELECT l_returnflag AS file_name, CASE WHEN l_linenumber = 4 THEN 'MBS' ELSE 'Other' END AS plugin, CASE WHEN l_suppkey % 6 <> 0 THEN 'Sub' || (l_suppkey % 9) END AS sub_name FROM lineitem",
    "tokens": "SELECT o_orderstatus AS file_name, CASE o_orderkey % 6 WHEN 0 THEN 'FieldRef' WHEN 1 THEN 'FunctionRef' WHEN 2 THEN 'NoRef' WHEN 3 THEN 'CustomFunctionRef' WHEN 4 THEN NULL ELSE 'VariableReference' END AS chunk_type, CASE WHEN o_orderkey % 24 = 3 THEN 'DatabaseNames' WHEN o_orderkey % 48 = 2 THEN '%X:' WHEN o_orderkey % 54 = 1 THEN '<Function Missing>' ELSE 'c' || (o_custkey % 50) END AS content, CASE WHEN o_orderkey % 30 = 0 THEN '' ELSE 'X' || (o_custkey % 80) END AS ref_uuid, CASE WHEN o_custkey % 40 = 0 THEN NULL ELSE 'CALC' || (o_custkey % 300) END AS calc_uuid, o_orderkey % 11 AS chunk_count FROM orders",
    "files": "SELECT 'File' || n_nationkey AS file_name, CASE WHEN n_nationkey % 4 = 0 THEN '2.2' ELSE '2.3' END AS profile, n_nationkey % 3 <> 0 AS has_details, n_nationkey % 5 <> 0 AS has_options FROM nation",
    "texts": "SELECT CASE p_size % 3 WHEN 0 THEN 'Text' WHEN 1 THEN 'Button' ELSE 'Field' END AS type, CASE WHEN p_size % 3 <> 2 THEN p_name END AS text_content, CASE WHEN p_partkey % 17 = 0 THEN p_name END AS label_content, CASE WHEN p_partkey % 9 = 0 THEN 'FLD' || (p_partkey + 50) END AS anchor, CASE WHEN p_partkey % 2 = 0 THEN 'local' ELSE 'external' END AS stage, p_retailprice FROM part",
    "calculations": f"SELECT 'CALC' || c_custkey AS uuid, CASE c_custkey % 9 WHEN 0 THEN 'auto_enter' WHEN 1 THEN 'tooltip' WHEN 2 THEN 'unknown' WHEN 3 THEN 'hide' ELSE 'field_calculation' END AS role, 'OWN' || (c_custkey % 700) AS owner, 'h' || (c_custkey % 90) AS hash, c_mktsegment AS file_name FROM customer",
    "conditions": "SELECT 'OBJ' || p_partkey AS object, p_brand AS part, p_size % 4 AS rule_count FROM part",
    "layout_part_types": f"SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'Odd Part' WHEN s_suppkey % 2 = 0 THEN 'Body' ELSE 'Header' END AS part_type, 'LAY' || s_suppkey AS layout FROM supplier",
    "boxes": "SELECT 'LAY' || (p_partkey % 90) AS layout, CASE WHEN p_partkey % 21 = 0 THEN NULL ELSE 'Body' END AS part, p_partkey AS top, p_partkey + p_size - 3 AS bottom FROM part",
    "step_types": "SELECT l_linenumber AS step_type, l_returnflag AS file_name FROM lineitem",
}
_KNOWN = {
    "Field": ("part", "'FLD' || p_partkey"), "ValueList": ("nation", "'VL' || n_nationkey"), "Menu": ("nation", "'MN' || (n_nationkey % 9)"), "Script": ("customer", "'SCR' || (c_custkey % 80)"),
    "Occurrence": ("nation", "'TO' || n_nationkey"), "Calculation": ("customer", "'CALC' || c_custkey"), "Layout": ("supplier", "'LAY' || s_suppkey"), "StepRole": ("nation", "n_nationkey"),
}
#: Checks of one relation by a rule: relation, part, what fails.
RULES = {
    "check_schema": ("schema_info", "version", "applied IS NULL OR hash IS NULL"),
    "check_menu_action_unlinked": ("menu_actions", "action", "action IN ('command', 'none')"),
    "check_subname_resolution": ("plugin_calls", "file_name", "plugin = 'MBS' AND sub_name IS NULL"),
    "check_design_function_retype": ("tokens", "file_name", "chunk_type = 'CustomFunctionRef' AND content = 'DatabaseNames'"),
    "check_chunk_type_null": ("tokens", "file_name", "chunk_type IS NULL"),
    "check_chunk_refs": ("tokens", "chunk_type", "chunk_type LIKE '%Ref' AND chunk_type <> 'NoRef' AND ref_uuid = ''"),
    "check_calc_uuid": ("tokens", "file_name", "calc_uuid IS NULL"),
    "check_function_missing": ("tokens", "file_name", "content LIKE '%<Function Missing>%'"),
    "check_display_prefix_chunks": ("tokens", "file_name", "content LIKE '!%_:%' ESCAPE '!'"),
    "check_display_empty_chunklist": ("tokens", "file_name", "chunk_count = 0"),
    "check_saxml_profile": ("files", "profile", "profile <> '2.3' AND has_details"),
    "check_ddr_missing": ("files", "profile", "NOT has_details"),
    "check_layout_text_paths": ("texts", "type", "text_content IS NOT NULL AND label_content IS NOT NULL"),
    "check_calc_roles": ("calculations", "file_name", f"role NOT IN ({_LIST(CALC_ROLES)})"),
    "check_unknown_part_types": ("layout_part_types", "part_type", f"part_type NOT IN ({_LIST(PART_TYPES)})"),
    "check_layoutobjects_without_part": ("boxes", "layout", "part IS NULL"),
    "check_bounds": ("boxes", "layout", "bottom < top"),
}
#: Checks of references: relation, part, reference, what is known.
REFERENCES = {
    "check_external_lists_unresolved": ("value_lists", "file_name", "external_list", "ValueList"),
    "check_submenu_unresolved": ("menu_items", "file_name", "submenu", "Menu"),
    "check_menu_action_unresolved": ("menu_actions", "action", "script", "Script"),
    "check_table_view_columns": ("table_columns", "file_name", "field", "Field"),
    "check_label_anchor_external": ("texts", "stage", "anchor", "Field"),
    "check_relationship_left_fields": ("relationships", "file_name", "left_field", "Field"),
    "check_relationship_right_fields": ("relationships", "file_name", "right_field", "Field"),
    "check_trigger_parameter_fields": ("triggers", "action", "parameter_field", "Field"),
    "check_layout_script_refs": ("layout_objects", "type", "button_script", "Script"),
    "check_step_roles": ("step_types", "file_name", "step_type", "StepRole"),
    "check_calculations": ("calc_refs", "ref_type", "calculation", "Calculation"),
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _relation_sql(name: str) -> str:
    return RELATIONS.get(name) or edges.RELATIONS[name]


def relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = _relation_sql(name)
    table = sql.rsplit(" ", 1)[1]
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: load(spark, d, table)})


def _known(spark: SparkSession, d: str, kind: str) -> DataFrame:
    table, key = _KNOWN[kind]
    return load(spark, d, table).select(F.expr(key).alias("key"))


def _ruled(name: str):
    of, part, bad = RULES[name]
    return lambda spark, d: rule(relation(spark, d, of), name, part, bad)


def _referring(name: str):
    of, part, reference, kind = REFERENCES[name]
    return lambda spark, d: unresolved(relation(spark, d, of), name, part, reference, _known(spark, d, kind))


def check_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Rules of conditional formats against the calculations that belong to them, by brand."""
    declared = relation(spark, d, "conditions").where("rule_count > 0").select("part", F.col("object").alias("key"), F.explode(F.sequence(F.lit(1), F.col("rule_count"))))
    found = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).where("l_linenumber = 7")
    return balance(declared.select("part", "key"), found.select(F.col("p_brand").alias("part"), F.concat(F.lit("OBJ"), F.col("l_partkey").cast("string")).alias("key")), "check_conditions")


def check_relationship_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Identities that stand for several relationships of a file."""
    twins = relation(spark, d, "relationships").select("file_name", F.concat_ws("-", "left_to", "left_field").alias("uuid")).groupBy("file_name", "uuid").agg(F.count("*").alias("n"))
    return rule(twins, "check_relationship_uuid", "file_name", "n > 1")


def check_variable_identity(spark: SparkSession, d: str) -> DataFrame:
    """Local variables that stand in several files under one owner."""
    per = relation(spark, d, "variable_uses").groupBy("owner_type", "owner", "variable").agg(F.count_distinct("file_name").alias("n_files"))
    return rule(per, "check_variable_identity", "owner_type", "n_files > 1")


def checks_in_all(spark: SparkSession, d: str) -> DataFrame:
    """Every rule and reference check in sum, worst share first being left to the reader: check_name, n_rows, n_bad, state."""
    parts = [QUERIES[name](spark, d) for name in (*RULES, *REFERENCES)]
    every = reduce(DataFrame.unionByName, parts).groupBy("check_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))
    return every.select("*", F.when(F.col("n_bad") == 0, "ok").when(F.col("n_bad") * 10 < F.col("n_rows"), "warning").otherwise("error").alias("state"))


QUERIES = {n: _ruled(n) for n in RULES} | {n: _referring(n) for n in REFERENCES} | {f.__name__: f for f in (check_conditions, check_relationship_uuid, check_variable_identity, checks_in_all)}


def _rule_sql(name: str) -> str:
    of, part, bad = RULES[name]
    return f"SELECT '{name}' AS check_name, CAST({part} AS VARCHAR) AS part, count(*) AS n_rows, count(*) FILTER (WHERE {bad}) AS n_bad FROM ({_relation_sql(of)}) GROUP BY ALL"


def _reference_sql(name: str) -> str:
    of, part, reference, kind = REFERENCES[name]
    table, key = _KNOWN[kind]
    known = f"SELECT CAST({key} AS VARCHAR) FROM {table}"
    return f"SELECT '{name}' AS check_name, CAST({part} AS VARCHAR) AS part, count(*) AS n_rows, count(*) FILTER (WHERE CAST({reference} AS VARCHAR) NOT IN ({known})) AS n_bad FROM ({_relation_sql(of)}) WHERE {reference} IS NOT NULL GROUP BY ALL"


ORACLE_SQL = {n: _rule_sql(n) for n in RULES} | {n: _reference_sql(n) for n in REFERENCES}
ORACLE_SQL["checks_in_all"] = "WITH c AS (" + " UNION ALL ".join(ORACLE_SQL.values()) + ") SELECT check_name, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_bad) AS BIGINT) AS n_bad, CASE WHEN sum(n_bad) = 0 THEN 'ok' WHEN sum(n_bad) * 10 < sum(n_rows) THEN 'warning' ELSE 'error' END AS state FROM c GROUP BY 1"
ORACLE_SQL |= {
    "check_conditions": "WITH a AS (SELECT p_brand AS part, 'OBJ' || p_partkey AS key, p_size % 4 AS a FROM part WHERE p_size % 4 > 0), b AS (SELECT p_brand AS part, 'OBJ' || l_partkey AS key, count(*) AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 7 GROUP BY ALL) SELECT 'check_conditions' AS check_name, part, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(a, 0) <> coalesce(b, 0)) AS n_bad FROM a FULL JOIN b USING (part, key) GROUP BY ALL",
    "check_relationship_uuid": f"WITH t AS (SELECT file_name, left_to || '-' || left_field AS uuid, count(*) AS n FROM ({edges.RELATIONS['relationships']}) GROUP BY ALL) SELECT 'check_relationship_uuid' AS check_name, file_name AS part, count(*) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_bad FROM t GROUP BY ALL",
    "check_variable_identity": f"WITH t AS (SELECT owner_type, owner, variable, count(DISTINCT file_name) AS n FROM ({edges.RELATIONS['variable_uses']}) GROUP BY ALL) SELECT 'check_variable_identity' AS check_name, owner_type AS part, count(*) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_bad FROM t GROUP BY ALL",
}
