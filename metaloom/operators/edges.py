"""Typed links out of the catalog's relations: a table of edge blocks, each a reference from a column of a relation, and the registry of link roles.

A block reads one relation; all blocks of a relation are taken in one pass over it, as the rows of an exploded array, so that a
relation is scanned once however many kinds of reference it holds. References without source or target are no links; equal links are
one; rows of disabled definitions (`is_enabled` false) give none. Where several relations are asked for, their links are united.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

# The roles that links can have, by kind. Usage roles count as where-used but for those of a mirror.
USAGE = """base_table breaks_on_field parent_table calls_customfunction calls_function calls_pluginfunction calls_script context_table
data_source default_layout auto_login_account displays_field displays_variable displays_symbol exports_from_field finds_in_field
grants_privilege imports_to_field inputs_to_field installs_menuset left_field left_table right_field right_table lookup_context
lookup_relationship lookup_source navigates_to_field navigates_to_layout navigates_to_to opens_menu portal_context privilege_set
reads_field reads_variable related_values_from references_field sets_field sets_variable sort_field sorts_by_field
sorts_by_valuelist source_field source_table source_valuelist summarizes_field trigger_script triggers_script uses_menuset
uses_theme uses_valuelist validates_by_calc""".split()
CONTAINMENT = "parent_layout parent_script parent_object parent_folder parent_menu contains_menu groups_into trigger_owner has_calculation".split()
RESTRICTION = "restricts_field restricts_object".split()
MIRRORS = ("trigger_script",)
KINDS = {r: k for k, roles in (("usage", USAGE), ("containment", CONTAINMENT), ("restriction", RESTRICTION)) for r in roles}


@dataclass(frozen=True)
class Block:
    """One kind of reference: SQL expressions over the relation's columns."""

    name: str
    relation: str
    source_type: str
    source: str
    target_type: str
    target: str
    role: str
    subrole: str = "CAST(NULL AS STRING)"
    where: str = "true"


def _b(name: str, relation: str, source: str, target: str, role: str, subrole: str = "", where: str = "true") -> Block:
    """source and target: 'Type column'; a type or role in brackets is a column."""
    quoted = lambda x: x[1:-1] if x.startswith("[") else f"'{x}'"
    (st, sc), (tt, tc) = source.split(), target.split()
    return Block(name, relation, quoted(st), sc, quoted(tt), tc, quoted(role), quoted(subrole) if subrole else "CAST(NULL AS STRING)", where)


BLOCKS = [
    _b("relationship_left_table", "relationships", "Relationship uuid", "TableOccurrence left_to", "left_table"),
    _b("relationship_right_table", "relationships", "Relationship uuid", "TableOccurrence right_to", "right_table"),
    _b("relationship_left_field", "relationships", "Relationship uuid", "Field left_field", "left_field"),
    _b("relationship_right_field", "relationships", "Relationship uuid", "Field right_field", "right_field"),
    _b("relationship_sort_left", "relationships", "Relationship uuid", "Field left_sort_field", "sort_field", "left"),
    _b("relationship_sort_right", "relationships", "Relationship uuid", "Field right_sort_field", "sort_field", "right"),
    _b("relationship_sort_list_left", "relationships", "Relationship uuid", "ValueList left_sort_list", "sorts_by_valuelist", "left"),
    _b("relationship_sort_list_right", "relationships", "Relationship uuid", "ValueList right_sort_list", "sorts_by_valuelist", "right"),
    _b("field_table", "fields", "Field uuid", "BaseTable base_table", "parent_table"),
    _b("field_lookup_source", "fields", "Field uuid", "Field lookup_field", "lookup_source"),
    _b("field_lookup_relationship", "fields", "Field uuid", "TableOccurrence lookup_to", "lookup_relationship"),
    _b("field_lookup_context", "fields", "Field uuid", "TableOccurrence lookup_start_to", "lookup_context"),
    _b("field_summarizes", "fields", "Field uuid", "Field summary_field", "summarizes_field"),
    _b("field_validation_list", "fields", "Field uuid", "ValueList validation_list", "uses_valuelist", "validation"),
    _b("occurrence_table", "occurrences", "TableOccurrence uuid", "BaseTable base_table", "base_table"),
    _b("occurrence_source", "occurrences", "TableOccurrence uuid", "ExternalDataSource data_source", "data_source"),
    _b("layout_context", "layouts", "Layout uuid", "TableOccurrence context_to", "context_table"),
    _b("layout_theme", "layouts", "Layout uuid", "Theme theme", "uses_theme"),
    _b("layout_menu_set", "layouts", "Layout uuid", "CustomMenuSet menu_set", "uses_menuset"),
    _b("layout_column", "table_columns", "Layout layout", "Field field", "displays_field", "table_view_column"),
    _b("part_break", "layout_parts", "Layout layout", "Field break_field", "breaks_on_field"),
    _b("object_layout", "layout_objects", "LayoutObject uuid", "Layout layout", "parent_layout"),
    _b("object_parent", "layout_objects", "LayoutObject uuid", "LayoutObject parent", "parent_object", where="nesting > 0"),
    _b("object_field", "layout_objects", "LayoutObject uuid", "Field field", "displays_field"),
    _b("object_label_field", "layout_objects", "LayoutObject uuid", "Field label_field", "displays_field", "label_text"),
    _b("layout_fields", "layout_objects", "Layout layout", "Field field", "displays_field", "aggregated"),
    _b("object_value_list", "layout_objects", "LayoutObject uuid", "ValueList value_list", "uses_valuelist"),
    _b("object_sort_list", "layout_objects", "LayoutObject uuid", "ValueList sort_list", "sorts_by_valuelist"),
    _b("portal_context", "layout_objects", "LayoutObject uuid", "TableOccurrence portal_to", "portal_context", where="type = 'Portal'"),
    _b("button_script", "layout_objects", "LayoutObject uuid", "Script button_script", "triggers_script", "button"),
    _b("button_layout", "layout_objects", "LayoutObject uuid", "Layout button_layout", "navigates_to_layout", "button"),
    _b("button_occurrence", "layout_objects", "LayoutObject uuid", "TableOccurrence button_to", "navigates_to_to", "button"),
    _b("button_field", "layout_objects", "LayoutObject uuid", "Field button_field", "[button_role]", "button"),
    _b("object_symbol", "layout_objects", "LayoutObject uuid", "BuiltinFunction symbol", "displays_symbol"),
    _b("step_script", "steps", "ScriptStep uuid", "Script script", "parent_script"),
    _b("script_calls", "steps", "Script script", "Script called_script", "calls_script", "[call_context]"),
    _b("script_field", "steps", "Script script", "Field field", "[field_role]"),
    _b("script_sort_field", "steps", "Script script", "Field sort_field", "sorts_by_field"),
    _b("script_sort_list", "steps", "Script script", "ValueList sort_list", "sorts_by_valuelist"),
    _b("script_layout", "steps", "Script script", "Layout layout", "navigates_to_layout"),
    _b("script_occurrence", "steps", "Script script", "TableOccurrence target_to", "navigates_to_to"),
    _b("script_source", "steps", "Script script", "ExternalDataSource data_source", "data_source"),
    _b("script_menu_set", "steps", "Script script", "CustomMenuSet menu_set", "installs_menuset"),
    _b("menu_item_menu", "menu_items", "CustomMenuItem uuid", "CustomMenu menu", "parent_menu"),
    _b("menu_item_submenu", "menu_items", "CustomMenuItem uuid", "CustomMenu submenu", "opens_menu"),
    _b("menu_item_script", "menu_items", "CustomMenuItem uuid", "Script script", "triggers_script", "menu"),
    _b("menu_set_menu", "menu_sets", "CustomMenuSet uuid", "CustomMenu menu", "contains_menu"),
    _b("list_primary_field", "value_lists", "ValueList uuid", "Field primary_field", "source_field", "primary"),
    _b("list_secondary_field", "value_lists", "ValueList uuid", "Field secondary_field", "source_field", "secondary"),
    _b("list_occurrence", "value_lists", "ValueList uuid", "TableOccurrence source_to", "source_table"),
    _b("list_start_occurrence", "value_lists", "ValueList uuid", "TableOccurrence start_to", "related_values_from"),
    _b("list_list", "value_lists", "ValueList uuid", "ValueList external_list", "source_valuelist"),
    _b("list_source", "value_lists", "ValueList uuid", "ExternalDataSource external_source", "data_source"),
    _b("trigger_script", "triggers", "ScriptTrigger uuid", "Script script", "trigger_script"),
    _b("trigger_owner", "triggers", "ScriptTrigger uuid", "[owner_type] owner", "trigger_owner"),
    _b("owner_script", "triggers", "[owner_type] owner", "Script script", "triggers_script", "[action]"),
    _b("trigger_parameter", "triggers", "ScriptTrigger uuid", "Field parameter_field", "reads_field", "transaction_parameter"),
    _b("account_privileges", "accounts", "Account uuid", "PrivilegeSet privilege_set", "privilege_set"),
    _b("extended_privileges", "grants", "ExtendedPrivilege uuid", "PrivilegeSet privilege_set", "grants_privilege"),
    _b("restricted_field", "restrictions", "PrivilegeSet privilege_set", "Field target", "restricts_field", "[access]", "target_type = 'Field'"),
    _b("restricted_object", "restrictions", "PrivilegeSet privilege_set", "[target_type] target", "restricts_object", "[access]", "target_type <> 'Field'"),
    _b("file_layout", "file_options", "File file_name", "Layout default_layout", "default_layout"),
    _b("file_account", "file_options", "File file_name", "Account login_account", "auto_login_account"),
    _b("folder", "folders", "[item_type] uuid", "[folder_type] folder", "parent_folder"),
    _b("calculation_field", "calc_refs", "[owner_type] owner", "Field target", "reads_field", "[subrole]", "ref_type = 'FieldRef' AND NOT (owner_type = 'Field' AND subrole IN ('validation', 'validation_message'))"),
    _b("calculation_function", "calc_refs", "[owner_type] owner", "CustomFunction target", "calls_customfunction", "[subrole]", "ref_type = 'CustomFunctionRef' AND NOT (owner_type = 'Field' AND subrole IN ('validation', 'validation_message'))"),
    _b("calculation_validates", "calc_refs", "[owner_type] owner", "Field target", "validates_by_calc", "[subrole]", "ref_type = 'FieldRef' AND owner_type = 'Field' AND subrole IN ('validation', 'validation_message')"),
    _b("calculation_validates_function", "calc_refs", "[owner_type] owner", "CustomFunction target", "validates_by_calc", "[subrole]", "ref_type = 'CustomFunctionRef' AND owner_type = 'Field' AND subrole IN ('validation', 'validation_message')"),
    _b("calculation_builtin", "calc_refs", "[owner_type] owner", "BuiltinFunction target", "calls_function", "[subrole]", "ref_type = 'FunctionRef'"),
    _b("calculation_plugin", "calc_refs", "[owner_type] owner", "PluginFunction target", "calls_pluginfunction", "[subrole]", "ref_type = 'PluginFunctionRef'"),
    _b("calculation_runs_script", "calc_refs", "[owner_type] owner", "Script run_script", "calls_script", "plugin", "ref_type = 'PluginFunctionRef'"),
    _b("owner_calculation", "calc_refs", "[owner_type] owner", "Calculation calculation", "has_calculation", "[subrole]"),
    _b("script_sets", "variable_uses", "Script owner", "Variable variable", "sets_variable", "", "owner_type = 'Script' AND usage = 'set'"),
    _b("script_reads", "variable_uses", "Script owner", "Variable variable", "reads_variable", "", "owner_type = 'Script' AND usage = 'read'"),
    _b("field_reads", "variable_uses", "Field owner", "Variable variable", "reads_variable", "", "owner_type = 'Field'"),
    _b("function_reads", "variable_uses", "CustomFunction owner", "Variable variable", "reads_variable", "", "owner_type = 'CustomFunction' AND usage = 'read'"),
    _b("function_sets", "variable_uses", "CustomFunction owner", "Variable variable", "sets_variable", "", "owner_type = 'CustomFunction' AND usage = 'set'"),
    _b("object_shows", "variable_uses", "LayoutObject owner", "Variable variable", "displays_variable", "", "owner_type = 'LayoutObject' AND usage = 'merge'"),
    _b("object_reads", "variable_uses", "LayoutObject owner", "Variable variable", "reads_variable", "", "owner_type = 'LayoutObject' AND usage <> 'merge'"),
    _b("privilege_reads", "variable_uses", "PrivilegeSet owner", "Variable variable", "reads_variable", "", "owner_type = 'PrivilegeSet'"),
    _b("group", "group_members", "LayoutObject uuid", "LayoutObject grouped_in", "groups_into"),
]
COLUMNS = ("block", "source_uuid", "source_type", "target_uuid", "target_type", "link_role", "link_subrole", "link_kind", "source_file")


def links_of(relation: DataFrame, blocks: Iterable[Block]) -> DataFrame:
    """Distinct links of one relation (file_name, the blocks' columns, perhaps is_enabled), from one pass over it."""
    rows = [
        F.when(F.expr(b.where), F.struct(
            F.lit(b.name).alias("block"), F.expr(b.source).cast("string").alias("source_uuid"), F.expr(b.source_type).alias("source_type"),
            F.expr(b.target).cast("string").alias("target_uuid"), F.expr(b.target_type).alias("target_type"),
            F.expr(b.role).alias("link_role"), F.expr(b.subrole).alias("link_subrole"),
        ))
        for b in blocks
    ]
    if "is_enabled" in relation.columns:
        relation = relation.where("is_enabled")
    known = F.filter(F.array(*rows), lambda x: x.isNotNull() & x["source_uuid"].isNotNull() & x["target_uuid"].isNotNull())
    out = relation.select(F.col("file_name").alias("source_file"), F.explode(known).alias("x")).select("x.*", "source_file")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("link_role")]
    return out.withColumn("link_kind", F.coalesce(kind, F.lit("unknown"))).select(*COLUMNS).distinct()


def object_links(relations: dict[str, DataFrame]) -> DataFrame:
    """Links of all given relations by all blocks that read them."""
    by: dict[str, list[Block]] = {}
    for b in BLOCKS:
        if b.relation in relations:
            by.setdefault(b.relation, []).append(b)
    if not by:
        raise ValueError("no relation that a block reads")
    return reduce(DataFrame.unionByName, [links_of(relations[r], blocks) for r, blocks in by.items()])


# The relations as the star schema gives them; the same SQL runs in both engines.
_F = "'File' || (%s %% 5) AS file_name"
RELATIONS = {
    "relationships": f"SELECT 'REL' || c_custkey AS uuid, 'TO' || c_nationkey AS left_to, 'TO' || ((c_nationkey + c_custkey) % 25) AS right_to, 'FLD' || (c_custkey % 200) AS left_field, CASE WHEN c_custkey % 13 <> 0 THEN 'FLD' || ((c_custkey * 7) % 200) END AS right_field, CASE WHEN c_custkey % 5 = 0 THEN 'FLD' || (c_custkey % 31) END AS left_sort_field, CASE WHEN c_custkey % 7 = 0 THEN 'FLD' || (c_custkey % 37) END AS right_sort_field, CASE WHEN c_custkey % 11 = 0 THEN 'VL' || (c_custkey % 10) END AS left_sort_list, CASE WHEN c_custkey % 17 = 0 THEN 'VL' || (c_custkey % 10) END AS right_sort_list, {_F % 'c_nationkey'} FROM customer",
    "fields": f"SELECT 'FLD' || p_partkey AS uuid, 'BT' || p_size AS base_table, CASE WHEN p_partkey % 7 = 0 THEN 'FLD' || (p_partkey + 1) END AS lookup_field, CASE WHEN p_partkey % 7 = 0 THEN 'TO' || (p_size % 25) END AS lookup_to, CASE WHEN p_partkey % 14 = 0 THEN 'TO' || (p_partkey % 25) END AS lookup_start_to, CASE WHEN p_type LIKE '%STEEL%' THEN 'FLD' || (p_partkey % 50) END AS summary_field, CASE WHEN p_partkey % 9 = 0 THEN 'VL' || (p_partkey % 12) END AS validation_list, {_F % 'p_size'} FROM part",
    "occurrences": f"SELECT 'TO' || n_nationkey AS uuid, 'BT' || (n_nationkey + 1) AS base_table, CASE WHEN n_regionkey = 1 THEN 'DS' || (n_nationkey % 3) END AS data_source, {_F % 'n_nationkey'} FROM nation",
    "layouts": f"SELECT 'LAY' || s_suppkey AS uuid, 'TO' || s_nationkey AS context_to, 'TH' || (s_suppkey % 4) AS theme, CASE WHEN s_suppkey % 3 = 0 THEN 'MS' || (s_suppkey % 2) END AS menu_set, {_F % 's_nationkey'} FROM supplier",
    "table_columns": f"SELECT 'LAY' || s_suppkey AS layout, 'FLD' || (s_suppkey * 3) AS field, {_F % 's_nationkey'} FROM supplier",
    "layout_parts": f"SELECT 'LAY' || s_suppkey AS layout, CASE WHEN s_suppkey % 2 = 0 THEN 'FLD' || (s_suppkey * 5) END AS break_field, {_F % 's_nationkey'} FROM supplier",
    "layout_objects": f"SELECT 'OBJ' || p_partkey AS uuid, 'LAY' || (p_partkey % 90) AS layout, CASE WHEN p_partkey % 3 = 0 THEN 'OBJ' || (p_partkey - 1) END AS parent, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS nesting, CASE WHEN p_partkey % 8 = 0 THEN 'Portal' ELSE 'Field' END AS type, CASE WHEN p_partkey % 4 <> 0 THEN 'FLD' || (p_partkey % 300) END AS field, CASE WHEN p_partkey % 6 = 0 THEN 'FLD' || (p_partkey % 11) END AS label_field, CASE WHEN p_partkey % 5 = 0 THEN 'VL' || (p_partkey % 12) END AS value_list, CASE WHEN p_partkey % 16 = 0 THEN 'VL' || (p_partkey % 7) END AS sort_list, 'TO' || (p_partkey % 25) AS portal_to, CASE WHEN p_partkey % 10 = 0 THEN 'SCR' || (p_partkey % 40) END AS button_script, CASE WHEN p_partkey % 10 = 1 THEN 'LAY' || (p_partkey % 40) END AS button_layout, CASE WHEN p_partkey % 10 = 2 THEN 'TO' || (p_partkey % 25) END AS button_to, CASE WHEN p_partkey % 10 = 3 THEN 'FLD' || (p_partkey % 40) END AS button_field, CASE WHEN p_partkey % 20 = 3 THEN 'sets_field' ELSE 'references_field' END AS button_role, CASE WHEN p_partkey % 20 = 4 THEN 'RecordNumber' END AS symbol, {_F % 'p_size'} FROM part",
    "group_members": f"SELECT 'OBJ' || p_partkey AS uuid, CASE WHEN p_partkey % 3 = 0 THEN 'OBJ' || (p_partkey - 1) END AS grouped_in, {_F % 'p_size'} FROM part",
    "steps": f"SELECT 'ST' || o_orderkey AS uuid, 'SCR' || (o_custkey % 500) AS script, CASE WHEN o_orderkey % 9 = 0 THEN 'SCR' || (o_orderkey % 500) END AS called_script, CASE o_custkey % 4 WHEN 0 THEN 'on_server' WHEN 1 THEN 'on_server_callback' END AS call_context, CASE WHEN o_orderkey % 9 IN (1, 2, 3) THEN 'FLD' || (o_custkey % 200) END AS field, CASE o_orderkey % 7 WHEN 0 THEN 'sets_field' WHEN 1 THEN 'navigates_to_field' WHEN 2 THEN 'exports_from_field' WHEN 3 THEN 'imports_to_field' WHEN 4 THEN 'inputs_to_field' WHEN 5 THEN 'finds_in_field' ELSE 'references_field' END AS field_role, CASE WHEN o_orderkey % 9 = 4 THEN 'FLD' || (o_custkey % 99) END AS sort_field, CASE WHEN o_orderkey % 9 = 4 AND o_custkey % 2 = 0 THEN 'VL' || (o_custkey % 12) END AS sort_list, CASE WHEN o_orderkey % 9 = 5 THEN 'LAY' || (o_custkey % 90) END AS layout, CASE WHEN o_orderkey % 9 = 6 THEN 'TO' || (o_custkey % 25) END AS target_to, CASE WHEN o_orderkey % 9 = 7 THEN 'DS' || (o_custkey % 3) END AS data_source, CASE WHEN o_orderkey % 9 = 8 THEN 'MS' || (o_custkey % 2) END AS menu_set, o_orderstatus <> 'P' AS is_enabled, {_F % 'o_custkey'} FROM orders",
    "menu_items": f"SELECT 'MI' || s_suppkey AS uuid, 'MN' || (s_suppkey % 9) AS menu, CASE WHEN s_suppkey % 4 = 0 THEN 'MN' || (s_suppkey % 5) END AS submenu, CASE WHEN s_suppkey % 4 = 1 THEN 'SCR' || (s_suppkey % 50) END AS script, {_F % 's_suppkey'} FROM supplier",
    "menu_sets": f"SELECT 'MS' || (n_nationkey % 2) AS uuid, 'MN' || (n_nationkey % 9) AS menu, {_F % 'n_regionkey'} FROM nation",
    "value_lists": f"SELECT 'VL' || n_nationkey AS uuid, CASE WHEN n_regionkey < 3 THEN 'FLD' || (n_nationkey * 2) END AS primary_field, CASE WHEN n_regionkey = 0 THEN 'FLD' || (n_nationkey * 3) END AS secondary_field, CASE WHEN n_regionkey < 3 THEN 'TO' || n_nationkey END AS source_to, CASE WHEN n_regionkey = 2 THEN 'TO' || ((n_nationkey + 3) % 25) END AS start_to, CASE WHEN n_regionkey = 3 THEN 'VL' || ((n_nationkey + 1) % 25) END AS external_list, CASE WHEN n_regionkey = 3 THEN 'DS' || (n_nationkey % 3) END AS external_source, {_F % 'n_nationkey'} FROM nation",
    "triggers": f"SELECT 'TR' || s_suppkey AS uuid, 'SCR' || (s_suppkey % 60) AS script, CASE s_suppkey % 3 WHEN 0 THEN 'Layout' WHEN 1 THEN 'LayoutObject' ELSE 'File' END AS owner_type, CASE s_suppkey % 3 WHEN 0 THEN 'LAY' || s_suppkey WHEN 1 THEN 'OBJ' || s_suppkey ELSE 'File' || (s_nationkey % 5) END AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'OnEnter' ELSE 'OnSave' END AS action, CASE WHEN s_suppkey % 8 = 0 THEN 'FLD' || s_suppkey END AS parameter_field, {_F % 's_nationkey'} FROM supplier",
    "accounts": f"SELECT 'ACC' || c_custkey AS uuid, 'PS' || (c_nationkey % 6) AS privilege_set, {_F % 'c_nationkey'} FROM customer",
    "grants": f"SELECT 'EP' || n_regionkey AS uuid, 'PS' || (n_nationkey % 6) AS privilege_set, {_F % 'n_nationkey'} FROM nation",
    "restrictions": f"SELECT 'PS' || (p_size % 6) AS privilege_set, CASE p_partkey % 4 WHEN 0 THEN 'Layout' WHEN 1 THEN 'ValueList' WHEN 2 THEN 'Script' ELSE 'Field' END AS target_type, CASE p_partkey % 4 WHEN 0 THEN 'LAY' || (p_partkey % 90) WHEN 1 THEN 'VL' || (p_partkey % 25) WHEN 2 THEN 'SCR' || (p_partkey % 60) ELSE 'FLD' || p_partkey END AS target, CASE WHEN p_size > 25 THEN 'none' ELSE 'view' END AS access, {_F % 'p_size'} FROM part",
    "file_options": f"SELECT 'LAY' || (n_nationkey + 1) AS default_layout, CASE WHEN n_nationkey % 2 = 0 THEN 'ACC' || n_nationkey END AS login_account, {_F % 'n_nationkey'} FROM nation",
    "folders": f"SELECT 'SCR' || c_custkey AS uuid, CASE WHEN c_custkey % 10 = 0 THEN 'ScriptFolder' ELSE 'Script' END AS item_type, 'ScriptFolder' AS folder_type, 'SCR' || (c_custkey - c_custkey % 10) AS folder, {_F % 'c_nationkey'} FROM customer",
    "calc_refs": f"SELECT CASE l_suppkey % 7 WHEN 0 THEN 'CustomFunction' WHEN 1 THEN 'Script' WHEN 2 THEN 'LayoutObject' WHEN 3 THEN 'PrivilegeSet' WHEN 4 THEN 'CustomMenuItem' WHEN 5 THEN 'ScriptTrigger' ELSE 'Field' END AS owner_type, 'OWN' || (l_partkey % 1000) AS owner, CASE l_linenumber WHEN 1 THEN 'FieldRef' WHEN 2 THEN 'CustomFunctionRef' WHEN 3 THEN 'FunctionRef' WHEN 4 THEN 'PluginFunctionRef' ELSE 'NoRef' END AS ref_type, 'X' || (l_suppkey % 40) AS target, CASE WHEN l_quantity < 5 THEN 'SCR' || (l_suppkey % 30) END AS run_script, CASE WHEN l_returnflag = 'A' THEN 'auto_enter' WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25 THEN 'validation_message' WHEN l_returnflag = 'R' THEN 'validation' ELSE 'field_calculation' END AS subrole, 'CALC' || (l_partkey % 300) AS calculation, {_F % 'l_suppkey'} FROM lineitem",
    "variable_uses": f"SELECT CASE o_custkey % 5 WHEN 0 THEN 'Script' WHEN 1 THEN 'Field' WHEN 2 THEN 'CustomFunction' WHEN 3 THEN 'LayoutObject' ELSE 'PrivilegeSet' END AS owner_type, 'OWN' || (o_custkey % 300) AS owner, CASE o_orderstatus WHEN 'F' THEN 'set' WHEN 'O' THEN 'read' ELSE 'merge' END AS usage, '$v' || (o_orderkey % 50) AS variable, {_F % 'o_custkey'} FROM orders",
}
#: Queries over parts of the catalog: relations of each.
GROUPS = {
    "edges_schema": ("relationships", "fields", "occurrences"),
    "edges_layouts": ("layouts", "table_columns", "layout_parts", "layout_objects", "group_members"),
    "edges_scripts": ("steps", "triggers", "folders"),
    "edges_lists_and_menus": ("value_lists", "menu_items", "menu_sets"),
    "edges_access": ("accounts", "grants", "restrictions", "file_options"),
    "edges_calculations": ("calc_refs",),
    "edges_variables": ("variable_uses",),
}
_TABLES = ("customer", "supplier", "part", "orders", "nation", "lineitem")


def relations(spark: SparkSession, d: str, names: Iterable[str]) -> dict[str, DataFrame]:
    tables = {t: load(spark, d, t) for t in _TABLES}
    return {n: spark.sql(RELATIONS[n].replace(f"FROM {t}", f"FROM {{{t}}}"), **{t: tables[t]}) for n in names for t in [RELATIONS[n].rsplit(" ", 1)[1]]}


def _query(names: tuple[str, ...]):
    return lambda spark, d: object_links(relations(spark, d, names))


def link_role_registry(spark: SparkSession, d: str) -> DataFrame:
    """All roles with their kind, and whether they count as where-used."""
    rows = [(r, k, k == "usage" and r not in MIRRORS) for r, k in KINDS.items()]
    return spark.createDataFrame(rows, "link_role string, link_kind string, counts_for_where_used boolean")


def links_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Every registered role with its links and distinct ends; roles without a link count 0."""
    links = object_links(relations(spark, d, RELATIONS))
    per = links.groupBy("link_role").agg(F.count("*").alias("n"), F.count_distinct("source_type", "source_uuid").alias("sources"), F.count_distinct("target_type", "target_uuid").alias("targets"))
    return link_role_registry(spark, d).join(per, "link_role", "left").select("link_role", "link_kind", "counts_for_where_used", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "sources", "targets")])


def where_used(spark: SparkSession, d: str) -> DataFrame:
    """For every target the links that count as its use: number, distinct users and the roles, in order."""
    used = object_links(relations(spark, d, RELATIONS)).where((F.col("link_kind") == "usage") & ~F.col("link_role").isin(*MIRRORS) & ~F.coalesce(F.col("link_subrole") == "aggregated", F.lit(False)))
    per = used.groupBy("target_type", "target_uuid").agg(F.count("*").alias("n"), F.count_distinct("source_type", "source_uuid").alias("users"), F.array_join(F.array_sort(F.collect_set("link_role")), ",").alias("roles"))
    return per


QUERIES = {name: _query(names) for name, names in GROUPS.items()} | {f.__name__: f for f in (link_role_registry, links_by_role, where_used)}


def _kind_sql() -> str:
    roles = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"CASE WHEN link_role IN ({roles(CONTAINMENT)}) THEN 'containment' WHEN link_role IN ({roles(RESTRICTION)}) THEN 'restriction' WHEN link_role IN ({roles(USAGE)}) THEN 'usage' ELSE 'unknown' END"


def _links_sql(names: Iterable[str]) -> str:
    names = list(names)
    given = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names)
    one = lambda b: (
        f"SELECT '{b.name}' AS block, {b.source} AS source_uuid, {b.source_type} AS source_type, {b.target} AS target_uuid, {b.target_type} AS target_type, {b.role} AS link_role, "
        f"{b.subrole} AS link_subrole, file_name AS source_file FROM {b.relation} WHERE ({b.where}) AND {b.source} IS NOT NULL AND {b.target} IS NOT NULL" + " AND is_enabled" * (b.relation == "steps")
    )
    every = " UNION ALL ".join(one(b) for b in BLOCKS if b.relation in names)
    return f"WITH {given}, every AS ({every}), links AS (SELECT DISTINCT *, {_kind_sql()} AS link_kind FROM every)"


_REGISTRY = "registry AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{k}', {str(k == 'usage' and r not in MIRRORS).lower()})" for r, k in KINDS.items()) + ") t(link_role, link_kind, counts_for_where_used))"
ORACLE_SQL = {name: _links_sql(names) + " SELECT * FROM links" for name, names in GROUPS.items()} | {
    "link_role_registry": f"WITH {_REGISTRY} SELECT * FROM registry",
    "links_by_role": _links_sql(RELATIONS) + f", {_REGISTRY} SELECT r.link_role, r.link_kind, r.counts_for_where_used, count(l.link_role) AS n, count(DISTINCT (l.source_type, l.source_uuid)) FILTER (l.link_role IS NOT NULL) AS sources, count(DISTINCT (l.target_type, l.target_uuid)) FILTER (l.link_role IS NOT NULL) AS targets FROM registry r LEFT JOIN links l ON l.link_role = r.link_role GROUP BY ALL",
    "where_used": _links_sql(RELATIONS) + " SELECT target_type, target_uuid, count(*) AS n, count(DISTINCT (source_type, source_uuid)) AS users, string_agg(DISTINCT link_role, ',' ORDER BY link_role) AS roles FROM links WHERE link_kind = 'usage' AND link_role <> 'trigger_script' AND link_subrole IS DISTINCT FROM 'aggregated' GROUP BY ALL",
}
