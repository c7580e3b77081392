"""Calculations and layouts: roles and places of calculations, references of all owner slots, built-in tokens, layout types, parts by geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load
from .graph import cut

# Role of a field's calculation by its slot, and of a layout object's by the slot's name.
FIELD_SLOTS = {0: "field_calculation", 1: "auto_enter", 2: "validation", 3: "container_path", 4: "validation_message", 5: "display_names"}
OBJECT_SLOTS = {
    "Hide": "hide", "Tooltip": "tooltip", "Placeholder": "placeholder", "Label": "button_label", "action": "button_action", "Portal": "portal_filter", "WebViewer": "web_viewer_url",
    "TabPanel": "panel_title", "PopoverPanel": "popover_title", "ButtonBar": "active_segment",
}
# Canonical type of a layout object by kind.
LAYOUT_KINDS = {"Feld": "Edit Box", "Edit": "Edit Box", "Dropdown": "Drop-down List", "Knopf": "Button", "Button": "Button", "Portal": "Portal", "Linie": "Line", "Line": "Line", "Text": "Text"}


def _lookup(keys: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), keys)


def role(owner_type: Column, slot: Column, override: Column) -> Column:
    """Role of a calculation by its owner's type and its slot; an override comes first, an unknown slot's role is its name in lower case."""
    number = slot.try_cast("int")
    of = F.when(owner_type == "Field", _lookup(number, FIELD_SLOTS)).when((owner_type == "ScriptStep") & slot.isin("XML", "XSL"), "step_xslt").when(owner_type == "ScriptStep", "step_parameter")
    of = of.when(owner_type == "PrivilegeSet", "record_access").when((owner_type == "CustomMenuItem") & number.isNotNull(), "menu_item_parameter").when(owner_type == "CustomFunction", "custom_function")
    of = of.when(slot.startswith("DisplayCalculations_"), "display_calculation").when(slot.startswith("ScriptTrigger_"), "script_trigger_parameter").when(slot.startswith("Condition_"), "conditional_format")
    of = of.when(slot.startswith("Series_Value") | slot.startswith("YSeriesList_"), "chart_series").otherwise(_lookup(slot, OBJECT_SLOTS))
    return F.coalesce(override, of, F.nullif(F.lower(slot), F.lit("")), F.lit("unknown"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds calc_index: the place from 1 among calculations of one file, owner and role."""
    return df.withColumn("calc_index", F.row_number().over(Window.partitionBy("file_name", "owner", "role").orderBy(*order)).cast("long"))


def resolve(owners: DataFrame, chunks: DataFrame, ref_types: list[str]) -> DataFrame:
    """References of all owner slots: owners (file_name, owner_type, owner, subrole, calc_hash) meet the tokens of one calculation for each file and hash.

    Chunks (file_name, calc_hash, calc_uuid, place, ref_type, target): calculations of one hash have the same tokens, so the smallest stands for
    all, which keeps the join from fanning out. Owners without hash have no references.
    """
    wanted = chunks.where(F.col("ref_type").isin(*ref_types) & F.col("calc_hash").isNotNull())
    first = wanted.groupBy("file_name", "calc_hash").agg(F.min("calc_uuid").alias("calc_uuid"))
    tokens = wanted.join(first, ["file_name", "calc_hash", "calc_uuid"], "left_semi")
    return owners.join(tokens, ["file_name", "calc_hash"]).groupBy("file_name", "owner_type", "owner", "subrole", "ref_type", "target").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def layout_type(raw: Column, kind: Column, style: Column, has_field: Column) -> Column:
    """Canonical type of a layout object: by its kind, else by its raw (localized) type, else by what it holds; unknown ones keep the raw type."""
    return F.coalesce(_lookup(kind, LAYOUT_KINDS), F.when((raw == "Feld") & (style == "popup"), "Pop-up Menu"), _lookup(raw, LAYOUT_KINDS), F.when(has_field, "Edit Box"), raw)


def parts(objects: DataFrame, parts_: DataFrame) -> DataFrame:
    """Part of each layout object: objects (layout, object, parent, top), parts_ (layout, part_seq, part_top, part_size).

    Objects without parent lie in the part whose stretch holds their top, the first by number at several; children have their parent's,
    whatever the depth, and objects below a missing parent or outside all parts have none. A layout has few parts, so the join on the
    layout stays small; parents are followed in rounds that only carry what the last one found, so loops of parents end.
    """
    roots = objects.where("parent is null").join(parts_, "layout", "left").where("part_seq is null or (part_top <= top and top < part_top + part_size)")
    found = cut(roots.groupBy("layout", "object").agg(F.min("part_seq").alias("part_seq")))
    children = objects.where("parent is not null").select("layout", "object", "parent")
    out = front = found
    while True:
        up = front.select("layout", F.col("object").alias("parent"), "part_seq")
        front = cut(children.join(up, ["layout", "parent"]).select("layout", "object", "part_seq"))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return objects.select("layout", "object").join(out, ["layout", "object"], "left")


def builtin_tokens(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Tokens (token, is_get) to canonical functions: names (local_name, is_get, function), of several the smallest; without match null.

    Only distinct tokens are joined, and names are as many as there are functions and languages.
    """
    distinct = tokens.groupBy("token", "is_get").agg(F.count("*").alias("n"))
    best = names.groupBy(F.lower("local_name").alias("_name"), F.col("is_get").alias("_get")).agg(F.min("function").alias("function"))
    return distinct.join(best, (F.lower("token") == F.col("_name")) & (F.col("is_get") == F.col("_get")), "left").select("token", "is_get", "n", "function")


def retype(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Tokens that are typed as custom functions but bear a design function's name (names: name) become function references."""
    known = names.select(F.lower("name").alias("_name")).distinct().withColumn("_design", F.lit(True))
    joined = chunks.join(known, F.lower("content") == F.col("_name"), "left")
    return joined.withColumn("chunk_type", F.when((F.col("chunk_type") == "CustomFunctionRef") & F.col("_design"), "FunctionRef").otherwise(F.col("chunk_type"))).drop("_name", "_design")


def promote(labels: DataFrame, slots: DataFrame) -> DataFrame:
    """Display calculations of labels: of a label's slots (label, slot, calc) the first as many as its text (label, text) has formula marks `<<f:...>>`."""
    marks = labels.select("label", F.regexp_count("text", F.lit("<<f:[^>]*>>")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("slot", "calc"))
    return slots.withColumn("place", rank).join(marks, "label").where("place <= n").select("label", "slot", "calc", F.col("place").cast("long").alias("place"))


def calculation_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Line items as calculations of their parts: role by owner type and slot, and place among those of one role; rejected ones are not enabled."""
    owner_type = F.element_at(F.array(*[F.lit(x) for x in ("Field", "ScriptStep", "PrivilegeSet", "CustomMenuItem", "LayoutObject", "CustomFunction")]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    slot = F.when(F.col("l_suppkey") % 6 < 4, (F.col("l_linenumber") - 1).cast("string")).when(F.col("l_linenumber") % 2 == 0, "Tooltip").when(F.col("l_linenumber") == 3, "Condition_1").otherwise("Odd")
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("file_name"), F.col("l_partkey").alias("owner"), owner_type.alias("owner_type"), slot.alias("slot"), F.when(F.col("l_quantity") == 50, "overridden").alias("override"), "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").alias("is_enabled"))
    rows = rows.withColumn("role", role(F.col("owner_type"), F.col("slot"), F.col("override")))
    return numbered(rows, ["l_orderkey", "l_linenumber", "slot", "owner_type", "is_enabled"]).select("file_name", "owner", "owner_type", "role", "l_orderkey", "l_linenumber", "is_enabled", "calc_index")


def calculation_references(spark: SparkSession, d: str) -> DataFrame:
    """References of orders' slots to what the line items with their hash hold."""
    owners = load(spark, d, "orders").select(F.col("o_orderstatus").alias("file_name"), F.when(F.col("o_orderkey") % 2 == 0, "Field").otherwise("ScriptStep").alias("owner_type"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("subrole"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 400).alias("calc_hash"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("FieldRef", "CustomFunctionRef", "PluginFunctionRef", "VariableReference", "FunctionRef", "NoRef", "NoRef")]), F.col("l_linenumber").cast("int"))
    chunks = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("file_name"), (F.col("l_partkey") % 400).alias("calc_hash"), F.col("l_orderkey").alias("calc_uuid"), F.col("l_linenumber").cast("long").alias("place"), kinds.alias("ref_type"), F.col("l_suppkey").alias("target"))
    return resolve(owners, chunks, ["FieldRef", "CustomFunctionRef", "PluginFunctionRef", "VariableReference", "FunctionRef"])


def part_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Parts as layout objects: those divisible by three lie in the one before; layouts have three parts, and the third layout none."""
    objects = load(spark, d, "part").select((F.col("p_partkey") % 40).alias("layout"), F.col("p_partkey").alias("object"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") - 40).alias("parent"), F.col("p_size").alias("top"))
    layouts = objects.select("layout").distinct().where("layout <> 3").crossJoin(spark.createDataFrame([(1, 0, 12), (2, 10, 20), (3, 30, 15)], "part_seq int, part_top int, part_size int"))
    return parts(objects, layouts)


def layout_types(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_size") % len(names) + 1).cast("int"))
    rows = load(spark, d, "part").select("p_partkey", pick("Feld", "Linie", "Fremd", "Portal").alias("raw"), F.when(F.col("p_partkey") % 3 == 0, pick("Knopf", "Edit")).alias("kind"), F.when(F.col("p_partkey") % 5 == 0, "popup").alias("style"), (F.col("p_partkey") % 2 == 0).alias("has_field"))
    return rows.select("p_partkey", layout_type(F.col("raw"), F.col("kind"), F.col("style"), F.col("has_field")).alias("type"))


def builtin_resolution(spark: SparkSession, d: str) -> DataFrame:
    tokens = load(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).where("length(token) between 2 and 4").select("token", (F.length("token") == 3).alias("is_get"))
    names = spark.createDataFrame([("the", True, "TheFunction"), ("und", True, "AndFunction"), ("und", True, "Aber"), ("los", True, "LosFunction"), ("de", False, "DeFunction"), ("of", False, "OfFunction")], "local_name string, is_get boolean, function string")
    return builtin_tokens(tokens, names)


def retyped_tokens(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "CustomFunctionRef").otherwise("FieldRef").alias("chunk_type"), F.when(F.col("o_custkey") % 4 == 0, "fieldnames").otherwise("mine").alias("content"))
    return retype(chunks, spark.createDataFrame([("FieldNames",), ("TableIDs",)], "name string"))


def promoted_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "orders").select(F.col("o_orderkey").alias("label"), F.repeat(F.lit("<<f:x>> and "), (F.col("o_custkey") % 4).cast("int")).alias("text"))
    slots = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").cast("long").alias("slot"), F.col("l_partkey").alias("calc"))
    return promote(labels, slots)


QUERIES = {f.__name__: f for f in (calculation_catalog, calculation_references, part_assignment, layout_types, builtin_resolution, retyped_tokens, promoted_labels)}
ORACLE_SQL = {
    "calculation_catalog": "WITH r AS (SELECT l_returnflag AS file_name, l_partkey AS owner, l_orderkey, l_linenumber, l_linestatus = 'O' AS is_enabled, l_quantity, l_suppkey % 6 AS k, CASE WHEN l_suppkey % 6 < 4 THEN CAST(l_linenumber - 1 AS VARCHAR) WHEN l_linenumber % 2 = 0 THEN 'Tooltip' WHEN l_linenumber = 3 THEN 'Condition_1' ELSE 'Odd' END AS slot FROM lineitem), t AS (SELECT *, ['Field', 'ScriptStep', 'PrivilegeSet', 'CustomMenuItem', 'LayoutObject', 'CustomFunction'][k + 1] AS owner_type, CASE WHEN l_quantity = 50 THEN 'overridden' WHEN k = 0 THEN CASE slot WHEN '0' THEN 'field_calculation' WHEN '1' THEN 'auto_enter' WHEN '2' THEN 'validation' WHEN '3' THEN 'container_path' WHEN '4' THEN 'validation_message' WHEN '5' THEN 'display_names' ELSE slot END WHEN k = 1 THEN 'step_parameter' WHEN k = 2 THEN 'record_access' WHEN k = 3 THEN 'menu_item_parameter' WHEN k = 5 THEN 'custom_function' WHEN slot = 'Condition_1' THEN 'conditional_format' WHEN slot = 'Tooltip' THEN 'tooltip' ELSE 'odd' END AS role FROM r) SELECT file_name, owner, owner_type, role, l_orderkey, l_linenumber, is_enabled, row_number() OVER (PARTITION BY file_name, owner, role ORDER BY l_orderkey, l_linenumber, slot, owner_type, is_enabled) AS calc_index FROM t",
    "calculation_references": "WITH o AS (SELECT o_orderstatus AS file_name, CASE WHEN o_orderkey % 2 = 0 THEN 'Field' ELSE 'ScriptStep' END AS owner_type, o_custkey AS owner, o_orderpriority AS subrole, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 400 END AS calc_hash FROM orders), c AS (SELECT l_linestatus AS file_name, l_partkey % 400 AS calc_hash, l_orderkey AS calc_uuid, CAST(l_linenumber AS BIGINT) AS place, ['FieldRef', 'CustomFunctionRef', 'PluginFunctionRef', 'VariableReference', 'FunctionRef', 'NoRef', 'NoRef'][l_linenumber] AS ref_type, l_suppkey AS target FROM lineitem), t AS (SELECT * FROM c WHERE ref_type <> 'NoRef' QUALIFY calc_uuid = min(calc_uuid) OVER (PARTITION BY file_name, calc_hash)) SELECT o.file_name, owner_type, owner, subrole, ref_type, target, count(*) AS n, min(place) AS first_place FROM o JOIN t ON o.file_name = t.file_name AND o.calc_hash = t.calc_hash GROUP BY ALL",
    "part_assignment": "WITH RECURSIVE o AS (SELECT p_partkey % 40 AS layout, p_partkey AS object, CASE WHEN p_partkey % 3 = 0 THEN p_partkey - 40 END AS parent, p_size AS top FROM part), p(part_seq, a, n) AS (VALUES (1, 0, 12), (2, 10, 20), (3, 30, 15)), w(layout, object, part_seq) AS (SELECT layout, object, (SELECT min(part_seq) FROM p WHERE layout <> 3 AND a <= top AND top < a + n) FROM o WHERE parent IS NULL UNION ALL SELECT o.layout, o.object, w.part_seq FROM w JOIN o ON o.parent = w.object AND o.layout = w.layout) SELECT o.layout, o.object, w.part_seq FROM o LEFT JOIN w ON w.object = o.object AND w.layout = o.layout",
    "layout_types": "WITH r AS (SELECT p_partkey, ['Feld', 'Linie', 'Fremd', 'Portal'][p_size % 4 + 1] AS raw, CASE WHEN p_partkey % 3 = 0 THEN ['Knopf', 'Edit'][p_size % 2 + 1] END AS kind, p_partkey % 5 = 0 AS popup, p_partkey % 2 = 0 AS has_field FROM part) SELECT p_partkey, CASE WHEN kind = 'Knopf' THEN 'Button' WHEN kind = 'Edit' THEN 'Edit Box' WHEN raw = 'Feld' AND popup THEN 'Pop-up Menu' WHEN raw = 'Feld' THEN 'Edit Box' WHEN raw = 'Linie' THEN 'Line' WHEN raw = 'Portal' THEN 'Portal' WHEN has_field THEN 'Edit Box' ELSE raw END AS type FROM r",
    "builtin_resolution": "WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents), k AS (SELECT token, length(token) = 3 AS is_get, count(*) AS n FROM t WHERE length(token) BETWEEN 2 AND 4 GROUP BY ALL) SELECT token, is_get, n, CASE WHEN is_get AND lower(token) = 'the' THEN 'TheFunction' WHEN is_get AND lower(token) = 'und' THEN 'Aber' WHEN is_get AND lower(token) = 'los' THEN 'LosFunction' WHEN NOT is_get AND lower(token) = 'de' THEN 'DeFunction' WHEN NOT is_get AND lower(token) = 'of' THEN 'OfFunction' END AS function FROM k",
    "retyped_tokens": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'FieldRef' WHEN o_custkey % 4 = 0 THEN 'FunctionRef' ELSE 'CustomFunctionRef' END AS chunk_type, CASE WHEN o_custkey % 4 = 0 THEN 'fieldnames' ELSE 'mine' END AS content FROM orders",
    "promoted_labels": "WITH s AS (SELECT l_orderkey AS label, CAST(l_linenumber AS BIGINT) AS slot, l_partkey AS calc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem) SELECT label, slot, calc, place FROM s JOIN orders ON o_orderkey = label WHERE place <= o_custkey % 4",
}
