"""From exports to catalog and links: the scans' relations as catalog of typed objects, and as the relations that the edge blocks read.

References are taken within the row that holds them, so that no step, field or layout object is shuffled to find what it refers to; only
names (custom functions, label anchors) and hashes (calculations) are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalogs, exports, samples
from . import edges, resolution

# What a step of a type does with the fields it names; other types just refer to them.
FIELD_ROLES = {
    "sets_field": (76, 91, 77, 61, 131, 160, 48, 49, 130, 116, 40, 46, 11, 12, 13, 14, 60, 161, 188, 189, 191, 193, 194, 203, 211, 214, 215, 221, 241, 144, 245),
    "reads_field": (47, 18, 157, 219, 202, 246, 192, 68, 125, 72, 141, 1),
    "exports_from_field": (132, 36),
    "navigates_to_field": (17, 74),
    "finds_in_field": (28, 126, 127, 22, 155),
    "sorts_by_field": (39, 154),
    "imports_to_field": (35,),
    "inputs_to_field": (87,),
}
# Types of steps by what else they refer to.
CALLS = {1: None, 164: "on_server", 210: "on_server_callback"}
TO_LAYOUT = (6, 74, 122)
TO_RELATED, SORTS, SETS_VARIABLE, INSTALLS_MENU_SET, LOGS_IN = 74, 39, 141, 142, 138

_STEP_COLUMNS = ("called_script", "call_context", "field", "field_role", "sort_field", "sort_list", "layout", "target_to", "data_source", "menu_set")


def field_role(step_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for role, ids in FIELD_ROLES.items() for i in ids for x in (i, role)])
    return F.coalesce(F.element_at(known, step_id.cast("int")), F.lit("references_field"))


def _tags(body: Column) -> Column:
    """Reference tags of a column of raw XML in order: kind, id, name, uuid; empty values are null."""
    value = lambda t, a: F.nullif(F.regexp_extract(t, rf'\s{a}="([^"]*)"', 1), F.lit(""))
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(rf"<\w+Reference\s{exports.TAG}>"), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.regexp_extract(t, r"<(\w+)Reference", 1).alias("kind"), value(t, "id").try_cast("long").alias("id"), exports._plain(value(t, "name")).alias("name"), value(t, "UUID").alias("uuid")))


def step_references(steps: DataFrame) -> DataFrame:
    """References of script steps (`exports.steps`): file_name, script_uuid, uuid, step_id, is_enabled, ref_type, ref_id, ref_name, ref_uuid.

    Which references count is told by the step's type, as names of steps are in the language of the exporting program: the first script of a
    call, the first layout and table occurrence of a jump, the menu set of an installation, the data source of a login (number 0 is the file
    itself), all value lists of a sort, and all fields of any step but those without identity and name. A set variable is named only.
    """
    tags, step = F.col("_tags"), F.col("step_id")
    of = lambda kind, when: F.when(when, F.filter(tags, lambda t: (t["kind"] == kind) & (t["uuid"].isNotNull() | t["name"].isNotNull()))).otherwise(F.array())
    first = lambda kind, when: F.slice(of(kind, when), 1, 1)
    variable = F.nullif(F.regexp_extract(F.coalesce("body", F.lit("")), r'<Name\s[^>]*value="([^"]*)"', 1), F.lit(""))
    none = F.lit(None)
    named = F.struct(F.lit("Variable").alias("kind"), none.cast("long").alias("id"), exports._plain(variable).alias("name"), none.cast("string").alias("uuid"))
    every = F.concat(
        first("Script", step.isin(*CALLS)), first("Layout", step.isin(*TO_LAYOUT)), first("TableOccurrence", step == TO_RELATED), first("CustomMenuSet", step == INSTALLS_MENU_SET),
        F.filter(first("DataSource", step == LOGS_IN), lambda t: t["uuid"].isNotNull() & (F.coalesce(t["id"], F.lit(0)) != 0)), F.filter(of("ValueList", step == SORTS), lambda t: t["uuid"].isNotNull()),
        of("Field", F.lit(True)), F.when((step == SETS_VARIABLE) & variable.isNotNull(), F.array(named)).otherwise(F.array()),
    )
    rows = steps.withColumn("_tags", _tags(F.col("body"))).select("file_name", "script_uuid", "uuid", "step_id", "is_enabled", F.explode(every).alias("r"))
    return rows.select("file_name", "script_uuid", "uuid", "step_id", "is_enabled", F.col("r.kind").alias("ref_type"), F.col("r.id").alias("ref_id"), F.col("r.name").alias("ref_name"), F.col("r.uuid").alias("ref_uuid"))


def _steps(steps: DataFrame) -> DataFrame:
    """The edge blocks' steps: one row for each step and one for each of its references."""
    refs, step = step_references(steps), F.col("step_id")
    kind = lambda name: F.when(F.col("ref_type") == name, F.col("ref_uuid"))
    context = F.element_at(F.create_map(*[F.lit(x) for k, v in CALLS.items() if v for x in (k, v)]), step.cast("int"))
    values = {
        "called_script": kind("Script"), "call_context": F.when(F.col("ref_type") == "Script", context), "field": kind("Field"), "field_role": F.when(F.col("ref_type") == "Field", field_role(step)), "sort_field": F.lit(None),
        "sort_list": kind("ValueList"), "layout": kind("Layout"), "target_to": kind("TableOccurrence"), "data_source": kind("DataSource"), "menu_set": kind("CustomMenuSet"),
    }
    head = ("file_name", "uuid", F.col("script_uuid").alias("script"), "is_enabled")
    rows = refs.where("ref_type <> 'Variable'").select(*head, *[c.cast("string").alias(k) for k, c in values.items()])
    return steps.select(*head, *[F.lit(None).cast("string").alias(k) for k in _STEP_COLUMNS]).unionByName(rows)


def label_anchors(objects: DataFrame, layouts: DataFrame, occurrences: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that stand as `<<TO::Field>>` or `<<Field>>` in buttons' labels: file_name, uuid, field_uuid, anchor; one row for each resolved anchor.

    A qualified anchor goes by the occurrence of that name in the file, any other by the layout's; a repetition in brackets is left out, and
    names match without case. Formulas and variables in such brackets are no fields. Anchors of occurrences of other files are not resolved.
    """
    found = objects.where("type like '%Button%' and text like '%<<%>>%'").select("file_name", "layout_uuid", "uuid", F.explode(F.expr(r"regexp_extract_all(text, '<<[^>]+?>>', 0)")).alias("_mark"))
    anchor = F.regexp_replace(F.trim(F.expr("substr(_mark, 3, length(_mark) - 4)")), r"\[[0-9]+\]$", "")
    marks = found.where(~F.col("_mark").startswith("<<$") & ~F.col("_mark").startswith("<<ƒ:")).select("file_name", "layout_uuid", "uuid", anchor.alias("anchor"))
    qualified = F.contains("anchor", F.lit("::"))
    parts = marks.select("*", F.when(qualified, F.lower(F.split_part("anchor", F.lit("::"), F.lit(1)))).alias("_to"), F.lower(F.when(qualified, F.split_part("anchor", F.lit("::"), F.lit(2))).otherwise(F.col("anchor"))).alias("_field"))
    local = occurrences.where("data_source_uuid is null")
    by_name = local.select("file_name", F.lower("name").alias("_to"), F.col("base_table_uuid").alias("_named"))
    context = layouts.select("file_name", F.col("uuid").alias("layout_uuid"), "context_uuid").join(local.select("file_name", F.col("uuid").alias("context_uuid"), F.col("base_table_uuid").alias("_context")), ["file_name", "context_uuid"]).drop("context_uuid")
    placed = parts.join(by_name, ["file_name", "_to"], "left").join(context, ["file_name", "layout_uuid"], "left")
    placed = placed.withColumn("base_table_uuid", F.when(F.col("_to").isNotNull(), F.col("_named")).otherwise(F.col("_context")))
    known = fields.where("uuid is not null").select("file_name", "base_table_uuid", F.lower("name").alias("_field"), F.col("uuid").alias("field_uuid"))
    return placed.join(known, ["file_name", "base_table_uuid", "_field"]).select("file_name", "uuid", "field_uuid", "anchor")


_OBJECT_COLUMNS = ("field", "label_field", "value_list", "sort_list", "portal_to", "button_script", "button_layout", "button_to", "button_field", "button_role", "symbol")


def _layout_objects(objects: DataFrame, anchors: DataFrame) -> DataFrame:
    """The edge blocks' layout objects: one row for each object, one for each of its references, one for each anchor in its label."""
    head = ("file_name", "uuid", F.col("layout_uuid").alias("layout"), F.col("parent_uuid").alias("parent"), "nesting", "type")
    refs = objects.select("*", F.explode("refs").alias("r")).where("r.ref_type not in ('trigger', 'calculation')")
    kind = lambda *names: F.when(F.col("r.ref_type").isin(*names), F.col("r.ref_uuid"))
    values = {
        "field": kind("field", "merge_field"), "label_field": F.lit(None), "value_list": kind("value_list"), "sort_list": kind("sort_list"), "portal_to": kind("portal"), "button_script": kind("script"),
        "button_layout": kind("layout_step"), "button_to": kind("occurrence_step"), "button_field": kind("field_step"), "button_role": F.when(F.col("r.ref_type") == "field_step", field_role(F.col("r.step_id"))), "symbol": F.lit(None),
    }
    rows = refs.select(*head, *[c.cast("string").alias(k) for k, c in values.items()])
    bare = objects.select(*head, *[F.lit(None).cast("string").alias(k) for k in _OBJECT_COLUMNS])
    labels = anchors.select("file_name", "uuid", *[F.lit(None).cast(t).alias(k) for k, t in (("layout", "string"), ("parent", "string"), ("nesting", "long"), ("type", "string"))], *[(F.col("field_uuid") if k == "label_field" else F.lit(None).cast("string")).alias(k) for k in _OBJECT_COLUMNS])
    return bare.unionByName(rows).unionByName(labels)


def _relationships(df: DataFrame) -> DataFrame:
    """Fields of each predicate, and each side's sorts with the first."""
    names = ("left_field", "right_field", "left_sort_field", "right_sort_field", "left_sort_list", "right_sort_list")
    row = lambda **given: "named_struct(" + ", ".join(f"'{n}', {given.get(n, 'CAST(NULL AS STRING)')}" for n in names) + ")"
    sorts = [f"CASE WHEN coalesce(predicate, 1) = 1 THEN coalesce(transform({s}_sorts, x -> {row(**{f'{s}_sort_field': 'x.field_uuid', f'{s}_sort_list': 'x.list_uuid'})}), array()) ELSE array() END" for s in ("left", "right")]
    every = F.expr(f"concat(array({row(left_field='left_field_uuid', right_field='right_field_uuid')}), {', '.join(sorts)})")
    key = relationship_key()
    return df.select("file_name", key.alias("uuid"), F.col("left_uuid").alias("left_to"), F.col("right_uuid").alias("right_to"), F.explode(every).alias("x")).select("file_name", "uuid", "left_to", "right_to", "x.*")


def relationship_key() -> Column:
    """A relationship's identity; without one its number and file."""
    return F.coalesce(F.nullif(F.col("uuid"), F.lit("")), F.concat(F.lit("rel_"), F.col("id").cast("string"), F.lit("_"), F.col("file_name")))


def triggers(spark: SparkSession, path: str, objects: DataFrame | None = None) -> DataFrame:
    """Triggers of files, layouts and layout objects at any depth: file_name, uuid, trigger_id, owner_type, owner, action, script, script_name; a file is its own name."""
    objects = exports.layout_objects(spark, path) if objects is None else objects
    columns = ["file_name", "trigger_id", "owner_type", "owner", "action", "script", "script_name"]
    scan = lambda name, owner: catalogs.scan(spark, path, name).select("file_name", "trigger_id", "owner_type", F.col(owner).alias("owner"), "action", F.col("script_uuid").alias("script"), "script_name")
    inner = objects.select("file_name", F.col("uuid").alias("owner"), F.explode("refs").alias("r")).where("r.ref_type = 'trigger'")
    inner = inner.select("file_name", F.col("r.ref_id").alias("trigger_id"), F.lit("LayoutObject").alias("owner_type"), "owner", F.col("r.action").alias("action"), F.col("r.ref_uuid").alias("script"), F.col("r.ref_name").alias("script_name"))
    every = scan("file_triggers", "file_name").unionByName(scan("layout_triggers", "owner_uuid")).unionByName(inner).select(*columns)
    uuid = F.concat_ws("_", F.lit("trig"), F.col("trigger_id").cast("string"), F.col("owner"), F.col("file_name"))
    return every.select(uuid.alias("uuid"), "*", F.lit(None).cast("string").alias("parameter_field"))


def calculation_owners(spark: SparkSession, path: str, objects: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """What holds calculations: file_name, owner_type, owner, subrole, calc_hash; of fields by slot, scripts' steps, functions, record access and layout objects."""
    objects = exports.layout_objects(spark, path) if objects is None else objects
    slots = {"calculation_hash": "field_calculation", "auto_enter_hash": "auto_enter", "validation_hash": "validation", "validation_message_hash": "validation_message", "display_names_hash": "display_names"}
    pairs = F.array(*[F.struct(F.lit(v).alias("subrole"), F.col(k).alias("calc_hash")) for k, v in slots.items()])
    fields = exports.fields(spark, path).select("file_name", F.lit("Field").alias("owner_type"), F.col("uuid").alias("owner"), F.inline(pairs))
    functions = catalogs.scan(spark, path, "custom_function_calcs").select("file_name", F.lit("CustomFunction"), "function_uuid", F.lit("custom_function"), "calc_hash")
    access = catalogs.scan(spark, path, "record_access").select("file_name", F.lit("PrivilegeSet"), "privilege_set_uuid", F.lit("record_access"), "calc_hash")
    hashes = F.expr("""transform(filter(regexp_extract_all(coalesce(body, ''), '<DDRREF\\\\s[^>]*>', 0), t -> t not like '%kind="StepText"%'), t -> regexp_extract(t, 'hash="([^"]*)"', 1))""")
    steps = (exports.steps(spark, path) if steps is None else steps).where("is_enabled").select("file_name", F.lit("Script"), "script_uuid", F.lit("step_parameter"), F.explode(hashes))
    boxes = objects.select("file_name", F.lit("LayoutObject"), "uuid", F.lit("layout_object"), F.explode("refs").alias("r")).where("r.ref_type = 'calculation'").select(*[F.col(c) for c in ("file_name", "LayoutObject", "uuid", "layout_object", "r.ref_name")])
    return reduce(DataFrame.union, [fields, functions, access, steps, boxes]).where("owner is not null and nullif(calc_hash, '') is not null").distinct()


def calc_refs(owners: DataFrame, chunks: DataFrame, functions: DataFrame) -> DataFrame:
    """The edge blocks' references of calculations: fields by identity, custom functions by their name in the file, others by name; calculation is the owner's.

    Tokens (`exports.chunks`) are those of one calculation for each file and hash, and each distinct one is joined once.
    """
    kinds = ("FieldRef", "CustomFunctionRef", "FunctionRef", "PluginFunctionRef", "VariableReference")
    content = F.col("chunk_content")
    target = F.when(F.col("chunk_type") == "FieldRef", F.nullif(F.regexp_extract(content, r'FieldReference\s[^>]*UUID="([^"]+)"', 1), F.lit(""))).otherwise(F.trim(content))
    wanted = resolution.representatives(chunks).where(F.col("calc_hash").isNotNull() & F.col("chunk_type").isin(*kinds)).select("file_name", "calc_hash", F.col("chunk_type").alias("ref_type"), target.alias("target")).distinct()
    named = functions.where("folder_type = 'False' and uuid is not null").groupBy("file_name", F.col("name").alias("target")).agg(F.min("uuid").alias("_uuid")).withColumn("ref_type", F.lit("CustomFunctionRef"))
    found = wanted.join(named, ["file_name", "target", "ref_type"], "left").withColumn("target", F.when(F.col("ref_type") == "CustomFunctionRef", F.col("_uuid")).otherwise(F.col("target"))).drop("_uuid")
    mine = owners.withColumn("calculation", F.md5(F.concat_ws("::", F.lit("Calculation"), "file_name", "owner", "subrole", "calc_hash")))
    return mine.join(found, ["file_name", "calc_hash"], "left").select("file_name", "owner_type", "owner", "subrole", "ref_type", "target", "calculation", F.lit(None).cast("string").alias("run_script"))


def variable_uses(steps: DataFrame, refs: DataFrame) -> DataFrame:
    """The edge blocks' uses of variables: set by steps, read by calculations; a variable is the digest of its scope, anchor and name."""
    sets = step_references(steps).where("ref_type = 'Variable' and is_enabled").select("file_name", F.lit("Script").alias("owner_type"), F.col("script_uuid").alias("owner"), F.lit("set").alias("usage"), F.col("ref_name").alias("name"))
    reads = refs.where("ref_type = 'VariableReference' and target like '$%'").select("file_name", "owner_type", "owner", F.lit("read").alias("usage"), F.col("target").alias("name"))
    uses = sets.unionByName(reads).distinct()
    anchored = resolution.variable_usages(uses.select("*", F.when(F.col("owner_type") == "Script", F.col("owner")).alias("script_uuid"), F.lit(None).cast("string").alias("context_uuid")))
    return anchored.select("file_name", "owner_type", "owner", "usage", F.md5(F.concat_ws("::", "scope", "anchor", "name")).alias("variable"), "name", "scope", "anchor")


def relations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations that the edge blocks read, from the exports at path; folders, groups and symbols are not among them."""
    scan = lambda name, **columns: catalogs.scan(spark, path, name).select("file_name", *[F.expr(v).alias(k) for k, v in columns.items()])
    path = catalogs.indexed(spark, path)
    steps, objects = exports.kept(exports.steps(spark, path)), exports.kept(exports.layout_objects(spark, path))
    occurrences, fields, layouts = exports.occurrences(spark, path), exports.fields(spark, path), catalogs.scan(spark, path, "layouts")
    refs = calc_refs(calculation_owners(spark, path, objects, steps), exports.chunks(spark, path), catalogs.scan(spark, path, "custom_functions"))
    sets = catalogs.scan(spark, path, "menu_sets").select("file_name", "uuid", F.explode("menu_ids").alias("_id"))
    menus = catalogs.scan(spark, path, "menus").select("file_name", F.col("id").alias("_id"), F.col("uuid").alias("menu"))
    privileges = catalogs.scan(spark, path, "privilege_sets").select("file_name", F.col("name").alias("_set"), F.col("uuid").alias("privilege_set"))
    granted = catalogs.scan(spark, path, "extended_privileges").select("file_name", "uuid", F.explode("privilege_set_names").alias("_set"))
    accounts = catalogs.scan(spark, path, "accounts")
    by_name = accounts.select("file_name", F.col("name").alias("_account"), F.col("uuid").alias("login_account"))
    options = scan("file_options", default_layout="nullif(default_layout_uuid, '')", _account="login_account")
    out = {
        "relationships": _relationships(exports.relationships(spark, path)),
        "fields": fields.select("file_name", "uuid", *[F.col(v).alias(k) for k, v in (("base_table", "base_table_uuid"), ("lookup_field", "lookup_field_uuid"), ("lookup_to", "lookup_to_uuid"), ("lookup_start_to", "lookup_start_to_uuid"), ("summary_field", "summary_field_uuid"), ("validation_list", "validation_list_uuid"))]),
        "occurrences": occurrences.select("file_name", "uuid", F.col("base_table_uuid").alias("base_table"), F.col("data_source_uuid").alias("data_source")),
        "layouts": layouts.where("folder_type = 'False' and not is_separator").select("file_name", "uuid", F.col("context_uuid").alias("context_to"), F.col("theme_uuid").alias("theme"), F.col("menu_set_uuid").alias("menu_set")),
        "table_columns": scan("table_view_columns", layout="layout_uuid", field="field_uuid"),
        "layout_parts": scan("layout_parts", layout="layout_uuid", break_field="break_uuid"),
        "layout_objects": _layout_objects(objects, label_anchors(objects, layouts, occurrences, fields)),
        "steps": _steps(steps),
        "menu_items": scan("menu_items", uuid="item_uuid", menu="menu_uuid", submenu="submenu_uuid", script="script_uuid"),
        "menu_sets": sets.join(menus, ["file_name", "_id"]).select("file_name", "uuid", "menu"),
        "value_lists": scan("value_list_options", uuid="list_uuid", primary_field="primary_uuid", secondary_field="secondary_uuid", source_to="primary_to_uuid", start_to="CASE WHEN related_only THEN start_to_uuid END", external_list="external_uuid", external_source="data_source_uuid"),
        "triggers": triggers(spark, path, objects),
        "accounts": accounts.select("file_name", "uuid", F.col("privilege_set_name").alias("_set")).join(privileges, ["file_name", "_set"]).drop("_set"),
        "grants": granted.join(privileges, ["file_name", "_set"]).drop("_set"),
        "restrictions": scan("object_access", privilege_set="privilege_set_uuid", target_type="object_class", target="object_uuid", access="access").unionByName(scan("field_access", privilege_set="privilege_set_uuid", target_type="'Field'", target="field_uuid", access="access")),
        "file_options": options.join(by_name, ["file_name", "_account"], "left").drop("_account"),
        "calc_refs": refs,
        "variable_uses": variable_uses(steps, refs),
    }
    empty = lambda df: df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" and c not in ("file_name", "subrole") else F.col(c) for c, t in df.dtypes])
    return {k: empty(df) for k, df in out.items()}


def export_links(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """Links of the exports at path by all edge blocks, or by those of the named relations."""
    every = relations(spark, path)
    return edges.object_links({k: v for k, v in every.items() if names is None or k in names})


def object_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All objects of the exports at path, typed: object_uuid, object_type, object_name, file_name, object_id.

    Folders are objects of their own; separators and the ends of folders are none. Triggers, parts and paste entries have keys made of what
    tells them apart, variables and types of steps digests; a file is its name.
    """
    scan = lambda name: catalogs.scan(spark, path, name)
    path = catalogs.indexed(spark, path)
    steps, objects = exports.kept(exports.steps(spark, path)), exports.kept(exports.layout_objects(spark, path))
    text = "CAST({} AS STRING)".format

    def of(df: DataFrame, kind: str, name: str, uuid: str = "uuid", number: str = "id", where: str = "true") -> DataFrame:
        return df.where(where).select(F.expr(uuid).cast("string").alias("object_uuid"), F.lit(kind).alias("object_type"), F.expr(name).cast("string").alias("object_name"), "file_name", F.expr(number).cast("long").alias("object_id"))

    plain = "folder_type = 'False' and not is_separator"
    box = f"coalesce(nullif(name, ''), type || ' @ (' || coalesce({text('CAST(top AS BIGINT)')}, '0') || ',' || coalesce({text('CAST(left AS BIGINT)')}, '0') || ')')"
    refs = calc_refs(calculation_owners(spark, path, objects, steps), exports.chunks(spark, path), scan("custom_functions"))
    variables = variable_uses(steps, refs).where("scope <> 'let_local'").groupBy("variable", "name", "scope", "anchor").agg(F.min("file_name").alias("file_name"))
    kinds = steps.select(F.col("step_name").alias("name")).where("name <> ''").distinct().withColumn("file_name", F.lit(None).cast("string"))
    files = catalogs.root_attributes(spark, path).select("file_name")
    builtins = refs.where("ref_type in ('FunctionRef', 'PluginFunctionRef') and target is not null").select(F.col("target").alias("name"), "ref_type", F.lit(None).cast("string").alias("file_name")).distinct()
    folders = [of(scan(n), "Folder", "name", where="folder_type = 'True' and not is_separator") for n in ("scripts", "layouts", "custom_functions")]
    return reduce(DataFrame.unionByName, [
        of(exports.base_tables(spark, path), "BaseTable", "name"), of(exports.occurrences(spark, path), "TableOccurrence", "name"),
        of(exports.relationships(spark, path).withColumn("_key", relationship_key()), "Relationship", "left_name || ' → ' || right_name", "_key").distinct(),
        of(exports.fields(spark, path), "Field", "base_table || '::' || name"), of(scan("value_lists"), "ValueList", "name"), of(scan("custom_functions"), "CustomFunction", "name", where=plain),
        of(scan("scripts"), "Script", "name", where=plain), of(steps, "ScriptStep", f"script_name || ' [' || {text('step_index')} || '] ' || step_name", number="step_id"), of(scan("layouts"), "Layout", "name", where=plain),
        of(scan("layout_parts"), "LayoutPart", "layout_name || ' [' || part_type || coalesce(' · ' || break_name, '') || ']'", f"'part_' || {text('layout_id')} || '_' || {text('part_kind')} || '_' || {text('part_seq')} || '_' || file_name", "layout_id"),
        of(objects, "LayoutObject", box, number="object_id"), of(scan("accounts"), "Account", "coalesce(name, description)"), of(scan("privilege_sets"), "PrivilegeSet", "name"),
        of(scan("paste_index"), "PasteIndexObject", f"'Paste Object #' || {text('object_id')}", f"'paste_' || {text('object_id')} || '_' || file_name", "object_id"), of(scan("base_directories"), "BaseDirectory", "name"),
        of(triggers(spark, path, objects), "ScriptTrigger", "action || ' → ' || coalesce(script_name, '<no script assigned>')", number="trigger_id"), of(scan("extended_privileges"), "ExtendedPrivilege", "name"),
        of(scan("menus"), "CustomMenu", "name"), of(scan("menu_sets"), "CustomMenuSet", "name"),
        of(scan("menu_items").join(scan("menus").select("file_name", F.col("uuid").alias("menu_uuid"), F.col("name").alias("_menu")), ["file_name", "menu_uuid"], "left"), "CustomMenuItem", "_menu || ' › ' || coalesce(nullif(command, ''), CASE WHEN is_separator THEN '(Separator)' ELSE '(berechnet)' END)", "item_uuid", "menu_id"),
        of(scan("themes"), "Theme", "coalesce(nullif(display, ''), name)"), of(exports.data_sources(spark, path), "ExternalDataSource", "name"), of(variables, "Variable", "name", "variable", "NULL"),
        of(kinds, "ScriptStepType", "name", "md5('ScriptStepType::' || name)", "NULL"), of(files, "File", "file_name", "file_name", "NULL"),
        of(builtins, "BuiltinFunction", "name", "name", "NULL", "ref_type = 'FunctionRef'"), of(builtins, "PluginFunction", "name", "name", "NULL", "ref_type = 'PluginFunctionRef'"),
        of(refs.select("file_name", "calculation", "subrole").distinct(), "Calculation", "subrole", "calculation", "NULL"), *folders,
    ])


#: Relations that the sample exports hold, and types of their objects without the file's name in their key.
SAMPLED = ("relationships", "fields", "occurrences", "layouts", "layout_objects", "steps", "triggers", "calc_refs", "variable_uses")
SAMPLED_TYPES = ("BaseTable", "TableOccurrence", "Relationship", "Field", "Script", "ScriptStep", "Layout", "LayoutObject", "Variable", "ScriptStepType", "BuiltinFunction")


def exports_links(spark: SparkSession, d: str) -> DataFrame:
    """The star schema written as exports, scanned, and linked by the edge blocks; keys with a file's name in them are left out, as files are named by Spark."""
    links = export_links(spark, samples.write_exports(spark, d), SAMPLED)
    return links.where("source_type <> 'ScriptTrigger' and link_role <> 'has_calculation'").drop("source_file", "link_kind").distinct()


def exports_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The star schema written as exports, and their catalog of objects, but for keys with a file's name in them."""
    found = object_catalog(spark, samples.write_exports(spark, d)).where(F.col("object_type").isin(*SAMPLED_TYPES))
    return found.select("object_uuid", "object_type", "object_name", "object_id").distinct()


QUERIES = {f.__name__: f for f in (exports_links, exports_catalog)}

# What the sample exports must give, stated from the tables: block, source, target, role and subrole, rows.
_ON = "orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 = "
_EXPECTED = [
    ("relationship_left_table", "Relationship", "'REL' || c_custkey", "TableOccurrence", "'TO' || c_nationkey", "left_table", None, "customer"),
    ("relationship_right_table", "Relationship", "'REL' || c_custkey", "TableOccurrence", "'TO' || ((c_nationkey + c_custkey) % 25)", "right_table", None, "customer"),
    ("relationship_left_field", "Relationship", "'REL' || c_custkey", "Field", "'FLD' || (c_custkey % 200)", "left_field", None, "customer"),
    ("relationship_left_field", "Relationship", "'REL' || c_custkey", "Field", "'FLD' || (c_custkey % 90)", "left_field", None, "customer WHERE c_custkey % 4 = 0"),
    ("relationship_right_field", "Relationship", "'REL' || c_custkey", "Field", "'FLD' || ((c_custkey * 7) % 200)", "right_field", None, "customer"),
    ("relationship_right_field", "Relationship", "'REL' || c_custkey", "Field", "'FLD' || ((c_custkey * 7) % 90)", "right_field", None, "customer WHERE c_custkey % 4 = 0"),
    ("relationship_sort_left", "Relationship", "'REL' || c_custkey", "Field", "'FLD' || (c_custkey % 31)", "sort_field", "left", "customer WHERE c_custkey % 5 = 0"),
    ("relationship_sort_list_left", "Relationship", "'REL' || c_custkey", "ValueList", "'VL' || (c_custkey % 10)", "sorts_by_valuelist", "left", "customer WHERE c_custkey % 10 = 0"),
    ("field_table", "Field", "'FLD' || p_partkey", "BaseTable", "'BT' || (p_size % 25)", "parent_table", None, "part"),
    ("field_lookup_source", "Field", "'FLD' || p_partkey", "Field", "'FLD' || (p_partkey + 1)", "lookup_source", None, "part WHERE p_partkey % 7 = 0"),
    ("field_lookup_relationship", "Field", "'FLD' || p_partkey", "TableOccurrence", "'TO' || (p_partkey % 25)", "lookup_relationship", None, "part WHERE p_partkey % 7 = 0"),
    ("field_summarizes", "Field", "'FLD' || p_partkey", "Field", "'FLD' || (p_partkey % 50)", "summarizes_field", None, "part WHERE p_partkey % 5 = 0"),
    ("field_validation_list", "Field", "'FLD' || p_partkey", "ValueList", "'VL' || (p_partkey % 12)", "uses_valuelist", "validation", "part WHERE p_partkey % 9 = 0"),
    ("calculation_field", "Field", "'FLD' || p_partkey", "Field", "'FLD' || (p_partkey + 2)", "reads_field", "field_calculation", "part WHERE p_partkey % 3 = 0"),
    ("calculation_builtin", "Field", "'FLD' || p_partkey", "BuiltinFunction", "'Abs'", "calls_function", "field_calculation", "part WHERE p_partkey % 3 = 0"),
    ("field_reads", "Field", "'FLD' || p_partkey", "Variable", "md5('superglobal::__global::$$$v' || (p_partkey % 10))", "reads_variable", None, "part WHERE p_partkey % 3 = 0"),
    ("occurrence_table", "TableOccurrence", "'TO' || n_nationkey", "BaseTable", "'BT' || n_nationkey", "base_table", None, "nation"),
    ("occurrence_source", "TableOccurrence", "'TO' || n_nationkey", "ExternalDataSource", "'DS' || (n_nationkey % 3)", "data_source", None, "nation WHERE n_regionkey = 1"),
    ("step_script", "ScriptStep", "'ST' || o_orderkey", "Script", "'SCR' || o_orderkey", "parent_script", None, "orders WHERE o_orderstatus <> 'P'"),
    ("script_calls", "Script", "'SCR' || o_orderkey", "Script", "'SCR' || o_custkey", "calls_script", None, _ON + "0"),
    ("script_calls", "Script", "'SCR' || o_orderkey", "Script", "'SCR' || o_custkey", "calls_script", "on_server", _ON + "1"),
    ("script_field", "Script", "'SCR' || o_orderkey", "Field", "'FLD' || (o_custkey % 200)", "sets_field", None, _ON + "2"),
    ("script_layout", "Script", "'SCR' || o_orderkey", "Layout", "'LAY' || (o_custkey % 90)", "navigates_to_layout", None, _ON + "3"),
    ("script_occurrence", "Script", "'SCR' || o_orderkey", "TableOccurrence", "'TO' || (o_custkey % 25)", "navigates_to_to", None, _ON + "3"),
    ("script_field", "Script", "'SCR' || o_orderkey", "Field", "'FLD' || (o_custkey % 200)", "sorts_by_field", None, _ON + "4"),
    ("script_sort_list", "Script", "'SCR' || o_orderkey", "ValueList", "'VL' || (o_custkey % 12)", "sorts_by_valuelist", None, _ON + "4"),
    ("script_menu_set", "Script", "'SCR' || o_orderkey", "CustomMenuSet", "'MS' || (o_custkey % 2)", "installs_menuset", None, _ON + "5"),
    ("script_source", "Script", "'SCR' || o_orderkey", "ExternalDataSource", "'DS' || (o_custkey % 3)", "data_source", None, _ON + "6 AND o_custkey % 3 <> 0"),
    ("script_sets", "Script", "'SCR' || o_orderkey", "Variable", "md5('superglobal::__global::$$$v' || (o_custkey % 10))", "sets_variable", None, _ON + "7"),
    ("script_field", "Script", "'SCR' || o_orderkey", "Field", "'FLD' || (o_custkey % 200)", "finds_in_field", None, _ON + "8"),
    ("script_field", "Script", "'SCR' || o_orderkey", "Field", "'FLD' || (o_custkey % 200)", "references_field", None, _ON + "9"),
    ("layout_context", "Layout", "'LAY' || s_suppkey", "TableOccurrence", "'TO' || s_nationkey", "context_table", None, "supplier"),
    *[("object_layout", "LayoutObject", f"'{o}' || s_suppkey", "Layout", "'LAY' || s_suppkey", "parent_layout", None, "supplier") for o in ("POR", "BUT", "BOX")],
    ("object_parent", "LayoutObject", "'BUT' || s_suppkey", "LayoutObject", "'POR' || s_suppkey", "parent_object", None, "supplier"),
    ("object_field", "LayoutObject", "'BOX' || s_suppkey", "Field", "'FLD' || (s_suppkey % 300)", "displays_field", None, "supplier"),
    ("layout_fields", "Layout", "'LAY' || s_suppkey", "Field", "'FLD' || (s_suppkey % 300)", "displays_field", "aggregated", "supplier"),
    ("object_value_list", "LayoutObject", "'BOX' || s_suppkey", "ValueList", "'VL' || (s_suppkey % 7)", "uses_valuelist", None, "supplier"),
    ("portal_context", "LayoutObject", "'POR' || s_suppkey", "TableOccurrence", "'TO' || (s_suppkey % 25)", "portal_context", None, "supplier"),
    ("button_script", "LayoutObject", "'BUT' || s_suppkey", "Script", "'SCR' || (s_suppkey + 1)", "triggers_script", "button", "supplier"),
    ("button_field", "LayoutObject", "'BUT' || s_suppkey", "Field", "'FLD' || (s_suppkey % 40)", "sets_field", "button", "supplier"),
    ("owner_script", "LayoutObject", "'BUT' || s_suppkey", "Script", "'SCR' || s_suppkey", "triggers_script", "OnEnter", "supplier"),
]


def _expected_sql() -> str:
    one = lambda block, st, s, tt, t, role, sub, rows: f"SELECT '{block}' AS block, {s} AS source_uuid, '{st}' AS source_type, {t} AS target_uuid, '{tt}' AS target_type, '{role}' AS link_role, " + (f"'{sub}'" if sub else "CAST(NULL AS VARCHAR)") + f" AS link_subrole FROM {rows}"
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(one(*r) for r in _EXPECTED) + ")"


_ODD = samples.ODD
ORACLE_SQL = {
    "exports_links": _expected_sql(),
    "exports_catalog": f"""SELECT 'BT' || n_nationkey AS object_uuid, 'BaseTable' AS object_type, n_name AS object_name, CAST(n_nationkey AS BIGINT) AS object_id FROM nation
UNION ALL SELECT 'TO' || n_nationkey, 'TableOccurrence', {_ODD}, n_nationkey FROM nation
UNION ALL SELECT 'REL' || c_custkey, 'Relationship', 'n → n', c_custkey FROM customer
UNION ALL SELECT 'FLD' || p_partkey, 'Field', 'T' || (p_size % 25) || '::' || p_name, p_partkey FROM part
UNION ALL SELECT 'SCR' || o_orderkey, 'Script', 'Script', o_orderkey FROM orders
UNION ALL SELECT 'ST' || o_orderkey, 'ScriptStep', {_ODD} || ' [0] Step', [1, 164, 76, 74, 39, 142, 138, 141, 28, 999][o_orderkey % 10 + 1] FROM orders
UNION ALL SELECT 'LAY' || s_suppkey, 'Layout', s_name, s_suppkey FROM supplier
UNION ALL SELECT 'POR' || s_suppkey, 'LayoutObject', 'p', 1 FROM supplier UNION ALL SELECT 'BUT' || s_suppkey, 'LayoutObject', {_ODD}, 2 FROM supplier UNION ALL SELECT 'BOX' || s_suppkey, 'LayoutObject', 'f', 3 FROM supplier
UNION ALL SELECT DISTINCT md5('superglobal::__global::$$$v' || v), 'Variable', '$$$v' || v, NULL FROM (SELECT p_partkey % 10 AS v FROM part WHERE p_partkey % 3 = 0 UNION SELECT o_custkey % 10 FROM {_ON}7)
UNION ALL SELECT DISTINCT md5('ScriptStepType::Step'), 'ScriptStepType', 'Step', NULL FROM orders
UNION ALL SELECT DISTINCT 'Abs', 'BuiltinFunction', 'Abs', NULL FROM part WHERE p_partkey % 3 = 0""",
}
