"""The other catalogs of XML exports as relations, by a table of scans: the element that is a row, its fields, and what is unfolded.

All scans read by row tag with a schema, so that files are split and only the named fields are parsed. Every relation has file_name;
those with an identity have uuid and its stamps (account, user_name, modifications, modified_at). Places of unfolded elements count from 1.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exports
from .exports import _REF, _STAMP, records

_FIELD = f"STRUCT<_id: BIGINT, _name: STRING, _UUID: STRING, _repetition: BIGINT, TableOccurrenceReference: {_REF}>"
_DDR = "STRUCT<_VALUE: STRING, _kind: STRING, _hash: STRING>"
_CALC = f"STRUCT<Text: STRING, DDRREF: {_DDR}, TableOccurrenceReference: {_REF}>"
_ACCESS = f"STRUCT<_access: STRING, Calculation: {_CALC}>"
_TABLE = f"STRUCT<_type: STRING, BaseTableReference: {_REF}, View: {_ACCESS}, Edit: {_ACCESS}, Create: {_ACCESS}, Delete: {_ACCESS}, Fields: STRUCT<_access: STRING, Field: ARRAY<STRUCT<_access: STRING, FieldReference: {_REF}>>>>"
_SIMPLE = "STRUCT<_Create: BOOLEAN, _Edit: BOOLEAN, _Delete: BOOLEAN, _View: STRING, Custom: STRUCT<_Create: BOOLEAN, ObjectList: STRUCT<{}: ARRAY<STRUCT<_access: STRING, {}Reference: " + _REF + ">>>>>"
_RECORDS = f"STRUCT<_Create: BOOLEAN, _Edit: BOOLEAN, _Delete: BOOLEAN, _View: STRING, Custom: STRUCT<ObjectList: STRUCT<Table: ARRAY<{_TABLE}>>>>"
_KINDS = ("Layout", "ValueList", "Script")
_PRIVILEGES = f"_id BIGINT, _name STRING, UUID {_STAMP}, Description STRING, access STRUCT<_default: BOOLEAN, Records: {_RECORDS}, " + ", ".join(f"{k}s: {_SIMPLE.format(k, k)}" for k in _KINDS) + ", Other: STRUCT<_value: BIGINT, _Print: BOOLEAN, _Export: BOOLEAN, _manageDatabase: BOOLEAN, _manageAccounts: BOOLEAN>>"
_TRIGGER = f"STRUCT<_id: BIGINT, _action: STRING, _browseMode: BOOLEAN, _findMode: BOOLEAN, _previewMode: BOOLEAN, _scriptParameterFieldName: STRING, ScriptReference: {_REF}>"
_TRIGGERS = f"ScriptTriggers STRUCT<ScriptTrigger: ARRAY<{_TRIGGER}>>"
_HEAD = f"_id BIGINT, _name STRING, _isFolder STRING, _isSeparatorItem BOOLEAN, UUID {_STAMP}"
_ITEM = f"STRUCT<_index: BIGINT, _hash: STRING, _isSubMenuItem: BOOLEAN, _isSeparatorItem: BOOLEAN, UUID: STRUCT<_VALUE: STRING>, Command: STRUCT<_id: BIGINT, _name: STRING>, CustomMenuReference: {_REF}, ScriptReference: {_REF}>"


def _ref(path: str, name: str) -> dict[str, str]:
    return {f"{name}_id": f"{path}._id", f"{name}_name": f"{path}._name", f"{name}_uuid": f"{path}._UUID"}


def _folder() -> dict[str, str]:
    return {"folder_type": "coalesce(_isFolder, 'False')", "is_separator": "coalesce(_isSeparatorItem, false)"}


@dataclass(frozen=True)
class Scan:
    """tag and schema of the rows; columns by SQL; unfold: an array, whose elements are `x` and places `at`; stamp: the identity's path."""

    tag: str
    schema: str
    columns: dict[str, str]
    where: str = "true"
    unfold: str | None = None
    stamp: str | None = "UUID"
    keys: tuple[str, ...] = field(default=("id",))


_NAMED = {"id": "_id", "name": "_name"}
_OWNER = {"privilege_set_id": "_id", "privilege_set_name": "_name", "privilege_set_uuid": "trim(UUID._VALUE)"}
SCANS = {
    "value_lists": Scan("ValueList", f"_id BIGINT, _name STRING, UUID {_STAMP}, Source STRUCT<_value: STRING>", _NAMED | {"source": "Source._value"}, "_id IS NOT NULL"),
    "value_list_options": Scan(
        "ValueList",
        f"ValueListReference {_REF}, Source STRUCT<_value: STRING>, Field STRUCT<PrimaryField: STRUCT<_show: BOOLEAN, _sort: BOOLEAN, FieldReference: {_FIELD}>, SecondaryField: STRUCT<_show: BOOLEAN, _sort: BOOLEAN, FieldReference: {_FIELD}>, ShowRelated: STRUCT<_value: BOOLEAN, TableOccurrenceReference: {_REF}>>, CustomValues STRUCT<Text: ARRAY<STRING>>, External STRUCT<DataSourceReference: {_REF}, ValueListReference: {_REF}>",
        _ref("ValueListReference", "list") | {"source": "Source._value", "values": "CustomValues.Text", "related_only": "coalesce(Field.ShowRelated._value, false)"} | _ref("Field.PrimaryField.FieldReference", "primary") | _ref("Field.PrimaryField.FieldReference.TableOccurrenceReference", "primary_to") | _ref("Field.SecondaryField.FieldReference", "secondary")
        | _ref("Field.ShowRelated.TableOccurrenceReference", "start_to") | _ref("External.DataSourceReference", "data_source") | _ref("External.ValueListReference", "external"),
        "ValueListReference._id IS NOT NULL AND Source._value IS NOT NULL", stamp=None, keys=("list_id",),
    ),
    "custom_functions": Scan("CustomFunction", _HEAD + f", Display STRING, ObjectList STRUCT<Parameter: ARRAY<STRUCT<_VALUE: STRING, _name: STRING>>>, Calculation {_CALC}", _NAMED | _folder() | {"display": "Display", "parameters": "transform(ObjectList.Parameter, p -> p._name)", "calc_hash": "Calculation.DDRREF._hash"}, "_id IS NOT NULL"),
    "custom_function_calcs": Scan("CustomFunctionCalc", f"CustomFunctionReference {_REF}, Calculation STRUCT<Text: STRING, DDRREF: {_DDR}>", _ref("CustomFunctionReference", "function") | {"text": "Calculation.Text", "calc_hash": "Calculation.DDRREF._hash", "calc_kind": "Calculation.DDRREF._kind"}, "CustomFunctionReference._id IS NOT NULL", stamp=None, keys=("function_id",)),
    "scripts": Scan("Script", _HEAD + ", Options STRUCT<_VALUE: BIGINT, _hidden: BOOLEAN, _access: STRING, _runwithfullaccess: BOOLEAN>", _NAMED | _folder() | {"is_hidden": "coalesce(Options._hidden, false)", "full_access": "coalesce(Options._runwithfullaccess, false)"}, "_id IS NOT NULL"),
    "layouts": Scan("Layout", _HEAD + f", _width BIGINT, TableOccurrenceReference {_REF}, LayoutThemeReference {_REF}, MenuSet STRUCT<CustomMenuSetReference: {_REF}>, Options STRUCT<_VALUE: STRING, _hidden: STRING>",
        _NAMED | _folder() | {"width": "_width", "is_hidden": "coalesce(lower(Options._hidden) = 'true', false)", "options": "try_cast(Options._VALUE AS BIGINT)"} | _ref("TableOccurrenceReference", "context") | _ref("LayoutThemeReference", "theme") | {k: f"CASE WHEN MenuSet.CustomMenuSetReference._id <> 0 THEN {v} END" for k, v in _ref("MenuSet.CustomMenuSetReference", "menu_set").items()}, "_id IS NOT NULL AND UUID IS NOT NULL"),
    "layout_parts": Scan("Layout", f"_id BIGINT, _name STRING, UUID {_STAMP}, PartsList STRUCT<Part: ARRAY<STRUCT<_type: STRING, _kind: BIGINT, Definition: STRUCT<_absolute: DOUBLE, _size: DOUBLE, FieldReference: {_REF}>>>>",
        {"layout_id": "_id", "layout_name": "_name", "layout_uuid": "trim(UUID._VALUE)", "part_seq": "at", "part_type": "x._type", "part_kind": "x._kind", "part_top": "x.Definition._absolute", "part_size": "x.Definition._size"} | _ref("x.Definition.FieldReference", "break"), unfold="PartsList.Part", stamp=None, keys=("layout_id", "part_seq")),
    "table_view_columns": Scan("Layout", f"_id BIGINT, _name STRING, UUID {_STAMP}, TableView STRUCT<ObjectList: STRUCT<TableViewLayoutObject: ARRAY<STRUCT<_hidden: BOOLEAN, _id: BIGINT, _name: STRING, _width: BIGINT, FieldReference: {_FIELD}>>>>",
        {"layout_id": "_id", "layout_uuid": "trim(UUID._VALUE)", "place": "at", "id": "x._id", "name": "x._name", "is_hidden": "coalesce(x._hidden, false)", "width": "x._width"} | _ref("x.FieldReference", "field") | _ref("x.FieldReference.TableOccurrenceReference", "to"), "_id IS NOT NULL", "TableView.ObjectList.TableViewLayoutObject", None, ("layout_id", "place")),
    "accounts": Scan("Account", f"_id BIGINT, _kind BIGINT, _type STRING, _enable BOOLEAN, UUID {_STAMP}, Description STRING, Authentication STRUCT<AccountName: STRING>, PrivilegeSetReference {_REF}", {"id": "_id", "kind": "_kind", "type": "_type", "is_enabled": "coalesce(_enable, true)", "description": "Description", "name": "Authentication.AccountName"} | _ref("PrivilegeSetReference", "privilege_set"), "_id IS NOT NULL"),
    "privilege_sets": Scan("PrivilegeSet", _PRIVILEGES, _NAMED | {"description": "Description", "is_default": "coalesce(access._default, false)"} | {f"{k.lower()}_{op.lower()}": f"access.{k}._{op}" for k in ("Records", "Layouts", "ValueLists", "Scripts") for op in ("Create", "Edit", "Delete", "View")} | {"may_print": "access.Other._Print", "may_export": "access.Other._Export", "manages_database": "access.Other._manageDatabase", "manages_accounts": "access.Other._manageAccounts"}, "_id IS NOT NULL"),
    "record_access": Scan("PrivilegeSet", _PRIVILEGES, _OWNER | _ref("x.t.BaseTableReference", "table") | {"table_type": "x.t._type", "operation": "x.op", "access": "x.a._access", "calc_hash": "x.a.Calculation.DDRREF._hash", "calc_text": "x.a.Calculation.Text"}, "x.a IS NOT NULL",
        "flatten(transform(access.Records.Custom.ObjectList.Table, t -> array(named_struct('op', 'View', 'a', t.View, 't', t), named_struct('op', 'Edit', 'a', t.Edit, 't', t), named_struct('op', 'Create', 'a', t.Create, 't', t), named_struct('op', 'Delete', 'a', t.Delete, 't', t))))", None, ("privilege_set_id", "table_id", "operation")),
    "field_access": Scan("PrivilegeSet", _PRIVILEGES, _OWNER | _ref("x.t", "table") | _ref("x.f.FieldReference", "field") | {"access": "x.f._access"}, "x.f IS NOT NULL",
        "flatten(transform(access.Records.Custom.ObjectList.Table, t -> transform(t.Fields.Field, f -> named_struct('t', t.BaseTableReference, 'f', f))))", None, ("privilege_set_id", "table_id", "field_id")),
    "object_access": Scan("PrivilegeSet", _PRIVILEGES, _OWNER | {"object_class": "x.class", "may_create": "coalesce(x.may, false)", "access": "x.access"} | _ref("x.r", "object"), "x.r IS NOT NULL",
        "concat(" + ", ".join(f"coalesce(transform(access.{k}s.Custom.ObjectList.{k}, o -> named_struct('class', '{k}', 'may', access.{k}s.Custom._Create, 'access', o._access, 'r', o.{k}Reference)), array())" for k in _KINDS) + ")", None, ("privilege_set_id", "object_class", "object_id")),
    "paste_index": Scan("PasteIndexList", "Object ARRAY<STRUCT<_VALUE: STRING, _id: BIGINT>>", {"object_id": "x._id", "list_index": "at"}, "x._id IS NOT NULL", "array_sort(Object, (a, b) -> CASE WHEN a._id < b._id THEN -1 WHEN a._id > b._id THEN 1 ELSE 0 END)", None, ("object_id",)),
    "base_directories": Scan("BaseDirectory", f"_id BIGINT, _name STRING, _relativeTo STRING, UUID {_STAMP}", _NAMED | {"relative_to": "_relativeTo"}, "_id IS NOT NULL"),
    "file_triggers": Scan("AddAction", _TRIGGERS, {"owner_type": "'File'", "owner_uuid": "CAST(NULL AS STRING)", "trigger_id": "x._id", "action": "x._action", "browse_mode": "x._browseMode", "find_mode": "x._findMode", "preview_mode": "x._previewMode", "parameter_field": "x._scriptParameterFieldName"} | _ref("x.ScriptReference", "script"), unfold="ScriptTriggers.ScriptTrigger", stamp=None, keys=("action", "script_id")),
    "layout_triggers": Scan("Layout", f"_id BIGINT, UUID {_STAMP}, {_TRIGGERS}", {"owner_type": "'Layout'", "owner_uuid": "trim(UUID._VALUE)", "trigger_id": "x._id", "action": "x._action", "browse_mode": "x._browseMode", "find_mode": "x._findMode", "preview_mode": "x._previewMode", "parameter_field": "x._scriptParameterFieldName"} | _ref("x.ScriptReference", "script"), unfold="ScriptTriggers.ScriptTrigger", stamp=None, keys=("owner_uuid", "action")),
    "object_triggers": Scan("LayoutObject", f"_id BIGINT, UUID {_STAMP}, {_TRIGGERS}", {"owner_type": "'LayoutObject'", "owner_uuid": "trim(UUID._VALUE)", "trigger_id": "x._id", "action": "x._action", "browse_mode": "x._browseMode", "find_mode": "x._findMode", "preview_mode": "x._previewMode", "parameter_field": "x._scriptParameterFieldName"} | _ref("x.ScriptReference", "script"), unfold="ScriptTriggers.ScriptTrigger", stamp=None, keys=("owner_uuid", "action")),
    "extended_privileges": Scan("ExtendedPrivilege", f"_id BIGINT, _name STRING, Description STRING, UUID {_STAMP}, ObjectList STRUCT<PrivilegeSetReference: ARRAY<{_REF}>>", _NAMED | {"description": "Description", "privilege_set_ids": "coalesce(transform(ObjectList.PrivilegeSetReference, r -> r._id), array())", "privilege_set_names": "coalesce(transform(ObjectList.PrivilegeSetReference, r -> r._name), array())"}, "_id IS NOT NULL"),
    "menus": Scan("CustomMenu", f"_id BIGINT, _name STRING, UUID {_STAMP}", _NAMED, "_id IS NOT NULL"),
    "menu_items": Scan("CustomMenu", f"_id BIGINT, _name STRING, UUID {_STAMP}, ObjectList STRUCT<CustomMenuItem: ARRAY<{_ITEM}>>", {"menu_id": "_id", "menu_uuid": "trim(UUID._VALUE)", "place": "at", "item_uuid": "trim(x.UUID._VALUE)", "item_hash": "x._hash", "is_submenu": "coalesce(x._isSubMenuItem, false)", "is_separator": "coalesce(x._isSeparatorItem, false)", "command": "x.Command._name"} | _ref("x.CustomMenuReference", "submenu") | _ref("x.ScriptReference", "script"), "_id IS NOT NULL", "ObjectList.CustomMenuItem", None, ("menu_id", "place")),
    "file_access": Scan("Authorization", f"_id BIGINT, _type STRING, _self STRING, Display STRING, Authentication STRING, UUID {_STAMP}, Source STRUCT<_VALUE: STRING, _CreationAccountName: STRING, _CreationTimestamp: STRING>", {"id": "_id", "type": "_type", "is_self": "coalesce(lower(_self) = 'true', false)", "name": "Display", "created_by": "Source._CreationAccountName"}, "UUID._VALUE IS NOT NULL"),
    "menu_sets": Scan("CustomMenuSet", f"_id BIGINT, _name STRING, _comment STRING, UUID {_STAMP}, ObjectList STRUCT<CustomMenuReference: ARRAY<{_REF}>>", _NAMED | {"comment": "_comment", "menu_ids": "coalesce(transform(ObjectList.CustomMenuReference, r -> r._id), array())", "menu_names": "coalesce(transform(ObjectList.CustomMenuReference, r -> r._name), array())"}, "_id IS NOT NULL"),
    "libraries": Scan("LibraryReference", "_id BIGINT, _key STRING, _VALUE STRING", {"id": "_id", "key": "_key"}, "_id IS NOT NULL", stamp=None),
    "themes": Scan("Theme", f"_id BIGINT, _name STRING, _Display STRING, UUID {_STAMP}", _NAMED | {"display": "_Display"}, "_id IS NOT NULL"),
    "file_options": Scan("Metadata", f"AddAction STRUCT<Encryption: STRUCT<_type: STRING>, Minimum: STRUCT<_version: STRING>, Login: STRUCT<_type: STRING, AccountName: STRING>, Defaults: STRUCT<LayoutReference: {_REF}>, SavePassword: STRUCT<_keychain: BOOLEAN>>", {"encryption": "AddAction.Encryption._type", "minimum_version": "AddAction.Minimum._version", "login_type": "AddAction.Login._type", "login_account": "AddAction.Login.AccountName", "keychain": "coalesce(AddAction.SavePassword._keychain, false)"} | _ref("AddAction.Defaults.LayoutReference", "default_layout"), "AddAction IS NOT NULL", stamp=None, keys=()),
}


#: Elements that are rows of the typed scans in `exports`.
_TYPED = ("ExternalDataSource", "BaseTable", "TableOccurrence", "Relationship", "FieldCatalog")


def _inside(s: Scan) -> list[str]:
    """Names of the elements that a scan unfolds, without which it has no row."""
    return s.unfold.split(".") if s.unfold and re.fullmatch(r"[A-Za-z.]+", s.unfold) else []


def indexed(spark: SparkSession, path: str) -> exports.Indexed:
    """The exports at path, indexed for all scans."""
    return exports.indexed(spark, path, {*_TYPED, *(n for s in SCANS.values() for n in (s.tag, *_inside(s)))})


def scan(spark: SparkSession, path: str, name: str, encoding: str = "UTF-8") -> DataFrame:
    """The named relation of all exports at path."""
    s = SCANS[name]
    rows = records(spark, path, s.tag, s.schema, encoding, _inside(s))
    if s.unfold:
        rows = rows.select("*", F.posexplode(F.expr(s.unfold)).alias("at", "x")).withColumn("at", (F.col("at") + 1).cast("long"))
    stamps = exports._stamps(s.stamp) if s.stamp else []
    return rows.where(s.where).select("file_name", *[F.expr(v).alias(k) for k, v in s.columns.items()], *stamps)


def step_texts(spark: SparkSession, path: str) -> DataFrame:
    """Plain texts of script steps: step_uuid (`hash:` and the hash for steps without one), step_hash, step_text."""
    pieces = spark.read.option("lineSep", "</").text(path).select(exports._stem(F.col("_metadata.file_name")).alias("file_name"), "value").where(F.contains("value", F.lit("StepText")))
    tag = F.regexp_extract("value", r"(?s)^.*(<_[^\s>]*\s[^>]*datatype=\"StepText\"[^>]*)>[^<]*$", 1)
    found = pieces.select("file_name", tag.alias("tag"), F.regexp_extract("value", r"(?s)^.*>([^<]*)$", 1).alias("text")).where("tag <> ''")
    own, digest = F.regexp_extract("tag", "^<_([0-9A-Fa-f-]+)", 1), F.regexp_extract("tag", r'\shash="([^"]*)"', 1)
    return found.select("file_name", F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("hash:"), digest)).alias("step_uuid"), digest.alias("step_hash"), exports._plain(F.col("text")).alias("step_text"))


def absorptions(df: DataFrame, catalog: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Census of a relation's identities that occur more than once in a file: catalog, file_name, uuid, n, n_records, absorbed (rows that an upsert by identity loses)."""
    per = df.where("uuid is not null").groupBy("file_name", "uuid").agg(F.count("*").alias("n"), F.count_distinct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("n_records"))
    return per.where("n > 1").select(F.lit(catalog).alias("catalog"), "file_name", "uuid", "n", "n_records", (F.col("n") - 1).alias("absorbed"))


def absorption_details(df: DataFrame, catalog: str, key: str = "id") -> DataFrame:
    """The single records behind a census, in order of their key, the survivor (smallest key) first: catalog, file_name, uuid, key, place, survives."""
    group = Window.partitionBy("file_name", "uuid")
    rows = df.where("uuid is not null").withColumn("_n", F.count("*").over(group)).where("_n > 1")
    place = F.row_number().over(group.orderBy(F.col(key).asc_nulls_last()))
    return rows.select(F.lit(catalog).alias("catalog"), "file_name", "uuid", F.col(key).cast("string").alias("key"), place.cast("long").alias("place")).withColumn("survives", F.col("place") == 1)


def change_stamps(relations: dict[str, DataFrame]) -> DataFrame:
    """Last change by catalog and file: objects, stamped ones, changes, the latest stamp and its user (ties to the smallest name)."""
    out = None
    for name, df in relations.items():
        if "modified_at" not in df.columns:
            continue
        one = df.groupBy("file_name").agg(F.count("*").alias("n"), F.count("modified_at").alias("n_stamped"), F.sum("modifications").alias("modifications"), F.max("modified_at").alias("latest"), F.min_by("user_name", F.struct(-F.unix_micros(F.col("modified_at").cast("timestamp")), "user_name")).alias("latest_user"))
        one = one.select(F.lit(name).alias("catalog"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no relation with stamps")
    return out


def root_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Of each file its encoding (by byte order mark, or by zero bytes) and its root element's name and attributes, from what stands before the first tags' ends."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"))
    # in pieces up to the next end of a tag, the files' bytes as they are; the declaration and the root are among the first
    raw = F.col("value").cast("binary")
    latin = F.replace(F.decode(raw, "ISO-8859-1"), F.lit("\x00"), F.lit(""))  # attributes of the root are in ASCII in any of these encodings
    text = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.hex(F.substring(raw, 1, 2)).alias("start"), latin.alias("head"))
    opens = F.regexp_like("head", F.lit(r"<[A-Za-z_][\w.-]*[^<>]*$"))
    first = text.where("block = 0").groupBy("file").agg(F.min_by("start", "at").alias("mark"), F.min_by("head", F.when(opens, F.col("at"))).alias("head"))
    heads = files.join(first, "file", "left").select("name", F.coalesce("mark", F.lit("")).alias("mark"), F.concat(F.coalesce("head", F.lit("")), F.lit(">")).alias("head"))
    mark = F.col("mark")
    encoding = F.when(mark == "FFFE", "UTF-16LE").when(mark == "FEFF", "UTF-16BE").when(F.substring(mark, 3, 2) == "00", "UTF-16LE").when(F.substring(mark, 1, 2) == "00", "UTF-16BE").otherwise("UTF-8")
    root = F.regexp_extract("head", r"<([A-Za-z_][\w.-]*)([^<>]*)>", 0)
    pairs = F.expr(r"""regexp_extract_all(root, '[\\w:.-]+\\s*=\\s*"[^"]*"', 0)""")
    rows = heads.select(exports._stem(F.col("name")).alias("file_name"), encoding.alias("encoding"), root.alias("root"))
    split = F.transform(pairs, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.regexp_extract(p, '"([^"]*)"', 1).alias("v")))
    return rows.select("file_name", "encoding", F.regexp_extract("root", r"<([\w.-]+)", 1).alias("root"), F.map_from_entries(F.array_distinct(split)).alias("attributes"))


def cleaned(text: str | Column) -> Column:
    """Text without control characters that XML forbids; carriage returns become the delete character, which `restore_lines` turns back."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("\x7f")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
