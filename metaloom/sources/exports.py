"""XML exports as relations, one function for each; every record is a row of Spark's XML source, so files are split and columns pruned.

`path` is a file, a folder or a glob of exports; `file_name` is the file's name without its ending. Records without what identifies them
(references to a script, say, where the script itself is meant) are not rows. Optional elements and attributes that are absent are null.

Many scans of one path are cheaper over `indexed(spark, path, names)`, which every scan takes for a path: each then opens only files that hold its
elements, and what is cut out of the files as raw text is cut once.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import unquote
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STAMP = "STRUCT<_VALUE: STRING, _accountName: STRING, _modifications: BIGINT, _timestamp: STRING, _userName: STRING>"
_REF = "STRUCT<_id: BIGINT, _name: STRING, _UUID: STRING>"
_SORT = f"STRUCT<_value: BOOLEAN, SortList: STRUCT<Sort: ARRAY<STRUCT<PrimaryField: STRUCT<FieldReference: {_REF}>, ValueListReference: {_REF}>>>>"
_SIDE = f"STRUCT<_cascadeCreate: BOOLEAN, _cascadeDelete: BOOLEAN, TableOccurrenceReference: {_REF}, SortSpecification: {_SORT}>"
_HASHED = "STRUCT<Calculation: STRUCT<DDRREF: STRUCT<_VALUE: STRING, _hash: STRING>>, _enable: BOOLEAN>"


class Indexed(str):
    """A path of exports with the files that hold an element, by its name, and the raw elements (tag, file_name, xml) of the names in CUT."""

    files: dict[str, list[str]]
    elements: DataFrame


def records(spark: SparkSession, path: str, tag: str, schema: str, encoding: str = "UTF-8", inside: Iterable[str] = ()) -> DataFrame:
    """The elements of one name with the given fields (attributes begin with an underscore), and file_name; inside: names of elements without which there is no row."""
    if isinstance(path, Indexed):
        path = [f for f in path.files[tag] if all(f in path.files[n] for n in inside)]
        if not path:
            return spark.createDataFrame([], schema).withColumn("file_name", F.lit(None).cast("string"))
    df = spark.read.format("xml").option("rowTag", tag).option("encoding", encoding).schema(schema).load(path)
    return df.withColumn("file_name", _stem(F.col("_metadata.file_name")))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _stamps(stamp: str = "UUID") -> list[Column]:
    """Identity and last change of a record."""
    return [
        F.trim(f"{stamp}._VALUE").alias("uuid"), F.col(f"{stamp}._accountName").alias("account"), F.col(f"{stamp}._userName").alias("user_name"),
        F.col(f"{stamp}._modifications").alias("modifications"), F.col(f"{stamp}._timestamp").try_cast("timestamp_ntz").alias("modified_at"),
    ]


def data_sources(spark: SparkSession, path: str) -> DataFrame:
    df = records(spark, path, "ExternalDataSource", f"_id BIGINT, _name STRING, _type STRING, File STRUCT<UniversalPathList: STRING>, UUID {_STAMP}")
    return df.where("_id is not null").select("file_name", F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("_type").alias("type"), F.trim("File.UniversalPathList").alias("path_list"), *_stamps())


def base_tables(spark: SparkSession, path: str) -> DataFrame:
    df = records(spark, path, "BaseTable", f"_id BIGINT, _name STRING, UUID {_STAMP}")
    return df.where("_id is not null").select("file_name", F.col("_id").alias("id"), F.col("_name").alias("name"), *_stamps())


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Table occurrences with their base table, the data source of a foreign one, and their place in the graph."""
    source = f"STRUCT<DataSourceReference: {_REF}, BaseTableReference: {_REF}>"
    df = records(spark, path, "TableOccurrence", f"_id BIGINT, _name STRING, UUID {_STAMP}, BaseTableSourceReference {source}, CoordRect STRUCT<_top: BIGINT, _left: BIGINT, _bottom: BIGINT, _right: BIGINT>")
    of = "BaseTableSourceReference"
    return df.where("_id is not null").select(
        "file_name", F.col("_id").alias("id"), F.col("_name").alias("name"), F.col(f"{of}.BaseTableReference._name").alias("base_table"), F.col(f"{of}.BaseTableReference._UUID").alias("base_table_uuid"),
        F.col(f"{of}.DataSourceReference._name").alias("data_source"), F.col(f"{of}.DataSourceReference._UUID").alias("data_source_uuid"), *[F.col(f"CoordRect._{c}").alias(c) for c in ("top", "left", "bottom", "right")], *_stamps(),
    )


def relationships(spark: SparkSession, path: str) -> DataFrame:
    """One row for each join predicate, counted from 1; a side's sorts, where they are switched on, as arrays of (field_uuid, list_uuid)."""
    field = f"STRUCT<FieldReference: {_REF}>"
    predicate = f"ARRAY<STRUCT<_type: STRING, LeftField: {field}, RightField: {field}>>"
    df = records(spark, path, "Relationship", f"_id BIGINT, UUID {_STAMP}, LeftTable {_SIDE}, RightTable {_SIDE}, JoinPredicateList STRUCT<JoinPredicate: {predicate}>")
    sides = [F.col(f"{s}Table.TableOccurrenceReference._{c}").alias(f"{s.lower()}_{c.lower()}") for s in ("Left", "Right") for c in ("name", "UUID")]
    rules = [F.coalesce(f"{s}Table._cascade{c}", F.lit(False)).alias(f"{s.lower()}_cascade_{c.lower()}") for s in ("Left", "Right") for c in ("Create", "Delete")]
    sorts = [F.expr(f"CASE WHEN {s}Table.SortSpecification._value THEN transform({s}Table.SortSpecification.SortList.Sort, x -> named_struct('field_uuid', nullif(x.PrimaryField.FieldReference._UUID, ''), 'list_uuid', nullif(x.ValueListReference._UUID, ''))) END").alias(f"{s.lower()}_sorts") for s in ("Left", "Right")]
    rows = df.where("LeftTable is not null").select("file_name", F.col("_id").alias("id"), *sides, *rules, *sorts, *_stamps(), F.posexplode_outer("JoinPredicateList.JoinPredicate").alias("at", "p"))
    fields = [F.col(f"p.{s}Field.FieldReference._{c}").alias(f"{s.lower()}_field_{c.lower()}") for s in ("Left", "Right") for c in ("name", "UUID")]
    return rows.select("*", (F.col("at") + 1).cast("long").alias("predicate"), F.col("p._type").alias("operator"), *fields).drop("at", "p")


def fields(spark: SparkSession, path: str) -> DataFrame:
    """Fields of all base tables, with what their options refer to (a lookup that is switched off refers to nothing) and the hashes of their calculations by slot."""
    lookup = f"STRUCT<_enable: BOOLEAN, FieldReference: STRUCT<_id: BIGINT, _name: STRING, _UUID: STRING, TableOccurrenceReference: {_REF}>, Context: STRUCT<TableOccurrenceReference: {_REF}>>"
    item = (
        f"STRUCT<_id: BIGINT, _name: STRING, _fieldtype: STRING, _datatype: STRING, _comment: STRING, UUID: {_STAMP}, Storage: STRUCT<_global: BOOLEAN, _index: STRING, _maxRepetitions: BIGINT>, "
        f"Calculation: STRUCT<DDRREF: STRUCT<_VALUE: STRING, _hash: STRING>>, AutoEnter: STRUCT<_type: STRING, Looked_up: {lookup}, Calculated: {_HASHED}>, "
        f"Validation: STRUCT<_type: STRING, ValueListReference: {_REF}, Calculated: {_HASHED}, MessageCalc: {_HASHED}>, SummaryInfo: STRUCT<_operation: STRING, SummaryField: STRUCT<FieldReference: {_REF}>>, DisplayNames: {_HASHED}>"
    )
    df = records(spark, path, "FieldCatalog", f"BaseTableReference {_REF}, ObjectList STRUCT<Field: ARRAY<{item}>>")
    rows = df.select("file_name", F.col("BaseTableReference._name").alias("base_table"), F.col("BaseTableReference._UUID").alias("base_table_uuid"), F.explode("ObjectList.Field").alias("f"))
    names = {"id": "_id", "name": "_name", "field_type": "_fieldtype", "data_type": "_datatype", "comment": "_comment", "is_global": "Storage._global", "repetitions": "Storage._maxRepetitions"}
    looked = "f.AutoEnter._type = 'Looked_up' AND coalesce(f.AutoEnter.Looked_up._enable, true)"
    refs = {
        "lookup_field_uuid": f"CASE WHEN {looked} THEN f.AutoEnter.Looked_up.FieldReference._UUID END", "lookup_to_uuid": f"CASE WHEN {looked} THEN f.AutoEnter.Looked_up.FieldReference.TableOccurrenceReference._UUID END",
        "lookup_start_to_uuid": f"CASE WHEN {looked} THEN f.AutoEnter.Looked_up.Context.TableOccurrenceReference._UUID END", "summary_field_uuid": "f.SummaryInfo.SummaryField.FieldReference._UUID",
        "validation_list_uuid": "f.Validation.ValueListReference._UUID", "calculation_hash": "f.Calculation.DDRREF._hash",
    }
    slots = {"auto_enter_hash": "AutoEnter.Calculated", "validation_hash": "Validation.Calculated", "validation_message_hash": "Validation.MessageCalc", "display_names_hash": "DisplayNames"}
    refs |= {k: f"CASE WHEN coalesce(f.{v}._enable, true) THEN f.{v}.Calculation.DDRREF._hash END" for k, v in slots.items()}
    return rows.select("file_name", "base_table", "base_table_uuid", *[F.col(f"f.{c}").alias(k) for k, c in names.items()], *[F.nullif(F.expr(v), F.lit("")).alias(k) for k, v in refs.items()], *_stamps("f.UUID"))


#: What stands in a tag behind its name: quoted values may hold the sign that ends a tag.
TAG = r"""(?:[^>"]++|"[^"]*+")*+"""
#: Names of the elements that are cut out of the files as raw text, and what may stand before their opening tag as part of them.
CUT = {"Script": "", "Layout": "", "ChunkList": r"(?:<_[^\s>]+[^>]*>\s*)?"}


def kept(df: DataFrame) -> DataFrame:
    """df written below the checkpoint folder, so that what reads it several times doesn't run it anew; as it is where that folder is unset."""
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        return df
    path = f"{folder.get()}/kept-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _pieces(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """The files' text in pieces that end before the next closing tag, so that none is long however far apart elements of a name are; blocks are the parts of a file that are read apart."""
    text = spark.read.option("lineSep", "</").option("encoding", encoding).text(path)
    return text.select(_stem(F.col("_metadata.file_name")).alias("file_name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _census(pieces: DataFrame, names: Iterable[str]) -> list[tuple[str, int, str, int]]:
    """Of each block and name that occurs in it: file, block, name, opening less closing tags."""
    names = sorted(names)
    opening = F.regexp_extract_all("value", F.lit(rf"<(?:{'|'.join(names)})(?:[\s/]{TAG})?+>"), F.lit(0))
    closing = F.regexp_extract("value", r"^(\w+)\s*>", 1)
    opened = F.transform(opening, lambda t: F.struct(F.regexp_extract(t, r"^<(\w+)", 1).alias("name"), F.when(t.endswith("/>"), 0).otherwise(1).alias("net")))
    events = F.concat(opened, F.when(closing.isin(names), F.array(F.struct(closing.alias("name"), F.lit(-1).alias("net")))).otherwise(F.array()))
    rows = pieces.select("file", "block", F.inline(events)).groupBy("file", "block", "name").agg(F.sum("net").alias("net"))
    return [tuple(r) for r in rows.collect()]


def _cut(pieces: DataFrame, tags: Iterable[str], census: list[tuple[str, int, str, int]]) -> DataFrame:
    """Elements of these names as raw XML from their opening tag on, without the closing one: tag, file_name, xml; elements mustn't stand in others of their name.

    Text is taken piece by piece, so that memory holds one element at most. An element that goes over the end of a block is put together from its
    parts: the census tells which elements are open where a block begins.
    """
    spark = pieces.sparkSession
    tags, nets = tuple(tags), {}
    for file, block, name, net in sorted(census):
        nets.setdefault((file, name), []).append((block, net))
    states: dict[tuple[str, str], tuple[list[int], list[bool]]] = {}
    for key, of in nets.items():
        depth, after = 0, []
        for _, net in of:
            depth = max(0, depth + net)
            after.append(depth > 0)
        if any(after):
            states[key] = [block for block, _ in of], after
    shared = spark.sparkContext.broadcast(states)
    schema = "tag string, file_name string, file string, block long, begins boolean, ends boolean, xml string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = {t: re.compile(rf"{CUT.get(t, '')}<{t}(?:[\s/]{TAG})?+>|</{t}\s*>") for t in tags}
        types = dict(zip(schema.split()[::2], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()), strict=True))
        at, stem, parts, out = None, None, {}, []

        def opened(tag: str, file: str, block: int) -> bool:
            blocks, after = shared.value.get((file, tag), ((), ()))
            i = bisect_left(blocks, block)
            return i > 0 and after[i - 1]

        def finish() -> None:
            for tag, (begun, part) in parts.items():
                if part is not None:
                    out.append((tag, stem, *at, begun, False, "".join(part)))

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))
            out.clear()
            return batch

        for batch in batches:
            stems, files, blocks, values = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(values):
                j, file, block, first = i + 1, files[i], blocks[i], (files[i], blocks[i]) != at
                while j < len(values) and blocks[j] == block and files[j] == file:
                    j += 1
                if first:
                    finish()
                    at, stem = (file, block), stems[i]
                    parts = {t: (False, [] if opened(t, file, block) else None) for t in tags}
                text = "</".join(values[i:j]) if first and not block else "</" + "</".join(values[i:j])
                i = j
                for tag in tags:
                    (begun, part), start = parts[tag], 0
                    for m in events[tag].finditer(text) if tag in text else ():
                        if m[0].startswith("</"):
                            if part is not None:
                                part.append(text[start : m.start()])
                                out.append((tag, stem, *at, begun, True, "".join(part)))
                                part = None
                        elif not m[0].endswith("/>"):
                            begun, part, start = True, [], m.start()
                    if part is not None:
                        part.append(text[start:])
                    parts[tag] = begun, part
            if out:
                yield made()
        finish()
        yield made()

    found = pieces.select("file_name", "file", "block", "value").mapInArrow(run, schema)
    if not states:
        return found.where("ends").select("tag", "file_name", "xml")
    found = kept(found)
    whole = F.col("begins") & F.col("ends")
    number = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("tag", "file").orderBy("block", "begins").rowsBetween(Window.unboundedPreceding, 0))
    parts = found.where(~whole).withColumn("number", number).where("number > 0").groupBy("tag", "file_name", "file", "number")
    joined = parts.agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("block", "begins", "xml"))).alias("parts")).where("ends")
    return found.where(whole).select("tag", "file_name", "xml").unionByName(joined.select("tag", "file_name", F.array_join(F.col("parts.xml"), "").alias("xml")))


def indexed(spark: SparkSession, path: str, names: Iterable[str], encoding: str = "UTF-8") -> Indexed:
    """The path with an index of its files by the given names of elements, from one pass over them, and its raw elements, from another over the files that have any."""
    census = _census(_pieces(spark, path, encoding), {*names, *CUT})
    out = Indexed(path)
    out.files = {n: [] for n in {*names, *CUT}}
    for file, name in sorted({(file, name) for file, _, name, _ in census}):
        out.files[name].append(re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(file)))
    own = sorted({f for tag in CUT for f in out.files[tag]})
    rows = _cut(_pieces(spark, own, encoding), CUT, census) if own else spark.createDataFrame([], "tag string, file_name string, xml string")
    out.elements = kept(rows)
    return out


def _elements(spark: SparkSession, path: str, tag: str, encoding: str = "UTF-8") -> DataFrame:
    """Elements of one name as raw XML from their opening tag on, without the closing one; elements of that name mustn't be nested.

    Spark's XML source gives inner XML with its character references resolved, which is no XML any more; files are cut as text instead.
    """
    if isinstance(path, Indexed):
        return path.elements.where(F.col("tag") == tag).drop("tag")
    pieces = _pieces(spark, path, encoding)
    return _cut(pieces, [tag], _census(pieces, [tag])).drop("tag")


def _attribute(tag: Column, name: str) -> Column:
    return _plain(F.nullif(F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1), F.lit("")))


def steps(spark: SparkSession, path: str) -> DataFrame:
    """Script steps; `body` is a step's XML as it stands. A step's id is that of its type."""
    scripts = _elements(spark, path, "Script").where(F.contains("xml", F.lit("<Step ")))
    head = F.regexp_extract("xml", rf"<ScriptReference\s{TAG}>", 0)
    rows = scripts.select("file_name", head.alias("_head"), F.explode(F.regexp_extract_all("xml", F.lit(r"""(?s)<Step\s(?:[^>"/]++|/(?!>)|"[^"]*+")*+/>|<Step\s.*?</Step>"""), F.lit(0))).alias("body"))
    tag, stamp = F.regexp_extract("body", rf"<Step\s{TAG}>", 0), F.regexp_extract("body", rf"<UUID\s{TAG}>", 0)
    return rows.select(
        "file_name", _attribute(F.col("_head"), "id").try_cast("long").alias("script_id"), _attribute(F.col("_head"), "name").alias("script_name"), _attribute(F.col("_head"), "UUID").alias("script_uuid"),
        _attribute(tag, "index").try_cast("long").alias("step_index"), _attribute(tag, "id").try_cast("long").alias("step_id"), _attribute(tag, "name").alias("step_name"), F.coalesce(F.lower(_attribute(tag, "enable")) != "false", F.lit(True)).alias("is_enabled"), "body",
        F.nullif(F.trim(F.regexp_extract("body", rf"<UUID(?:\s{TAG})?>([^<]*)</UUID>", 1)), F.lit("")).alias("uuid"), _attribute(stamp, "accountName").alias("account"), _attribute(stamp, "userName").alias("user_name"),
        _attribute(stamp, "modifications").try_cast("long").alias("modifications"), _attribute(stamp, "timestamp").try_cast("timestamp_ntz").alias("modified_at"),
    ).where("script_uuid is not null")


_OBJECT_REF = "struct<ref_type: string, ref_id: bigint, ref_name: string, ref_uuid: string, to_uuid: string, step_id: bigint, action: string>"
_BOX = (
    "file_name string, layout_id long, layout_name string, layout_uuid string, part string, object_id long, parent_id long, parent_uuid string, type string, name string, hash string, uuid string, "
    f"nesting long, z_order long, left double, top double, right double, bottom double, text string, refs array<{_OBJECT_REF}>"
)


def layout_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of layouts, nested to any depth, which no schema can state: each layout's parts are walked by themselves.

    nesting is 0 for objects that stand in a part; z_order counts a layout's objects in document order from 1; text is an object's own
    text, and refs what it refers to itself, without the objects in it (kinds as in `_object_refs`).
    """
    layouts = _elements(spark, path, "Layout").where(F.contains("xml", F.lit("<PartsList"))).select("file_name", F.regexp_replace("xml", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("xml"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = re.findall(r"(\w+) (?:string|long|double|array)", _BOX)
        for layouts in batches:
            out = []
            for row in layouts.itertuples(index=False):
                layout = ET.fromstring(f"{row.xml}</Layout>")
                head = (row.file_name, _number(layout.get("id")), layout.get("name"), (layout.findtext("UUID") or "").strip() or None)
                order = 0
                waiting = [(o, p.get("type"), None, None, 0) for p in layout.findall("PartsList/Part") for o in p.findall("ObjectList/LayoutObject")][::-1]
                while waiting:
                    o, part, parent, parent_uuid, depth = waiting.pop()
                    order += 1
                    number, uuid = _number(o.get("id")), (o.findtext("UUID") or "").strip() or None
                    box = o.find("Bounds")
                    sides = [float(box.get(s)) if box is not None and box.get(s) else None for s in ("left", "top", "right", "bottom")]
                    text = "".join(e.text or "" for e, _ in _own(o) if e.tag == "Data") or None
                    out.append((*head, part, number, parent, parent_uuid, o.get("type"), o.get("name"), o.get("hash"), uuid, depth, order, *sides, text, _object_refs(o)))
                    waiting += [(x, part, number, uuid, depth + 1) for x in _children(o)][::-1]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({c: "Int64" for c in ("layout_id", "object_id", "parent_id", "nesting", "z_order")})

    return layouts.mapInPandas(walk, _BOX)


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _own(o: ET.Element) -> Iterator[tuple[ET.Element, bool]]:
    """The elements below a layout object that belong to no object in it, in document order, and whether they lie among its triggers."""
    waiting = [(e, False) for e in list(o)[::-1]]
    while waiting:
        e, trigger = waiting.pop()
        if e.tag == "LayoutObject":
            continue
        trigger = trigger or e.tag == "ScriptTriggers"
        yield e, trigger
        waiting += [(x, trigger) for x in list(e)[::-1]]


def _object_refs(o: ET.Element) -> list[dict]:
    """References of a layout object: field, merge_field, value_list, portal, sort_list, trigger (with its action and number), script (besides triggers),
    and of a button's step layout_step, occurrence_step, field_step (with the step's type); calculation has the hash as name."""
    out: list[dict] = []

    def add(kind: str, e: ET.Element | None, step: int | None = None, action: str | None = None) -> None:
        if e is not None and (e.get("UUID") or e.get("name")):
            to = e.find("TableOccurrenceReference")
            out.append({"ref_type": kind, "ref_id": _number(e.get("id")), "ref_name": e.get("name"), "ref_uuid": e.get("UUID") or None, "to_uuid": to.get("UUID") if to is not None else None, "step_id": step, "action": action})

    add("field", o.find("Field/FieldReference"))
    for e in o.findall("FieldList/FieldReference"):
        add("merge_field", e)
    add("value_list", o.find("Field/Display/ValueListReference"))
    if o.get("type") == "Portal":
        add("portal", o.find("Portal/TableOccurrenceReference"))
        for e in o.findall("Portal/SortSpecification/SortList/Sort/ValueListReference"):
            add("sort_list", e)
    for step in o.findall("GroupedButton/action/Step") + o.findall("Button/action/Step"):
        kind = _number(step.get("id"))
        for e in step.findall("ParameterValues/Parameter/SortSpecification/SortList/Sort/ValueListReference"):
            add("sort_list", e, kind)
        add("layout_step", next(step.iter("LayoutReference"), None), kind)
        if kind == 74:  # goes to related records
            add("occurrence_step", next(step.iter("TableOccurrenceReference"), None), kind)
        for values in step.findall("ParameterValues"):
            for e in values.iter("FieldReference"):
                add("field_step", e, kind)
    for t in o.findall("ScriptTriggers/ScriptTrigger"):
        script = t.find("ScriptReference")
        name, uuid = (script.get("name"), script.get("UUID") or None) if script is not None else (None, None)
        out.append({"ref_type": "trigger", "ref_id": _number(t.get("id")), "ref_name": name, "ref_uuid": uuid, "to_uuid": None, "step_id": None, "action": t.get("action")})
    for e, trigger in _own(o):
        if e.tag == "ScriptReference" and not trigger:
            add("script", e)
        elif e.tag == "DDRREF" and e.get("hash") and e.get("kind") != "StepText":
            out.append({"ref_type": "calculation", "ref_id": None, "ref_name": e.get("hash"), "ref_uuid": None, "to_uuid": None, "step_id": None, "action": None})
    return out


def _children(element: ET.Element) -> list[ET.Element]:
    """The nearest layout objects below an element, whatever stands between."""
    out, waiting = [], list(element)[::-1]
    while waiting:
        e = waiting.pop()
        if e.tag == "LayoutObject":
            out.append(e)
        else:
            waiting += list(e)[::-1]
    return out


def _plain(text: Column) -> Column:
    """Character references of XML as characters; the ampersand comes last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#13", "\r"), ("#10", "\n"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of calculations: calc_uuid (with its slot), calc_hash, chunk_index from 1, chunk_type, chunk_content.

    Elements are named after their calculation, so token lists are cut out of the files with the tag that stands before them, which names it.
    Content is text, or the inner XML of a reference.
    """
    pieces = _elements(spark, path, "ChunkList").where(F.col("xml").startswith("<_"))
    found = pieces.select("file_name", F.regexp_extract("xml", r"^<_[^\s>]+[^>]*>", 0).alias("head"), F.regexp_extract("xml", r"(?s)^<_[^>]*>\s*<ChunkList[^>]*>(.*)$", 1).alias("list"))
    every = found.select("file_name", F.regexp_extract("head", r"<(_[^\s>]+)", 1).alias("calc_uuid"), F.nullif(F.regexp_extract("head", r'\shash="([^"]*)"', 1), F.lit("")).alias("calc_hash"), F.posexplode(F.expr(r"regexp_extract_all(list, '(?s)<Chunk(?:\\s[^>]*)?(?:/>|>.*?</Chunk>)', 0)")).alias("at", "chunk"))
    inner = F.regexp_extract("chunk", r"(?s)^<Chunk[^>]*>(.*)</Chunk>$", 1)
    return every.select("file_name", "calc_uuid", "calc_hash", (F.col("at") + 1).cast("long").alias("chunk_index"), F.nullif(F.regexp_extract("chunk", r'^<Chunk\s[^>]*type="([^"]*)"', 1), F.lit("")).alias("chunk_type"), F.when(inner.startswith("<"), inner).otherwise(_plain(inner)).alias("chunk_content"))
