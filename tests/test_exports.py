"""XML exports and the operators over their relations, on a small export written by hand."""

from hashlib import md5

import pytest
from metaloom.operators import resolution as R
from metaloom.sources import exports as X
from pyspark.sql import functions as F

STAMP = 'accountName="a" modifications="3" timestamp="2024-05-01T10:00:00" userName="u"'
EXPORT = f"""<?xml version="1.0" encoding="UTF-8"?>
<Export version="2.3"><AddAction>
<ExternalDataSourceCatalog><ExternalDataSource id="1" name="Other" type="File"><File><UniversalPathList>file:Other</UniversalPathList></File><UUID {STAMP}>D1</UUID></ExternalDataSource></ExternalDataSourceCatalog>
<BaseTableCatalog><BaseTable id="1" name="T"><UUID {STAMP}>B1</UUID></BaseTable><BaseTable id="2" name="T2"><UUID {STAMP}>B1</UUID></BaseTable></BaseTableCatalog>
<TableOccurrenceCatalog><TableOccurrence id="5" name="TO"><UUID {STAMP}>O1</UUID><BaseTableSourceReference><DataSourceReference id="1" name="Other" UUID="D1"/><BaseTableReference id="1" name="T" UUID="B1"/></BaseTableSourceReference><CoordRect top="1" left="2" bottom="3" right="4"/></TableOccurrence></TableOccurrenceCatalog>
<RelationshipCatalog><Relationship id="9"><UUID {STAMP}>R1</UUID><LeftTable cascadeCreate="True"><TableOccurrenceReference id="5" name="TO" UUID="O1"/></LeftTable><RightTable><TableOccurrenceReference id="6" name="TO2" UUID="O2"/></RightTable>
<JoinPredicateList><JoinPredicate type="Equal"><LeftField><FieldReference id="1" name="x" UUID="F1"/></LeftField><RightField><FieldReference id="2" name="y" UUID="F9"/></RightField></JoinPredicate><JoinPredicate type="Less"><LeftField><FieldReference id="1" name="x" UUID="F1"/></LeftField><RightField><FieldReference id="1" name="x" UUID="F1"/></RightField></JoinPredicate></JoinPredicateList></Relationship></RelationshipCatalog>
<FieldsForTables><FieldCatalog><BaseTableReference id="1" name="T" UUID="B1"/><ObjectList><Field id="1" name="x" fieldtype="Normal" datatype="Text" comment="a &amp; b"><Storage global="True" maxRepetitions="2"/><UUID {STAMP}>F1</UUID></Field><Field id="2" name="ü" fieldtype="Calculated" datatype="Number"><UUID {STAMP}>F2</UUID></Field></ObjectList></FieldCatalog></FieldsForTables>
<StepsForScripts><Script><ScriptReference id="3" name="Run" UUID="S1"/><ObjectList><Step index="0" id="1" name="Perform Script" enable="True"><UUID {STAMP}>P1</UUID><ParameterValues><Parameter type="List"><ScriptReference id="4" name="Go" UUID="S2"/></Parameter></ParameterValues></Step><Step index="1" id="777" name="?" enable="False"><UUID {STAMP}>P2</UUID></Step></ObjectList></Script></StepsForScripts>
<LayoutCatalog><Layout id="7" name="L"><UUID {STAMP}>L1</UUID><PartsList><Part type="Body"><ObjectList><LayoutObject id="1" type="Group" name="g" hash="h"><UUID>Q1</UUID><Bounds top="0" left="0" bottom="9" right="9"/><GroupedButton><ObjectList><LayoutObject id="2" type="Text"><UUID>Q2</UUID></LayoutObject></ObjectList></GroupedButton></LayoutObject><LayoutObject id="3" type="Line"/></ObjectList></Part></PartsList></Layout><Layout id="8" name="Empty"><UUID {STAMP}>L2</UUID></Layout></LayoutCatalog>
</AddAction><DDR_INFO><Calculation><ObjectList>
<_AB-1_0 hash="H1" datatype="ChunkList"><ChunkList><Chunk type="FieldRef"><FieldReference id="1" name="x" UUID="F1"/></Chunk><Chunk type="NoRef"> &lt; 1 &amp;&#13;</Chunk></ChunkList></_AB-1_0>
<_AB-1_1 hash="H1" datatype="ChunkList"><ChunkList><Chunk type="FieldRef"><FieldReference id="1" name="x" UUID="F1"/></Chunk></ChunkList></_AB-1_1>
<_CD-2_0 hash="H2" datatype="ChunkList"><ChunkList><Chunk>z</Chunk></ChunkList></_CD-2_0>
</ObjectList></Calculation></DDR_INFO></Export>"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    (folder / "Main.xml").write_text(EXPORT, encoding="utf-8")
    return str(folder)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_records(spark, path):
    assert got(X.data_sources(spark, path), "file_name", "id", "name", "path_list", "uuid", "modifications", "user_name") == [("Main", 1, "Other", "file:Other", "D1", 3, "u")]
    assert got(X.data_sources(spark, path), F.col("modified_at").cast("string")) == [("2024-05-01 10:00:00",)]
    assert got(X.occurrences(spark, path), "name", "base_table", "data_source", "left", "right") == [("TO", "T", "Other", 2, 4)]
    assert got(X.relationships(spark, path), "predicate", "operator", "left_name", "right_name", "left_field_name", "right_field_uuid", "left_cascade_create", "right_cascade_delete") == [(1, "Equal", "TO", "TO2", "x", "F9", True, False), (2, "Less", "TO", "TO2", "x", "F1", True, False)]
    assert got(X.fields(spark, path), "base_table", "id", "name", "comment", "is_global", "repetitions", "uuid") == [("T", 1, "x", "a & b", True, 2, "F1"), ("T", 2, "ü", None, None, None, "F2")]


def test_steps_and_their_references(spark, path):
    steps = X.steps(spark, path)
    assert got(steps, "script_name", "step_index", "step_id", "is_enabled", "uuid") == [("Run", 0, 1, True, "P1"), ("Run", 1, 777, False, "P2")]
    assert got(R.references(steps, "body"), "uuid", "ref_index", "ref_type", "ref_id", "ref_name", "ref_uuid") == [("P1", 1, "Script", 4, "Go", "S2")]


def test_layout_objects(spark, path):
    want = [(1, None, "Group", 0, 1, "Q1", 9.0), (2, 1, "Text", 1, 2, "Q2", None), (3, None, "Line", 0, 3, None, None)]
    assert got(X.layout_objects(spark, path).where("part = 'Body' and layout_uuid = 'L1'"), "object_id", "parent_id", "type", "nesting", "z_order", "uuid", "right") == want


def test_chunks(spark, path):
    chunks = X.chunks(spark, path)
    assert got(chunks.where("chunk_type = 'NoRef' or chunk_type is null"), "calc_uuid", "calc_hash", "chunk_index", "chunk_content") == [("_AB-1_0", "H1", 2, " < 1 &\r"), ("_CD-2_0", "H2", 1, "z")]
    assert chunks.count() == 4 and R.representatives(chunks).count() == 3
    owners = spark.createDataFrame([("Main", "F2", "calculated", "H1"), ("Main", "P1", "step", "H1")], "file_name string, owner_uuid string, owner_role string, calc_hash string")
    assert got(R.calc_references(owners, chunks), "owner_uuid", "ref_type", "ref_uuid") == [("F2", "Field", "F1"), ("P1", "Field", "F1")]


def test_heal(spark, path):
    tables = X.base_tables(spark, path)
    assert got(R.census(tables, "BaseTable"), "catalog", "uuid", "n", "n_records") == [("BaseTable", "B1", 2, 2)]
    healed = R.heal(tables, "BaseTable")
    new = healed.where("id = 2").first()
    assert new["original_uuid"] == "B1" and new["uuid"] == md5(b"DupHeal::BaseTable::Main::B1::2").hexdigest()
    users = spark.createDataFrame([("Main", "B1", 1), ("Main", "B1", 2), ("Other", "B1", 2), (None, None, None)], "file_name string, t string, t_id long")
    assert got(R.cascade(users, healed, "t", "t_id"), "file_name", "t_id", (F.col("t") == new["uuid"]).alias("new")) == [("Main", 1, False), ("Main", 2, True), ("Other", 2, False), (None, None, None)]
    same = spark.createDataFrame([("f", "u", None), ("f", "u", 4), ("f", "u", 4), ("f", None, 5), ("g", "u", 9)], "file_name string, uuid string, id long")
    assert R.heal(same, "x").where("original_uuid is not null").count() == 0
    assert R.heal(same.limit(0), "x").count() == 0


def test_variables(spark):
    uses = spark.createDataFrame([("A", "$x", "set", "s1", None), ("A", "$x", "read", "s1", None), ("A", "$x", "set", None, None), ("B", "$$g", "read", "s2", None), ("A", "$$$g", "set", None, None), ("B", "$$$g", "read", None, None), ("B", "t", "read", "s", "c")], "file_name string, name string, usage string, script_uuid string, context_uuid string")
    assert got(R.variables(uses), "name", "scope", "anchor", "set_count", "read_count", "n_files", "main_file", "normalized_name") == sorted([("$x", "local", "s1", 1, 1, 1, "A", "x"), ("$x", "local", "__file::A", 1, 0, 1, "A", "x"), ("$$g", "global", "B", 0, 1, 1, "B", "g"), ("$$$g", "superglobal", "__global", 1, 1, 2, "A", "g"), ("t", "let_local", "c", 0, 1, 1, "B", "t")], key=str)


def test_home_files(spark):
    objects = spark.createDataFrame([("1", "A", "x"), ("2", "A", "x"), ("2", "B", "y"), ("3", "A", "z"), ("3", "B", "z")], "object_uuid string, file_name string, object_name string")
    refs = spark.createDataFrame([("1", "?", None), ("2", "y", "A"), ("3", "z", "B"), ("3", "z", "C"), ("4", "w", "A"), (None, "x", "A")], "ref_uuid string, ref_name string, declared_file string")
    assert got(R.home_files(refs, objects), "ref_uuid", "declared_file", "target_file", "resolution") == sorted([("1", None, "A", "unique"), ("2", "A", "B", "by_name"), ("3", "B", "B", "declared"), ("3", "C", None, "ambiguous"), ("4", "A", None, "not_imported"), (None, "A", None, "not_imported")], key=str)


def test_checks(spark, path):
    tables = {k: getattr(X, k)(spark, path) for k in ("chunks", "relationships", "fields", "layout_objects", "occurrences", "steps")}
    bad = {r["check_name"]: (r["n_rows"], r["n_bad"]) for r in R.export_checks(tables, spark.createDataFrame([(1,)], "step_id long")).collect()}
    assert bad == {"chunk_type_null": (4, 1), "chunk_refs": (2, 0), "calc_hash": (4, 0), "calc_uuid": (4, 0), "function_missing": (4, 0), "relationship_uuid": (1, 0), "relationship_field_resolution": (4, 1), "layoutobjects_without_part": (3, 0), "layout_bounds": (3, 0), "layout_parents": (3, 0), "occurrences_without_table": (1, 0), "step_roles": (2, 1)}
