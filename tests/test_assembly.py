"""Exports as catalog and links, on a small export written by hand."""

from hashlib import md5

import pytest
from metaloom.operators import assembly as A
from metaloom.sources import catalogs as C
from metaloom.sources import exports as X

U = "<UUID>{}</UUID>".format


def ref(kind, number, name, uuid, inner=""):
    return f'<{kind}Reference id="{number}" name="{name}" UUID="{uuid}">{inner}</{kind}Reference>' if inner else f'<{kind}Reference id="{number}" name="{name}" UUID="{uuid}"/>'


def step(uuid, kind, name, values, enable="True"):
    return f'<Step index="{uuid[1:]}" id="{kind}" name="{name}" enable="{enable}">{U(uuid)}<ParameterValues>{values}</ParameterValues></Step>'


STEPS = "".join([
    step("P0", 1, "Call", ref("DataSource", 1, "Other", "D1") + ref("Script", 4, "Go &amp; stop", "S2")), step("P1", 164, "Call", ref("Script", 4, "Go", "S2")), step("P2", 76, "Set", ref("Field", 1, "x", "F1", ref("TableOccurrence", 5, "TO", "O1"))),
    step("P3", 74, "Jump", ref("TableOccurrence", 5, "TO", "O1") + ref("Layout", 7, "L", "L1")), step("P4", 39, "Sort", ref("Field", 2, "y", "F2") + ref("ValueList", 1, "V", "V1")), step("P5", 142, "Menus", ref("CustomMenuSet", 1, "M", "M1")),
    step("P6", 138, "Login", ref("DataSource", 0, "Current", "") ), step("P7", 138, "Login", ref("DataSource", 1, "Other", "D1")), step("P8", 141, "Var", '<Parameter><Name value="$$g"/></Parameter>'),
    step("P9", 999, "New", ref("Field", 1, "x", "F1") + ref("Field", 0, "", "")), step("P10", 76, "Off", ref("Field", 2, "y", "F2"), "False"), step("P11", 68, "If", '<Calculation><DDRREF kind="ChunkList" hash="H1">z</DDRREF></Calculation>'),
])
BUTTON = f'<LayoutObject id="2" type="Button" name="b">{U("Q2")}<Button><action><Step id="76">{ref("Script", 4, "Go", "S2")}<ParameterValues>{ref("Field", 2, "y", "F2")}</ParameterValues></Step></action></Button><Label><Data>see &lt;&lt;TO::X[2]&gt;&gt; &lt;&lt;y&gt;&gt; &lt;&lt;$v&gt;&gt; &lt;&lt;none&gt;&gt;</Data></Label><ScriptTriggers><ScriptTrigger id="8" action="OnEnter">{ref("Script", 3, "Run", "S1")}</ScriptTrigger></ScriptTriggers></LayoutObject>'
PORTAL = f'<LayoutObject id="1" type="Portal" kind="1">{U("Q1")}<Bounds top="1" left="2" bottom="3" right="4"/><Portal>{ref("TableOccurrence", 5, "TO", "O1")}<SortSpecification><SortList><Sort>{ref("ValueList", 1, "V", "V1")}</Sort></SortList></SortSpecification><ObjectList>{BUTTON}</ObjectList></Portal></LayoutObject>'
EDIT = f'<LayoutObject id="3" type="Edit Box" name="e">{U("Q3")}<Field>{ref("Field", 1, "x", "F1")}<Display>{ref("ValueList", 1, "V", "V1")}</Display></Field></LayoutObject>'
EXPORT = f"""<?xml version="1.0" encoding="UTF-8"?>
<Export version="2.3"><AddAction>
<BaseTable id="1" name="T">{U("B1")}</BaseTable>
<TableOccurrence id="5" name="TO">{U("O1")}<BaseTableSourceReference>{ref("BaseTable", 1, "T", "B1")}</BaseTableSourceReference></TableOccurrence>
<Relationship id="9">{U("")}<LeftTable>{ref("TableOccurrence", 5, "TO", "O1")}<SortSpecification value="True"><SortList><Sort><PrimaryField>{ref("Field", 2, "y", "F2")}</PrimaryField>{ref("ValueList", 1, "V", "V1")}</Sort></SortList></SortSpecification></LeftTable><RightTable>{ref("TableOccurrence", 6, "TO2", "O2")}<SortSpecification value="False"><SortList><Sort><PrimaryField>{ref("Field", 2, "y", "F2")}</PrimaryField></Sort></SortList></SortSpecification></RightTable><JoinPredicateList><JoinPredicate type="Equal"><LeftField>{ref("Field", 1, "x", "F1")}</LeftField><RightField>{ref("Field", 2, "y", "F2")}</RightField></JoinPredicate></JoinPredicateList></Relationship>
<FieldCatalog>{ref("BaseTable", 1, "T", "B1")}<ObjectList><Field id="1" name="x">{U("F1")}<Calculation><DDRREF hash="H1">z</DDRREF></Calculation></Field><Field id="2" name="y">{U("F2")}<AutoEnter type="Looked_up"><Looked_up>{ref("Field", 1, "x", "F1", ref("TableOccurrence", 5, "TO", "O1"))}</Looked_up></AutoEnter><Validation>{ref("ValueList", 1, "V", "V1")}<Calculated><Calculation><DDRREF hash="H1">z</DDRREF></Calculation></Calculated></Validation></Field><Field id="3" name="z">{U("F3")}<AutoEnter type="Looked_up"><Looked_up enable="False">{ref("Field", 1, "x", "F1")}</Looked_up></AutoEnter></Field></ObjectList></FieldCatalog>
<CustomFunction id="1" name="cf">{U("C1")}</CustomFunction>
<ScriptCatalog><Script id="3" name="Run">{U("S1")}</Script><Script id="4" name="Go">{U("S2")}</Script><Script id="5" name="Old" isFolder="True">{U("S3")}</Script><Script id="6" name="-" isSeparatorItem="True">{U("S4")}</Script></ScriptCatalog>
<Script>{ref("Script", 3, "Run", "S1")}<ObjectList>{STEPS}</ObjectList></Script>
<Layout id="7" name="L">{U("L1")}{ref("TableOccurrence", 5, "TO", "O1")}<PartsList><Part type="Body" kind="4"><Definition absolute="0" size="9"/><ObjectList>{PORTAL}{EDIT}</ObjectList></Part></PartsList></Layout>
<CustomMenuSet id="1" name="M">{U("M1")}<ObjectList>{ref("CustomMenu", 1, "m", "")}</ObjectList></CustomMenuSet><CustomMenu id="1" name="m">{U("N1")}<ObjectList><CustomMenuItem>{U("I1")}{ref("Script", 4, "Go", "S2")}</CustomMenuItem></ObjectList></CustomMenu>
<PrivilegeSet id="1" name="full">{U("R1")}</PrivilegeSet><Account id="1">{U("A1")}<Authentication><AccountName>Admin</AccountName></Authentication>{ref("PrivilegeSet", 1, "full", "")}</Account>
</AddAction><Metadata><AddAction><Login><AccountName>Admin</AccountName></Login></AddAction></Metadata><DDR_INFO><ObjectList>
<_F1_0 hash="H1"><ChunkList><Chunk type="FieldRef">{ref("Field", 2, "y", "F2")}</Chunk><Chunk type="CustomFunctionRef">cf</Chunk><Chunk type="FunctionRef">Abs</Chunk><Chunk type="VariableReference">$$g</Chunk><Chunk type="NoRef"> + </Chunk></ChunkList></_F1_0>
<_F2_2 hash="H1"><ChunkList><Chunk type="FieldRef">{ref("Field", 2, "y", "F2")}</Chunk></ChunkList></_F2_2>
</ObjectList></DDR_INFO></Export>"""
G = md5(b"global::Main::$$g").hexdigest()


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("assembly")
    (folder / "Main.xml").write_text(EXPORT, encoding="utf-8")
    return str(folder)


def test_step_references(spark, path):
    got = {(r["uuid"], r["ref_type"], r["ref_name"], r["ref_uuid"]) for r in A.step_references(X.steps(spark, path)).collect()}
    assert got == {("P0", "Script", "Go & stop", "S2"), ("P1", "Script", "Go", "S2"), ("P2", "Field", "x", "F1"), ("P3", "TableOccurrence", "TO", "O1"), ("P3", "Layout", "L", "L1"), ("P4", "Field", "y", "F2"), ("P4", "ValueList", "V", "V1"), ("P5", "CustomMenuSet", "M", "M1"), ("P7", "DataSource", "Other", "D1"), ("P8", "Variable", "$$g", None), ("P9", "Field", "x", "F1"), ("P10", "Field", "y", "F2")}
    empty = X.steps(spark, path).limit(0)
    assert A.step_references(empty).count() == 0


LINKS = """
Relationship rel_9_Main TableOccurrence O1 left_table -
Relationship rel_9_Main TableOccurrence O2 right_table -
Relationship rel_9_Main Field F1 left_field -
Relationship rel_9_Main Field F2 right_field -
Relationship rel_9_Main Field F2 sort_field left
Relationship rel_9_Main ValueList V1 sorts_by_valuelist left
Field F1 BaseTable B1 parent_table -
Field F2 BaseTable B1 parent_table -
Field F3 BaseTable B1 parent_table -
Field F2 Field F1 lookup_source -
Field F2 TableOccurrence O1 lookup_relationship -
Field F2 ValueList V1 uses_valuelist validation
TableOccurrence O1 BaseTable B1 base_table -
Layout L1 TableOccurrence O1 context_table -
LayoutObject Q1 Layout L1 parent_layout -
LayoutObject Q2 Layout L1 parent_layout -
LayoutObject Q3 Layout L1 parent_layout -
LayoutObject Q2 LayoutObject Q1 parent_object -
LayoutObject Q3 Field F1 displays_field -
Layout L1 Field F1 displays_field aggregated
LayoutObject Q2 Field F1 displays_field label_text
LayoutObject Q2 Field F2 displays_field label_text
LayoutObject Q3 ValueList V1 uses_valuelist -
LayoutObject Q1 ValueList V1 sorts_by_valuelist -
LayoutObject Q1 TableOccurrence O1 portal_context -
LayoutObject Q2 Script S2 triggers_script button
LayoutObject Q2 Field F2 sets_field button
ScriptTrigger trig_8_Q2_Main Script S1 trigger_script -
ScriptTrigger trig_8_Q2_Main LayoutObject Q2 trigger_owner -
LayoutObject Q2 Script S1 triggers_script OnEnter
Script S1 Script S2 calls_script -
Script S1 Script S2 calls_script on_server
Script S1 Field F1 sets_field -
Script S1 TableOccurrence O1 navigates_to_to -
Script S1 Layout L1 navigates_to_layout -
Script S1 Field F2 sorts_by_field -
Script S1 ValueList V1 sorts_by_valuelist -
Script S1 CustomMenuSet M1 installs_menuset -
Script S1 ExternalDataSource D1 data_source -
Script S1 Field F1 references_field -
CustomMenuSet M1 CustomMenu N1 contains_menu -
CustomMenuItem I1 CustomMenu N1 parent_menu -
CustomMenuItem I1 Script S2 triggers_script menu
Account A1 PrivilegeSet R1 privilege_set -
File Main Account A1 auto_login_account -
Field F1 Field F2 reads_field field_calculation
Field F1 CustomFunction C1 calls_customfunction field_calculation
Field F1 BuiltinFunction Abs calls_function field_calculation
Field F2 Field F2 validates_by_calc validation
Field F2 CustomFunction C1 validates_by_calc validation
Field F2 BuiltinFunction Abs calls_function validation
Script S1 Field F2 reads_field step_parameter
Script S1 CustomFunction C1 calls_customfunction step_parameter
Script S1 BuiltinFunction Abs calls_function step_parameter
Script S1 Variable G sets_variable -
Script S1 Variable G reads_variable -
Field F1 Variable G reads_variable -
Field F2 Variable G reads_variable -
"""


def test_links(spark, path):
    got = {(r["source_type"], r["source_uuid"], r["target_type"], r["target_uuid"].replace(G, "G"), r["link_role"], r["link_subrole"] or "-") for r in A.export_links(spark, path).collect() if r["link_role"] not in ("has_calculation", "parent_script")}
    assert got == {tuple(line.split()) for line in LINKS.strip().splitlines()}


def test_catalog(spark, path):
    rows = A.object_catalog(spark, path).collect()
    got = {(r["object_type"], r["object_uuid"], r["object_name"]) for r in rows if r["object_type"] not in ("ScriptStep", "ScriptStepType", "Calculation")}
    assert got == {
        ("BaseTable", "B1", "T"), ("TableOccurrence", "O1", "TO"), ("Relationship", "rel_9_Main", "TO → TO2"), ("Field", "F1", "T::x"), ("Field", "F2", "T::y"), ("Field", "F3", "T::z"), ("CustomFunction", "C1", "cf"),
        ("Script", "S1", "Run"), ("Script", "S2", "Go"), ("Folder", "S3", "Old"), ("Layout", "L1", "L"), ("LayoutPart", "part_7_4_1_Main", "L [Body]"), ("LayoutObject", "Q1", "Portal @ (1,2)"), ("LayoutObject", "Q2", "b"), ("LayoutObject", "Q3", "e"),
        ("Account", "A1", "Admin"), ("PrivilegeSet", "R1", "full"), ("ScriptTrigger", "trig_8_Q2_Main", "OnEnter → Run"), ("CustomMenu", "N1", "m"), ("CustomMenuSet", "M1", "M"), ("CustomMenuItem", "I1", "m › (berechnet)"),
        ("Variable", G, "$$g"), ("File", "Main", "Main"), ("BuiltinFunction", "Abs", "Abs"),
    }
    steps = {r["object_name"] for r in rows if r["object_type"] == "ScriptStep"}
    assert len(steps) == 12 and "Run [2] Set" in steps and sum(r["object_type"] == "Calculation" for r in rows) == 3


def test_raw_elements_need_no_long_pieces_and_go_over_blocks(spark, tmp_path):
    """Files without an element, or with much before it, are no single piece (the reader drops those over a limit here), and elements may go over the ends of a file's blocks."""
    gap = "<a><b>x</b></a>" * 300
    (tmp_path / "Far [1] %20.xml").write_text(EXPORT.replace("<Script>", gap + "<Script>").replace("<DDR_INFO>", gap + "<DDR_INFO>"), encoding="utf-8")
    (tmp_path / "None.xml").write_text(f'<Export><AddAction>{gap}<Script id="1" name="n"/></AddAction></Export>', encoding="utf-8")
    folder, hadoop = str(tmp_path), spark.sparkContext._jsc.hadoopConfiguration()
    read = lambda p: [sorted(map(str, f(spark, p).collect())) for f in (X.steps, X.layout_objects, X.chunks, lambda s, q: C.scan(s, q, "scripts"), lambda s, q: C.scan(s, q, "layout_triggers"))]
    want = read(folder)
    assert [len(x) for x in want] == [12, 3, 6, 5, 0]
    hadoop.set("mapreduce.input.linerecordreader.line.maxlength", "4000")
    try:
        assert read(folder)[:3] == want[:3]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert read(C.indexed(spark, folder)) == want
        roots = {r["file_name"]: r["root"] for r in C.root_attributes(spark, folder).collect()}
        assert roots == {"Far [1] %20": "Export", "None": "Export"}
    finally:
        hadoop.unset("mapreduce.input.linerecordreader.line.maxlength")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
