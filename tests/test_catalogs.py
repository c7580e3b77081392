"""The scans of XML exports' catalogs on a small export written by hand, in UTF-8 and UTF-16."""

import pytest
from metaloom.sources import catalogs as C
from pyspark.sql import functions as F

S = 'accountName="a" modifications="3" timestamp="2024-05-01T10:00:00" userName="u"'
EXPORT = f"""<?xml version="1.0"?>
<Export version="2.3" source="19"><AddAction>
<ScriptTriggers><ScriptTrigger id="1" action="OnOpen" browseMode="True"><ScriptReference id="1" name="Go" UUID="S1"/></ScriptTrigger></ScriptTriggers>
<BaseDirectoryCatalog><BaseDirectory id="1" name="d" relativeTo="x"><UUID {S}>BD1</UUID></BaseDirectory></BaseDirectoryCatalog>
<ValueListCatalog><ValueList id="1" name="V"><UUID {S}>V1</UUID><Source value="Custom"/></ValueList><ValueList id="2" name="W"><UUID {S}>V1</UUID><Source value="Field"/></ValueList></ValueListCatalog>
<OptionsForValueLists><ValueList><ValueListReference id="1" name="V" UUID="V1"/><Source value="Custom"/><CustomValues><Text>a</Text><Text>b</Text></CustomValues></ValueList><ValueList><ValueListReference id="2" name="W" UUID="V1"/><Source value="Field"/><Field><PrimaryField show="True"><FieldReference id="5" name="f" UUID="F5"><TableOccurrenceReference id="3" name="T" UUID="T3"/></FieldReference></PrimaryField></Field></ValueList></OptionsForValueLists>
<CustomFunctionsCatalog><CustomFunction id="1" name="cf"><UUID {S}>C1</UUID><Display>cf ( a ; b )</Display><ObjectList><Parameter name="a"/><Parameter name="b"/></ObjectList><Calculation><DDRREF kind="k" hash="H"/></Calculation></CustomFunction></CustomFunctionsCatalog>
<CalcsForCustomFunctions><CustomFunctionCalc><CustomFunctionReference id="1" name="cf" UUID="C1"/><Calculation><Text>a + b</Text><DDRREF kind="k" hash="H"/></Calculation></CustomFunctionCalc></CalcsForCustomFunctions>
<ScriptCatalog><Script id="1" name="Go"><UUID {S}>S1</UUID><Options hidden="True">4</Options></Script><Script id="2" name="Folder" isFolder="True"><UUID {S}>S2</UUID></Script></ScriptCatalog>
<LayoutCatalog><Layout id="7" name="L" width="90"><UUID {S}>L7</UUID><TableOccurrenceReference name="T" UUID="T3"/><LayoutThemeReference id="2" name="t" UUID="TH"/><MenuSet><CustomMenuSetReference id="0" name="d" UUID=""/></MenuSet><Options hidden="True">12</Options><ScriptTriggers><ScriptTrigger id="2" action="OnExit"><ScriptReference id="1" name="Go" UUID="S1"/></ScriptTrigger></ScriptTriggers><TableView><ObjectList><TableViewLayoutObject id="1" name="c" width="3"><FieldReference id="5" name="f" UUID="F5"/></TableViewLayoutObject><TableViewLayoutObject hidden="True" id="2" name="d"><FieldReference id="6" name="g" UUID="F6"/></TableViewLayoutObject></ObjectList></TableView><PartsList><Part type="Header" kind="1"><Definition absolute="0" size="30"/></Part><Part type="Body" kind="4"><Definition absolute="30" size="60"/></Part></PartsList></Layout></LayoutCatalog>
<AccountsCatalog><ObjectList><Account id="1" kind="2" type="x" enable="True"><UUID {S}>A1</UUID><Authentication><AccountName>Admin</AccountName></Authentication><PrivilegeSetReference id="1" name="full"/></Account></ObjectList></AccountsCatalog>
<PrivilegeSetsCatalog><ObjectList><PrivilegeSet id="1" name="full"><UUID {S}>P1</UUID><access default="True"><Records Create="True" View="All"/><Other value="1" Print="True" Export="False"/></access></PrivilegeSet><PrivilegeSet id="2" name="some"><UUID {S}>P2</UUID><access><Records><Custom><ObjectList><Table type="t"><BaseTableReference id="9" name="B" UUID="B9"/><View access="Limited"><Calculation><Text>x</Text><DDRREF hash="HV"/></Calculation></View><Edit access="None"/><Fields access="Custom"><Field access="View"><FieldReference id="5" name="f" UUID="F5"/></Field></Fields></Table></ObjectList></Custom></Records><Layouts><Custom Create="True"><ObjectList><Layout access="None"><LayoutReference id="7" name="L" UUID="L7"/></Layout></ObjectList></Custom></Layouts></access></PrivilegeSet></ObjectList></PrivilegeSetsCatalog>
<PasteIndexList><Object id="9"/><Object id="4"/></PasteIndexList>
<ExtendedPrivilegesCatalog><ObjectList><ExtendedPrivilege id="1" name="app"><UUID {S}>E1</UUID><ObjectList><PrivilegeSetReference id="1" name="full"/></ObjectList></ExtendedPrivilege><ExtendedPrivilege id="2" name="none"><UUID {S}>E2</UUID></ExtendedPrivilege></ObjectList></ExtendedPrivilegesCatalog>
<CustomMenuCatalog><CustomMenu id="1" name="M"><UUID {S}>M1</UUID><ObjectList><CustomMenuItem index="1" hash="h"><UUID>I1</UUID><Command id="3" name="New"/></CustomMenuItem><CustomMenuItem isSubMenuItem="True"><UUID>I2</UUID><CustomMenuReference id="2" name="N" UUID="M2"/></CustomMenuItem></ObjectList></CustomMenu></CustomMenuCatalog>
<CustomMenuSetCatalog><ObjectList><CustomMenuSet id="1" name="S" comment="c"><UUID {S}>MS</UUID><ObjectList><CustomMenuReference id="1" name="M"/></ObjectList></CustomMenuSet></ObjectList></CustomMenuSetCatalog>
<FileAccessCatalog required="True"><ObjectList><Authorization id="1" type="t" self="True"><Display>Me</Display><UUID {S}>AU</UUID><Source CreationAccountName="a"/></Authorization></ObjectList></FileAccessCatalog>
<LibraryCatalog><BinaryData><LibraryReference id="1" key="k">z</LibraryReference></BinaryData></LibraryCatalog>
<ThemeCatalog><Theme id="2" name="t" Display="Theme"><UUID {S}>TH</UUID></Theme></ThemeCatalog>
</AddAction><Metadata><AddAction><Encryption type="0"/><Login type="1"><AccountName>Admin</AccountName></Login><Defaults><LayoutReference id="7" name="L" UUID="L7"/></Defaults></AddAction></Metadata>
<DDR_INFO><Script><ObjectList><_AB-1 hash="h1" datatype="StepText">Go &lt;now&gt;</_AB-1><_ hash="h2" datatype="StepText">Beep</_></ObjectList></Script></DDR_INFO></Export>"""
WANT = {
    "value_lists": ("id, name, source, uuid, modifications", [(1, "V", "Custom", "V1", 3), (2, "W", "Field", "V1", 3)]),
    "value_list_options": ("list_id, source, array_join(values, '|'), primary_uuid, primary_to_name", [(1, "Custom", "a|b", None, None), (2, "Field", None, "F5", "T")]),
    "custom_functions": ("id, name, display, array_join(parameters, '|'), calc_hash, folder_type", [(1, "cf", "cf ( a ; b )", "a|b", "H", "False")]),
    "custom_function_calcs": ("function_uuid, text, calc_hash", [("C1", "a + b", "H")]),
    "scripts": ("id, name, folder_type, is_hidden, uuid", [(1, "Go", "False", True, "S1"), (2, "Folder", "True", False, "S2")]),
    "layouts": ("id, name, width, is_hidden, options, context_uuid, theme_uuid, menu_set_id", [(7, "L", 90, True, 12, "T3", "TH", None)]),
    "layout_parts": ("layout_id, part_seq, part_type, part_top, part_size", [(7, 1, "Header", 0.0, 30.0), (7, 2, "Body", 30.0, 60.0)]),
    "table_view_columns": ("layout_uuid, place, name, is_hidden, field_uuid", [("L7", 1, "c", False, "F5"), ("L7", 2, "d", True, "F6")]),
    "accounts": ("id, name, kind, is_enabled, privilege_set_name, uuid", [(1, "Admin", 2, True, "full", "A1")]),
    "privilege_sets": ("id, name, is_default, records_create, records_view, may_print, may_export", [(1, "full", True, True, "All", True, False), (2, "some", False, None, None, None, None)]),
    "record_access": ("privilege_set_uuid, table_name, operation, access, calc_hash", [("P2", "B", "Edit", "None", None), ("P2", "B", "View", "Limited", "HV")]),
    "field_access": ("privilege_set_uuid, table_uuid, field_uuid, access", [("P2", "B9", "F5", "View")]),
    "object_access": ("privilege_set_uuid, object_class, may_create, access, object_uuid", [("P2", "Layout", True, "None", "L7")]),
    "paste_index": ("object_id, list_index", [(4, 1), (9, 2)]),
    "base_directories": ("id, name, relative_to, uuid", [(1, "d", "x", "BD1")]),
    "file_triggers": ("owner_type, action, browse_mode, script_uuid", [("File", "OnOpen", True, "S1")]),
    "layout_triggers": ("owner_type, owner_uuid, action, script_uuid", [("Layout", "L7", "OnExit", "S1")]),
    "object_triggers": ("owner_type, owner_uuid, action", []),
    "extended_privileges": ("id, name, array_join(privilege_set_names, '|'), size(privilege_set_ids)", [(1, "app", "full", 1), (2, "none", "", 0)]),
    "menus": ("id, name, uuid", [(1, "M", "M1")]),
    "menu_items": ("menu_uuid, place, item_uuid, is_submenu, command, submenu_uuid", [("M1", 1, "I1", False, "New", None), ("M1", 2, "I2", True, None, "M2")]),
    "menu_sets": ("id, name, comment, array_join(menu_names, '|'), uuid", [(1, "S", "c", "M", "MS")]),
    "file_access": ("id, type, is_self, name, created_by, uuid", [(1, "t", True, "Me", "a", "AU")]),
    "libraries": ("id, key", [(1, "k")]),
    "themes": ("id, name, display, uuid", [(2, "t", "Theme", "TH")]),
    "file_options": ("encryption, login_type, login_account, default_layout_uuid, keychain", [("0", "1", "Admin", "L7", False)]),
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalogs")
    (folder / "Main.xml").write_text(EXPORT, encoding="utf-8")
    return str(folder)


def got(df, columns):
    return sorted((tuple(r) for r in df.selectExpr("file_name", *C_split(columns)).collect()), key=str)


def C_split(columns):
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@pytest.mark.parametrize("name", sorted(C.SCANS))
def test_scan(spark, path, name):
    columns, want = WANT[name]
    assert got(C.scan(spark, path, name), columns) == sorted((("Main", *w) for w in want), key=str)


def test_utf16(spark, tmp_path):
    (tmp_path / "Wide.xml").write_bytes(b"\xff\xfe" + EXPORT.encode("utf-16-le"))
    (tmp_path / "Narrow.xml").write_text(EXPORT, encoding="utf-8")
    roots = {r["file_name"]: r for r in C.root_attributes(spark, str(tmp_path)).collect()}
    assert {k: (r["encoding"], r["root"], r["attributes"]) for k, r in roots.items()} == {"Wide": ("UTF-16LE", "Export", {"version": "2.3", "source": "19"}), "Narrow": ("UTF-8", "Export", {"version": "2.3", "source": "19"})}
    assert got(C.scan(spark, f"{tmp_path}/Wide.xml", "accounts", "UTF-16"), "name, uuid") == [("Wide", "Admin", "A1")]


def test_census_details_and_stamps(spark, path):
    lists = C.scan(spark, path, "value_lists")
    assert [tuple(r) for r in C.absorptions(lists, "ValueList").collect()] == [("ValueList", "Main", "V1", 2, 2, 1)]
    assert sorted((r["key"], r["place"], r["survives"]) for r in C.absorption_details(lists, "ValueList").collect()) == [("1", 1, True), ("2", 2, False)]
    stamps = {r["catalog"]: r for r in C.change_stamps({n: C.scan(spark, path, n) for n in ("value_lists", "scripts", "libraries")}).collect()}
    assert set(stamps) == {"value_lists", "scripts"} and (stamps["scripts"]["n"], stamps["scripts"]["modifications"], stamps["scripts"]["latest_user"]) == (2, 6, "u")
    with pytest.raises(ValueError):
        C.change_stamps({"libraries": C.scan(spark, path, "libraries")})


def test_step_texts_and_cleaning(spark, path):
    assert sorted(tuple(r) for r in C.step_texts(spark, path).collect()) == [("Main", "AB-1", "h1", "Go <now>"), ("Main", "hash:h2", "h2", "Beep")]
    row = spark.createDataFrame([("a\x01b\rc\td",)], "t string").select(C.cleaned("t").alias("x"), C.cleaned(F.col("t")).alias("y")).first()
    assert row == ("ab\x7fc\td", "ab\x7fc\td")
