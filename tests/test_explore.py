"""Cases by hand for the graph explorer and the findings: cycles, exclusions, ties, nulls, empty tables."""

from metaloom.operators import explore, findings

LINK = "source_type string, source_uuid string, target_type string, target_uuid string, link_role string, link_subrole string, link_kind string"


def graph(spark, *rows):
    return explore.graph_of(spark.createDataFrame([(*a.split("::"), *b.split("::"), role, sub, kind) for a, b, role, sub, kind in rows], LINK))


def trade(spark):
    call = lambda a, b: (f"Script::{a}", f"Script::{b}", "calls_script", None, "usage")
    return graph(
        spark, call("A", "B"), call("B", "C"), call("C", "A"), call("Z", "A"), call("A", "X"), call("X", "Y"), call("T", "U"),
        ("Script::B", "Layout::L", "navigates_to_layout", None, "usage"), ("Layout::L", "Script::T", "triggers_script", "OnEnter", "usage"), ("Layout::L", "Script::K", "triggers_script", "OnObjectModify", "usage"),
        ("Script::B", "Field::F", "sets_field", None, "usage"), ("Script::X", "Field::G", "sets_field", None, "usage"), ("Script::U", "Field::H", "sets_field", None, "usage"),
        ("LayoutObject::O", "Layout::L", "parent_layout", None, "containment"), ("LayoutObject::O", "Field::F", "displays_field", None, "usage"), ("LayoutObject::O", "Script::V", "triggers_script", "OnSave", "usage"),
        ("LayoutObject::P", "Layout::L", "parent_layout", None, "containment"), ("LayoutObject::P", "Field::G", "displays_field", None, "usage"), ("LayoutObject::P", "Script::W", "triggers_script", "OnSave", "usage"),
    )


def test_trace_by_hand(spark):
    # C calls A and is called by B: the caller's step is the shorter one.
    got = {r["node"].split("::")[1]: (r["trace_role"], r["trace_depth"]) for r in explore.trace(trade(spark), "Script::A", 1, 3, 1, ["Script::X", "Script::A"]).collect()}
    assert got == {
        "A": ("start", 0), "B": ("chain", 1), "X": ("chain", 1), "Z": ("chain", -1), "C": ("chain", -1),
        "L": ("touched", 1), "F": ("touched", 1), "T": ("triggered", 1), "U": ("triggered", 1), "V": ("triggered", 1), "H": ("trigger_touched", 1),
    }
    free = {r["node"] for r in explore.trace(trade(spark), "Script::A", 1, 3, 1, interaction=True).collect()}
    assert {"Script::Y", "Field::G", "Script::W", "Script::K"} <= free


def test_subgraph_limit_and_focus(spark):
    nodes, inside = explore.subgraph(trade(spark), "Script::A", 1, "out", types=["Field"])
    assert [(r["node"], r["is_focus"], r["total_reachable"]) for r in nodes.collect()] == [("Script::A", True, 1)] and inside.count() == 0
    nodes, inside = explore.subgraph(trade(spark), "Script::A", 2, "out", limit=3)
    assert [r["node"] for r in nodes.orderBy("depth", "node").collect()] == ["Script::A", "Script::B", "Script::X"] and nodes.first()["total_reachable"] > 3
    assert {(r["a"], r["b"]) for r in inside.collect()} == {("Script::A", "Script::B"), ("Script::A", "Script::X")}
    assert explore.subgraph(trade(spark).where("false"), "Script::A")[0].count() == 1


def test_paths_on_a_cycle(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 3)], "a long, b long")
    got = {r["node"]: (r["anchor"], r["depth"], r["path"]) for r in explore.nearest_paths(pairs, spark.createDataFrame([(1,), (9,), (1,)], "node long")).collect()}
    assert got == {1: (1, 0, [1]), 9: (9, 0, [9]), 2: (1, 1, [2, 1]), 3: (9, 1, [3, 9])}


def test_activity_without_stamps(spark):
    stamps = spark.createDataFrame([], "object long, type string, modified date, saves int, individual boolean, known boolean")
    got = explore.activity(stamps, spark.createDataFrame([(1, 5), (2, None)], "grp long, object long")).orderBy("grp").collect()
    assert [(r["members"], r["activity_class"], r["stamped"], r["saves_level"], r["newest_change"]) for r in got] == [(1, 7, 0, None, None)] * 2


def test_families_in_order():
    rules = [explore.Family("It's", ilike=("%x%",)), explore.Family("Nothing"), explore.Family("R", regex="y+", in_comment=False)]
    assert explore.family_sql(rules) == "CASE WHEN (url ILIKE '%x%') THEN 'It''s'  WHEN regexp(url, 'y+') AND NOT in_comment THEN 'R' WHEN source_type = 'Script (Import)' THEN 'Local Import' ELSE 'Other' END"


def test_flow_by_hand(spark):
    text = "If,Else,End If,Loop,Loop,Exit Loop If,End Loop,Show Custom Dialog,End Loop,Exit Script,Set Variable".split(",")
    steps = spark.createDataFrame([("S", i, s, True) for i, s in enumerate(text)] + [("S", 2, "If", False), ("E", 1, None, True)], "script string, place int, step string, is_enabled boolean")
    got = {(r["rule"], r["script"], r["first_place"]) for r in findings.flow(steps).collect()}
    assert got == {("empty_if_branch", "S", 0), ("empty_else_branch", "S", 1), ("show_dialog_in_loop", "S", 7), ("dead_code_after_exit", "S", 9)}
    assert [(r["script"], r["loop_at"]) for r in findings.endless_loops(steps).collect()] == [("S", 3)]
    assert findings.unbalanced(steps).count() == 0 and findings.flow(steps.where("false")).count() == 0


def test_variable_scopes(spark):
    rows = [("Script", "A", "set", "$$g", "f"), ("Script", "B", "read", "$$g", "f"), ("Script", "A", "set", "$l", "f"), ("Script", "B", "merge", "$l", "f")]
    got = {(r["scope"], r["rule"]) for r in findings.variables(spark.createDataFrame(rows, "owner_type string, owner string, usage string, variable string, file_name string")).collect()}
    assert got == {("Script::A", "variable_set_never_read"), ("Script::B", "variable_read_never_set")}
