"""Operators on small hand-made inputs."""

from metaloom.operators.catalog import arbitrate
from metaloom.operators.edges import KINDS, links_of, Block
from metaloom.operators.graph import closure, modularity_moves, vote, walk
from metaloom.operators.sequences import bulk_events
from metaloom.operators.tree import classes
from metaloom.plans.service import page, search
from metaloom.sources import sinks
from metaloom.streaming.sessions import changed_only
from pyspark.sql import functions as F


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "a string, b string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r[0]: r[1] for r in walk(edges, seeds, 9).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert walk(edges.limit(0), seeds, 3).count() == 1


def test_page_and_search(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (4, "c")], "id long, name string")
    assert [r["id"] for r in page(df, "name", 1, 3).collect()] == [3, 1, 4]
    assert [r["id"] for r in page(df, "name", 9, 3).collect()] == [2]
    assert [r["id"] for r in search(df, " B ").collect()] == [1]
    assert search(df, "").count() == 4


def test_bulk_events_chain_over_the_end_of_a_month(spark, tmp_path):
    """Clicks until 23:59 of one month and views from 00:01 of the next are one mass event; a later one counts from 1 again."""
    at = lambda start, kind, n: [(f"{start}:{i:02}", kind) for i in range(n)]
    events = at("2024-01-31 23:59", "click", 6) + at("2024-02-01 00:01", "view", 6) + at("2024-02-09 08:00", "click", 5) + at("2024-02-09 08:01", "view", 5)
    rows = [(i, ts, 1, kind, 0.0) for i, (ts, kind) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = bulk_events(spark, str(tmp_path)).orderBy("month").collect()
    assert [(r["month"], r["chain"], r["n_types"], r["n_events"], r["kind"]) for r in got] == [("2024-01", 1, 2, 12, "mass"), ("2024-02", 1, 2, 10, "mass")]


def test_classes_of_a_relationship_tree(spark):
    """A bridge between two used nodes, a dead branch, a dead island, a node alone, one reached by a rule."""
    edges = spark.createDataFrame([("u1", "m"), ("m", "u2"), ("m", "x"), ("x", "y"), ("i1", "i2"), ("u1", "r"), ("u1", "u1"), ("m", "u1")], "a string, b string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = classes(names("u1", "u2", "m", "x", "y", "i1", "i2", "alone", "r"), edges, names("u1", "u2"), names("r"))
    assert dict(got.collect()) == {"u1": "used", "u2": "used", "m": "bridge", "x": "dead_branch", "y": "dead_branch", "i1": "dead_island", "i2": "dead_island", "alone": "unused", "r": "relationship_bridge"}
    assert classes(names("a"), edges.limit(0), names("b"), names("c")).collect() == [("a", "unused")]


def test_closure_of_a_deep_and_cyclic_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "d")], "a string, b string")
    got = {tuple(r) for r in closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", "b", 1), ("a", "d", 1), ("a", "c", 2)}


def test_modularity_moves_find_two_cliques(spark):
    left, right = [f"l{i}" for i in range(5)], [f"r{i}" for i in range(5)]
    pairs = [(a, b, 1.0) for g in (left, right) for a in g for b in g if a != b] + [("l0", "r0", 1.0), ("r0", "l0", 1.0)]
    got = dict(modularity_moves(spark.createDataFrame(pairs, "a string, b string, w double")).collect())
    assert len({got[x] for x in left}) == len({got[x] for x in right}) == 1 and got["l0"] != got["r0"]


def test_vote_thresholds(spark):
    shares = spark.createDataFrame([("a", "x", 6), ("a", "y", 4), ("b", "x", 7), ("b", "z", 3), ("c", "y", 5), ("c", "z", 5)], "cluster string, name string, n long")
    assert [r["cluster"] for r in vote(shares).collect()] == ["b"]
    assert {r["cluster"] for r in vote(shares, 0.5, 0.1).collect()} == {"b", "c"}


def test_arbitration(spark):
    rows = [("s1", "A", "A", False), ("s1", "A", "B", True), ("s2", "A", "B", True), ("s2", "A", "C", False), ("s3", "A", "B", True), ("s3", "A", "C", True), ("s4", None, None, None)]
    got = arbitrate(spark.createDataFrame(rows, "s string, own string, target string, declared boolean"), ["s"], "target", "own", "declared")
    assert sorted((r["s"], str(r["target"]), r["arbitration"]) for r in got.collect()) == [("s1", "A", "local"), ("s2", "B", "declared"), ("s3", "B", "kept"), ("s3", "C", "kept"), ("s4", "None", "kept")]


def test_links_of_a_relation(spark):
    assert len(KINDS) == 63
    rows = spark.createDataFrame([("f", "a", "b", True), ("f", "a", "b", True), ("f", "a", None, True), (None, None, "b", True), ("f", "c", "d", False)], "file_name string, uuid string, t string, is_enabled boolean")
    got = links_of(rows, [Block("x", "r", "'A'", "uuid", "'B'", "t", "'base_table'"), Block("y", "r", "'A'", "uuid", "'B'", "t", "'new_role'", where="uuid = 'a'")]).collect()
    assert sorted((r["block"], r["source_uuid"], r["target_uuid"], r["link_kind"]) for r in got) == [("x", "a", "b", "usage"), ("y", "a", "b", "unknown")]


def test_upsert_and_replaced_files(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k long, v string")
    assert sorted(map(str, (tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()))) == ["(1, 'a')", "(2, 'c')", "(3, 'd')", "(None, 'm')"]
    path = f"{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "v long, file_name string")
    sinks.replace_files(frame([(1, "a"), (2, "b")]), path)
    sinks.replace_files(frame([(3, "b")]), path)
    assert sorted(tuple(r) for r in sinks.attach(spark, {"attached": path})["attached"].collect()) == [(1, "a"), (3, "b")] and spark.table("attached").count() == 2


def test_changed_only_reads_a_file_once(spark, tmp_path):
    paths = [f"{tmp_path}/{n}" for n in ("in", "state", "out")]
    spark.createDataFrame([(1,)], "v long").coalesce(1).write.mode("append").parquet(paths[0])
    changed_only(spark, paths[0], "v long", paths[1], paths[2])
    changed_only(spark, paths[0], "v long", paths[1], paths[2])
    spark.createDataFrame([(2,)], "v long").coalesce(1).write.mode("append").parquet(paths[0])
    changed_only(spark, paths[0], "v long", paths[1], paths[2])
    assert sorted(r["v"] for r in spark.read.parquet(paths[2]).collect()) == [1, 2]
