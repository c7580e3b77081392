"""Templates, their parameters and results, formatters and folding."""

import time

import pytest
from metaloom.plans import templates as T
from pyspark.sql import functions as F


def test_front_matter_and_parameters():
    t = T.parse("-- @output: object\n-- @tags: a, b\n-- @tags: c\nSELECT 1 -- @x\n")
    assert t.kind == "object" and t.meta["tags"] == ["a", "b", "c"] and t.sql == "SELECT 1 -- @x"
    assert T.bind("SELECT ':a', \":a\", x::int /* :a */ -- :a\n, :a, :b, :a", {"a": "it's :b"}) == ("SELECT ':a', \":a\", x::int /* :a */ -- :a\n, ?, ?, ?", ["it's :b", None, "it's :b"])
    with pytest.raises(TypeError):
        T.bind(":a", {"a": [1]})


def test_output_contract(spark):
    with pytest.raises(ValueError, match="uuid, type"):
        T.run(spark, T.parse("-- @output: object\nSELECT 1 AS name"))
    assert T.run(spark, T.parse("-- @output: content\nSELECT :a AS content"), {"a": -3}).first()["content"] == -3
    assert T.run(spark, T.parse("SELECT 1 AS x")).count() == 1


def test_run_many_and_tests(spark):
    def fail():
        raise KeyError("x")

    cache = {}
    jobs = {"a": lambda: 1, "b": fail, "c": lambda: time.sleep(2)}
    assert T.run_many(jobs, seconds=0.5, cache=cache, fingerprint="f") == {"a": ("done", 1), "b": ("failed", "KeyError: 'x'"), "c": ("timeout", "took more than 0.5 s")}
    assert T.run_many({"a": fail}, cache=cache, fingerprint="f") == {"a": ("done", 1)}
    rows = spark.createDataFrame([("F",), ("F",), ("G",)], "file_name string")
    tests = [{"name": "wide", "severity": "error"}, {"name": "own", "scopes": ["file"]}, {"name": "fixed", "static": 0}, {"name": "other", "scopes": ["cluster"]}]
    assert [(r["name"], r["value"], r["state"], r["how"]) for r in T.run_tests(tests, "file", "F", lambda t: rows)] == [("wide", 2, "error", "filter"), ("own", 3, "warning", "native"), ("fixed", 0, "ok", "static")]
    assert (T.state(None, "error"), T.state(2, "info")) == ("neutral", "neutral")


def test_formatters(spark):
    df = spark.createDataFrame([("a|b", "<x>", None), ("c", "y", "z")], "name string, content string, more string")
    assert T.formatted(df, "short") == "a|b\nc" and T.formatted(df, "content") == "<x>\ny" and T.formatted(df, "text").startswith("a|b\t<x>\t\n")
    assert "a\\|b" in T.formatted(df, "markdown") and "&lt;x&gt;" in T.formatted(df, "html") and T.formatted(df, "detailed").count("\n\n") == 1
    assert '"count": 2' in T.formatted(df, "json") and T.formatted(df, "raw").startswith("[") and T.formatted(df.limit(0), "markdown") == ""
    edges = spark.createDataFrame([("A b", "C", "calls")], "source string, target string, role string")
    assert T.formatted(edges, "mermaid") == 'graph LR\n  A_b["A b"] -->|calls| C["C"]'
    assert T.tokens("x <<T::f>> {{Page}}<< y") == [("text", "x "), ("field", "T::f"), ("text", " "), ("symbol", "Page"), ("text", "<< y")]
    with pytest.raises(ValueError):
        T.formatted(df, "pdf")


def test_fold_overlay_classify_and_window(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "a", 5), ("a", "c", 3), ("c", "d", 1), ("d", "e", 1)], "a string, b string, n long")
    assert sorted(tuple(r) for r in T.fold(edges, 2).collect()) == [("a", "b", 10), ("a", "rest", 3), ("rest", "rest", 2)]
    df = spark.createDataFrame([("Ann",), ("bob",), (None,)], "who string")
    assert [r["who"] for r in T.overlay(df, "who", spark.createDataFrame([("ANN", "A.")], "author string, alias string")).orderBy("who").collect()] == [None, "A.", "bob"]
    got = df.select(T.classify(F.col("who"), [{"class": "a", "any": ["AN"]}, {"class": "b", "regex": "^b"}]).alias("k"), T.classify(F.col("who"), []).alias("o")).collect()
    assert [tuple(r) for r in got] == [("a", "Other"), ("b", "Other"), ("Other", "Other")]
    assert T.window("3", "all", " x ") == (3, None, "x") and T.window("-1", "99999") == (1, 10_000, None) and T.window(None, "0") == (1, 500, None)
