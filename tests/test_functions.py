"""Functions on cases that tables don't hold, and the file sinks."""

import datetime
import html

import pytest
from metaloom.functions import dialect as f
from metaloom.sources import sinks
from pyspark.sql import functions as F

T = datetime.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strings(spark):
    text = lambda s: F.lit(s).cast("string")
    assert one(spark, f.split_literal(text("a.b..c."), ".")) == ["a", "b", "", "c", ""]
    assert one(spark, f.split_literal(text("a||b"), "||")) == ["a", "b"]
    assert one(spark, f.split_literal(text(None), ".")) is None
    assert [one(spark, f.full_match(text(s), "a+|b")) for s in ("aa", "b", "ab", "a\n", "")] == [True, True, False, False, False]
    assert [one(spark, f.replace_first(text(s), "(b)", "<$1>")) for s in ("abab", "aa", "", None)] == ["a<b>ab", "aa", "", None]
    assert one(spark, text("x").rlike("x") & F.rlike(text("a.\\E+b"), f.escape_pattern(text("a.\\E+b"))))
    assert [one(spark, f.substring_from(text("abcdef"), *p)) for p in ((1, 2), (0, 2), (-3, 3), (5, 9))] == ["ab", "a", "", "ef"]
    assert one(spark, f.url_encode(text("a b~*+ü-._"))) == "a%20b~%2A%2B%C3%BC-._"
    assert one(spark, f.xml_unescape(text("&amp;lt;&lt;&#10;"))) == "&lt;<\n"
    cases = ["&eacute;&#233;&#xe9;&nbsp;&amp;lt;", "", None]
    got = [r["x"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", f.html_unescape("c").alias("x")).orderBy("i").collect()]
    assert got == [html.unescape(cases[0]), "", None]


def test_numbers_and_dates(spark):
    assert [one(spark, f.round_to_long(F.lit(x))) for x in (0.5, 1.5, 2.4, -2.6)] == [0, 2, 2, -3]
    assert [one(spark, f.parse_long(F.lit(s))) for s in ("5.7", "-1", "x", "")] == [6, -1, None, None]
    at = lambda *p: F.lit(T(*p)).cast("timestamp_ntz")
    late, early = at(2023, 12, 31, 23, 59, 59, 999999), at(2024, 1, 1, 0, 0)
    assert [one(spark, f.boundaries(u, late, early)) for u in ("year", "quarter", "month", "day", "hour", "minute", "second")] == [1] * 7
    assert [one(spark, f.boundaries("week", *p)) for p in ((late, early), (at(2024, 1, 7, 23), at(2024, 1, 14, 22)), (at(2024, 1, 14, 22), at(2024, 1, 7, 23)))] == [0, 1, -1]
    assert one(spark, f.epoch_micros(at(1969, 12, 31, 23, 59, 59, 1))) == -999999
    assert one(spark, f.format_date(early, "it's %d.%m.%y %H%%")) == "it's 01.01.24 00%"
    with pytest.raises(ValueError):
        f.boundaries("century", late, early)


def test_lists(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "a"), (5, "b")], "i int, v string")
    assert df.select(f.list_ordered(F.col("v"), F.col("i")).alias("x")).first()["x"] == ["b", None, "a", "a", "b"]
    assert df.where("i > 9").select(f.list_ordered(F.col("v"), F.col("i")).alias("x")).first()["x"] is None
    assert df.where("i > 1").select(f.first_ordered(F.col("v"), F.col("i")).alias("x")).first()["x"] is None
    assert f.mode_smallest(df.withColumn("k", F.lit(1)), ["k"], "v").collect() == [(1, "a", 2)]
    whole = F.array(*map(F.lit, (1, 2, 3)))
    assert [one(spark, f.list_slice(whole, *p)) for p in ((2, 3), (-2, -1), (-9, 1), (3, 2), (5, 9))] == [[2, 3], [2, 3], [1], [], []]


@pytest.mark.parametrize("kind", sinks.FORMATS)
def test_sinks(spark, tmp_path, kind):
    schema = "i int, s string, t timestamp_ntz, d double"
    rows = [(1, 'a "quoted", text\nof two lines', T(2024, 1, 2, 3, 4, 5, 6), 0.1), (2, "", None, None), (None, None, T(1999, 1, 1), -1.0)]
    df = spark.createDataFrame(rows, schema)
    sinks.write(df, str(tmp_path / kind), kind)
    assert sorted(map(tuple, sinks.read(spark, str(tmp_path / kind), kind, schema).collect()), key=str) == sorted(rows, key=str)
    empty = str(tmp_path / "empty")
    sinks.write(df.where("i > 9"), empty, kind)
    assert sinks.read(spark, empty, kind, schema).count() == 0
    with pytest.raises(ValueError):
        sinks.write(df, empty, "xls")
