"""Column functions for calls whose meaning differs from Spark's own function of that name, or that Spark lacks.

All are compositions of built-in functions and so stay in generated code; `html_unescape` alone is an Arrow-batched Python function.
Null in any argument gives null, unless said otherwise.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Date format letters and what Spark calls them.
_DATE_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "a": "EEE", "%": "%"}
#: The entities of well-formed markup, the ampersand last, so that nothing is decoded twice.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&#13;", "\r"), ("&#9;", "\t"), ("&amp;", "&"))
_SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


# Strings


def split_literal(c: Column, separator: str) -> Column:
    """The parts between occurrences of the separator, which is no pattern; empty parts at the end stay."""
    return F.split(c, re.sub(r"([^A-Za-z0-9\s])", r"\\\1", separator), -1)


def full_match(c: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole string, a line end at its end included."""
    return c.rlike(rf"\A(?:{pattern})\z")


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """The string with the first match replaced; `$1` in the replacement stands for a group. The match is looked at alone, without what surrounds it."""
    found, at = F.regexp_substr(c, F.lit(pattern)), F.regexp_instr(c, F.lit(pattern))
    replaced = F.concat(F.left(c, at - 1), F.regexp_replace(found, pattern, replacement), F.substr(c, at + F.length(found)))
    return F.when(found.isNull(), c).otherwise(replaced)


def escape_pattern(c: Column) -> Column:
    """A pattern that matches the string itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def substring_from(c: Column, start: int, length: int) -> Column:
    """Characters start to start + length - 1, counted from 1; places before the first are counted but empty."""
    return F.substr(c, F.lit(max(start, 1)), F.lit(max(0, start + length - max(start, 1))))


def url_encode(c: Column) -> Column:
    """Percent encoding of all but letters, digits and `-._~`."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def xml_unescape(c: Column) -> Column:
    for was, now in _ENTITIES:
        c = F.replace(c, F.lit(was), F.lit(now))
    return c


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """All named and numeric character references decoded."""
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def restore_lines(c: Column) -> Column:
    """Line ends in place of the delete characters that stand for them."""
    return F.translate(c, "\x7f", "\n")


# Numbers


def round_to_long(c: Column) -> Column:
    """A fractional number as the nearest whole one, the even one of two; Spark's cast would cut it off."""
    return F.rint(c.cast("double")).cast("long")


def parse_long(c: Column) -> Column:
    """A string as a whole number, fractions rounded away from zero at a half; null where it is no number."""
    return F.round(c.try_cast("decimal(38,9)"), 0).cast("long")


# Dates, without regard to the session's time zone


def epoch_micros(c: Column) -> Column:
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    whole = (days * 24 + F.hour(c)) * 60 + F.minute(c)
    return whole * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def epoch(c: Column) -> Column:
    """Seconds since 1970, with their fraction."""
    return epoch_micros(c) / F.lit(1e6)


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit between two timestamps, not full units: 23:59 and 00:01 of the next day are a day apart. Weeks are whole weeks of such days."""
    if unit in ("year", "quarter", "month"):
        months = {"year": F.year, "quarter": lambda c: F.year(c) * 4 + F.quarter(c), "month": lambda c: F.year(c) * 12 + F.month(c)}[unit]
        return (months(end) - months(start)).cast("long")
    if unit == "week":
        return F.call_function("div", boundaries("day", start, end), F.lit(7))
    if unit not in _SECONDS:
        raise ValueError(f"no such unit: {unit}")
    number = lambda c: F.floor(epoch_micros(c) / (_SECONDS[unit] * 1_000_000))
    return (number(end) - number(start)).cast("long")


def iso_weekday(c: Column) -> Column:
    """1 on Monday to 7 on Sunday."""
    return F.weekday(c) + 1


def format_date(c: Column, pattern: str) -> Column:
    """A date by a pattern of percent letters; everything else stands for itself."""
    out, at = "", 0
    quoted = lambda s: "'" + s.replace("'", "''") + "'" if s else ""
    for m in re.finditer("%(.)", pattern):
        if m[1] not in _DATE_LETTERS:
            raise ValueError(f"no such date letter: {m[0]}")
        out += quoted(pattern[at : m.start()]) + (quoted("%") if m[1] == "%" else _DATE_LETTERS[m[1]])
        at = m.end()
    return F.date_format(c, out + quoted(pattern[at:]))


# Lists and aggregates


def list_slice(c: Column, begin: int, end: int) -> Column:
    """Elements begin to end, both included, counted from 1; a negative place counts from the end."""
    place = lambda i: F.lit(i) if i >= 0 else F.size(c) + 1 + i
    first = F.greatest(place(begin), F.lit(1))
    return F.slice(c, first, F.greatest(place(end) - first + 1, F.lit(0)))


def list_count(c: Column) -> Column:
    """Elements that aren't null."""
    return F.size(F.filter(c, lambda x: x.isNotNull()))


def list_ordered(value: Column, *order: Column) -> Column:
    """Aggregate: all values, nulls too, in order; null over no row."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.when(F.size(rows) > 0, F.transform(rows, lambda x: x["v"]))


def first_ordered(value: Column, *order: Column) -> Column:
    """Aggregate: the value of the first row in order; null over no row."""
    return F.min_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def mode_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest at a tie, and how often it occurs; nulls don't count."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n_mode"), value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_mode"))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def derived_uuid(*parts: Column) -> Column:
    """A stable identity made of several values; null parts count as empty."""
    return F.md5(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
