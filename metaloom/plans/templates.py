"""Query templates as files: their front matter, parameters, output contract, running many, results, formatters, folding of graph payloads."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

_HEAD = re.compile(r"^--\s*@(\w+):[ \t]*(.*)$", re.M)
# A string, a quoted name, a comment, a cast, or a parameter: only the last is replaced.
_PARTS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|::|:([A-Za-z_]\w*)", re.S)
_TYPES = {"object": ("uuid", "name", "type"), "content": ("content",)}


@dataclass(frozen=True)
class Template:
    """A query's text with its front matter: `-- @key: value` lines; repeated keys and comma lists make lists."""

    sql: str
    meta: dict[str, list[str]] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return (self.meta.get("output") or ["table"])[0]


def parse(text: str) -> Template:
    meta: dict[str, list[str]] = {}
    for key, value in _HEAD.findall(text):
        meta.setdefault(key.lower(), []).extend(v.strip() for v in value.split(",") if v.strip())
    return Template(_HEAD.sub("", text).strip(), meta)


def bind(sql: str, values: dict[str, object]) -> tuple[str, list]:
    """The text with a marker for each `:name`, and the values in order; absent ones are null. Strings, names and comments stay as they are.

    Values never become text, so they are not scanned again; only scalars may be given.
    """
    for k, v in values.items():
        if not isinstance(v, (str, int, float, bool, type(None))):
            raise TypeError(f"{k} is no scalar")
    given: list = []

    def put(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        given.append(values.get(m[1]))
        return "?"

    return _PARTS.sub(put, sql), given


def run(spark: SparkSession, template: Template, values: dict[str, object] | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The template's rows, held to its output contract; tables are named in braces in its text."""
    text, given = bind(template.sql, values or {})
    out = spark.sql(text, args=given or None, **(tables or {}))
    lacking = [c for c in _TYPES.get(template.kind, ()) if c not in out.columns]
    if lacking:
        raise ValueError(f"a template of kind {template.kind} needs the columns {', '.join(lacking)}")
    return out


def run_many(jobs: dict[str, Callable[[], object]], at_once: int = 6, seconds: float = 30.0, cache: dict | None = None, fingerprint: str = "") -> dict[str, tuple[str, object]]:
    """Runs jobs a few at a time: name to (state, result or message). A job beyond the time is reported as `timeout`; results are kept by fingerprint."""
    out: dict[str, tuple[str, object]] = {}
    pool = ThreadPoolExecutor(at_once)
    try:
        waiting = {}
        for name, job in jobs.items():
            if cache is not None and (name, fingerprint) in cache:
                out[name] = ("done", cache[name, fingerprint])
            else:
                waiting[name] = pool.submit(job)
        for name, future in waiting.items():
            try:
                out[name] = ("done", future.result(timeout=seconds))
                if cache is not None:
                    cache[name, fingerprint] = out[name][1]
            except TimeoutError:
                out[name] = ("timeout", f"took more than {seconds:g} s")
            except Exception as e:  # the job's own failure is its result
                out[name] = ("failed", f"{type(e).__name__}: {e}")
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return {name: out[name] for name in jobs}


def state(value: float | None, severity: str) -> str:
    """State of a result: ok without findings, else by its severity; no value is neutral."""
    if value is None:
        return "neutral"
    return "ok" if value <= 0 else {"error": "error", "warning": "warning"}.get(severity, "neutral")


def select_tests(tests: Iterable[dict], scope: str, target: str | None = None) -> list[tuple[dict, str]]:
    """Tests that apply to a scope (solution, file, object, list, cluster) and how: native, by filtering a wider result, or static."""
    out = []
    for t in tests:
        scopes = t.get("scopes", ["solution"])
        if "static" in t:
            out.append((t, "static"))
        elif scope in scopes:
            out.append((t, "native"))
        elif "solution" in scopes and target is not None:
            out.append((t, "filter"))
    return out


def run_tests(tests: Iterable[dict], scope: str, target: str | None, rows: Callable[[dict], DataFrame], column: str = "file_name") -> list[dict]:
    """One result for each test: name, value (findings), state. A wider test is filtered to the target in Spark; static ones have their own value."""
    out = []
    for t, how in select_tests(tests, scope, target):
        if how == "static":
            value = t["static"]
        else:
            df = rows(t)
            value = df.where(F.col(column) == target).count() if how == "filter" else df.count()
        out.append({"name": t["name"], "value": value, "state": state(value, t.get("severity", "warning")), "how": how})
    return out


def fold(edges: DataFrame, keep: int) -> DataFrame:
    """Undirected edges (a, b, n) of the `keep` nodes with most weight, all others folded into one node `rest`; both directions are summed, loops of rest stay.

    Weights are summed by pair before anything is ranked; the ranking runs over one row for each node.
    """
    pairs = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))
    weight = pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("w"))
    top = F.broadcast(weight.orderBy(F.desc("w"), "node").limit(keep).select("node", F.lit(True).alias("kept")))  # `keep` rows
    joined = pairs.join(top.select(F.col("node").alias("a"), F.col("kept").alias("ka")), "a", "left").join(top.select(F.col("node").alias("b"), F.col("kept").alias("kb")), "b", "left")
    x, y = (F.when(F.col(k), F.col(c)).otherwise("rest") for c, k in (("a", "ka"), ("b", "kb")))
    return joined.groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.sum("n").alias("n"))


def overlay(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with the names of authors replaced by their alias (aliases: author, alias), without regard to case; names without one stay."""
    known = aliases.groupBy(F.lower("author").alias("_author")).agg(F.min("alias").alias("_alias"))
    return df.join(known, F.lower(F.col(column)) == F.col("_author"), "left").withColumn(column, F.coalesce("_alias", column)).drop("_author", "_alias")


def classify(column: Column, rules: list[dict], otherwise: str = "Other") -> Column:
    """First rule that holds: {class, any: [parts, without regard to case]} or {class, regex}."""
    out = F
    for r in rules:
        hit = F.lit(False)
        for part in r.get("any", ()):
            hit = hit | F.contains(F.lower(column), F.lit(part.lower()))
        if "regex" in r:
            hit = hit | column.rlike(r["regex"])
        out = out.when(hit, r["class"])
    return F.lit(otherwise) if out is F else out.otherwise(otherwise)


def tokens(text: str) -> list[tuple[str, str]]:
    """A label's tokens: merge fields `<<name>>`, symbols `{{name}}` and plain text, in order."""
    out = []
    for m in re.finditer(r"<<([^<>]*)>>|\{\{([^{}]*)\}\}|((?:(?!<<[^<>]*>>|\{\{[^{}]*\}\}).)+)", text, re.S):
        out.append(("field", m[1]) if m[1] is not None else ("symbol", m[2]) if m[2] is not None else ("text", m[3]))
    return out


def _cell(value: object) -> str:
    return "" if value is None else str(value)


def _mermaid(rows: list[dict]) -> str:
    name = lambda x: re.sub(r"\W", "_", _cell(x)) or "_"
    label = lambda x: _cell(x).replace('"', "'")
    edges = [f'  {name(r["source"])}["{label(r["source"])}"] -->|{label(r.get("role"))}| {name(r["target"])}["{label(r["target"])}"]' for r in rows]
    return "\n".join(["graph LR", *edges])


def _table(rows: list[dict]) -> str:
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(_cell(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *(line(r.values()) for r in rows)])


def _html(rows: list[dict]) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(_cell(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + (row(rows[0], "th") if rows else "") + "".join(row(r.values(), "td") for r in rows) + "</table>"


FORMATS: dict[str, Callable[[list[dict]], str]] = {
    "json": lambda rows: json.dumps({"count": len(rows), "rows": rows}, default=str, ensure_ascii=False),
    "raw": lambda rows: json.dumps(rows, default=str, ensure_ascii=False),
    "short": lambda rows: "\n".join(_cell(r.get("name", next(iter(r.values()), None))) for r in rows),
    "detailed": lambda rows: "\n\n".join("\n".join(f"{k}: {_cell(v)}" for k, v in r.items()) for r in rows),
    "text": lambda rows: "\n".join("\t".join(_cell(v) for v in r.values()) for r in rows),
    "markdown": _table,
    "html": _html,
    "mermaid": _mermaid,
    "tokens": lambda rows: json.dumps([tokens(_cell(r.get("content"))) for r in rows], ensure_ascii=False),
    "content": lambda rows: "\n".join(_cell(r.get("content")) for r in rows),
}


def formatted(df: DataFrame, kind: str, most: int = 10_000) -> str:
    """A page of rows as text; pages hold `most` rows at most, so what is gathered is bounded."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    return FORMATS[kind]([r.asDict() for r in df.limit(most).collect()])


def window(page: object = 1, size: object = 500, q: str | None = None, most: int = 10_000) -> tuple[int, int | None, str | None]:
    """Page, rows of a page (none for `all`) and search text of a request; odd values fall back, sizes are held to `most`."""
    number = lambda x, default: int(x) if str(x).strip().lstrip("+").isdigit() and int(x) > 0 else default
    rows = None if str(size).strip().lower() == "all" else min(number(size, 500), most)
    return number(page, 1), rows, (q or "").strip() or None


def folded_trade(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations by orders, the eight busiest nations apart."""
    c, s = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("x")), load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("y"))
    items = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    name = lambda x: F.concat(F.lit("n"), F.lpad(F.col(x).cast("string"), 2, "0"))
    return fold(items.groupBy(name("x").alias("a"), name("y").alias("b")).agg(F.count("*").alias("n")), 8)


def template_run(spark: SparkSession, d: str) -> DataFrame:
    """A template with parameters of each kind; `::` casts, strings and comments with colons stay as they are."""
    text = "-- @output: object\n-- @tags: a, b\n/* :no */ SELECT CAST(c_custkey AS STRING) AS uuid, c_name AS name, c_mktsegment AS type, ':no' AS mark FROM {customer} WHERE c_acctbal >= :least AND (:segment IS NULL OR c_mktsegment = :segment) AND c_nationkey <> coalesce(:absent, -1)"
    return run(spark, parse(text), {"least": -100.5, "segment": "BUILDING"}, {"customer": load(spark, d, "customer")})


QUERIES = {f.__name__: f for f in (folded_trade, template_run)}
ORACLE_SQL = {
    "folded_trade": "WITH p AS (SELECT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS x, 'n' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), w AS (SELECT node, count(*) AS w FROM (SELECT x AS node FROM p UNION ALL SELECT y FROM p WHERE x <> y) GROUP BY 1 ORDER BY w DESC, node LIMIT 8), e AS (SELECT CASE WHEN x IN (SELECT node FROM w) THEN x ELSE 'rest' END AS x, CASE WHEN y IN (SELECT node FROM w) THEN y ELSE 'rest' END AS y FROM p) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM e GROUP BY ALL",
    "template_run": "SELECT CAST(c_custkey AS VARCHAR) AS uuid, c_name AS name, c_mktsegment AS type, ':no' AS mark FROM customer WHERE c_acctbal >= -100.5 AND c_mktsegment = 'BUILDING' AND c_nationkey <> -1",
}
