"""Token and text operators: a lexer with ordinality, marker and secret scans, rule-based classes, element extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load

#: One alternative for each kind of token, in order of precedence; both engines read the pattern alike.
TOKEN = r'"[^"\n]*"|//[^\n]*|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_]'


def _kind(token):
    return F.when(token.startswith('"') & (F.length(token) > 1), "string").when(token.startswith("//"), "comment").when(token.rlike("^[0-9]"), "number").when(token.rlike("^[A-Za-z_]"), "name").otherwise("sign")


def lexer_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the benchmark texts with their place and kind."""
    items = load(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("place", "token"))
    return items.select("item_id", F.col("place").cast("long").alias("place"), "token", _kind(F.col("token")).alias("kind"))


def token_profile(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each kind in each document, counted inside the row, so that no token is shuffled."""
    tokens = load(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    kinds = tokens.select("doc_id", F.transform("tokens", lambda t: F.struct(_kind(t).alias("kind"), t.alias("token"))).alias("tokens"))
    per = kinds.select("doc_id", "tokens", F.explode(F.array_distinct(F.transform("tokens", lambda t: t["kind"]))).alias("kind"))
    own = F.transform(F.filter("tokens", lambda t: t["kind"] == F.col("kind")), lambda t: t["token"])
    return per.select("doc_id", "kind", F.size(own).cast("long").alias("n"), F.size(F.array_distinct(own)).cast("long").alias("n_distinct"))


def token_followed_by_sign(spark: SparkSession, d: str) -> DataFrame:
    """Names whose next token is a sign, by name and sign."""
    w = Window.partitionBy("item_id").orderBy("place")
    return lexer_tokens(spark, d).withColumn("next_kind", F.lead("kind").over(w)).withColumn("next", F.lead("token").over(w)).where("kind = 'name' and next_kind = 'sign'").groupBy("next").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_names"))


def todo_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that carry a marker, numbered from 1."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.where(F.lower("line").rlike("licen[sc]e|token = ")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_number"), F.md5("line").alias("line_digest"))


_SECRETS = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "key": r"\b[0-9a-f]{40}\b", "card": r"\b[0-9]{16}\b", "url": r"https?://[^\s]+"}


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Number of matches of each kind of secret in the documents that have any."""
    counts = [F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in _SECRETS.items()]
    return load(spark, d, "documents").select("doc_id", *counts).where(" + ".join(_SECRETS) + " > 0")


_FAMILIES = [("spam", "cheap|spam"), ("blog", "//blog\\."), ("mobile", "//m\\."), ("feed", "utm_source=feed"), ("paged", "[?]page=")]


def api_family_classify(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that a page's address meets."""
    rule = F.when(F.col("url").isNull(), "none")
    for name, pattern in _FAMILIES:
        rule = rule.when(F.lower("url").rlike(pattern), name)
    return load(spark, d, "pages").select("page_id", rule.otherwise("other").alias("family"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """Title, language, links and paragraphs of each page, by pattern: pages aren't well-formed."""
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


def props_extract(spark: SparkSession, d: str) -> DataFrame:
    """Typed values from the events' JSON properties, by type."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return load(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


QUERIES = {f.__name__: f for f in (lexer_tokens, token_profile, token_followed_by_sign, todo_scan, secret_scan, api_family_classify, html_extract, props_extract)}
_K = "CASE WHEN token LIKE '\"%' AND length(token) > 1 THEN 'string' WHEN token LIKE '//%' THEN 'comment' WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '^[A-Za-z_]') THEN 'name' ELSE 'sign' END"
_T = f"t AS (SELECT item_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token, unnest(range(len(regexp_extract_all(text, '{TOKEN}')))) AS place FROM benchmark), k AS (SELECT item_id, place, token, {_K} AS kind FROM t)"
ORACLE_SQL = {
    "lexer_tokens": f"WITH {_T} SELECT item_id, place, token, kind FROM k",
    "token_profile": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents) SELECT doc_id, {_K} AS kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM t GROUP BY ALL",
    "token_followed_by_sign": f"WITH {_T}, n AS (SELECT *, lead(kind) OVER w AS next_kind, lead(token) OVER w AS next FROM k WINDOW w AS (PARTITION BY item_id ORDER BY place)) SELECT next, count(*) AS n, count(DISTINCT token) AS n_names FROM n WHERE kind = 'name' AND next_kind = 'sign' GROUP BY 1",
    "todo_scan": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents) SELECT doc_id, line_number, md5(line) AS line_digest FROM l WHERE regexp_matches(lower(line), 'licen[sc]e|token = ')",
    "secret_scan": "SELECT * FROM (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _SECRETS.items()) + " FROM documents) WHERE " + " + ".join(_SECRETS) + " > 0",
    "api_family_classify": "SELECT page_id, CASE WHEN url IS NULL THEN 'none' " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{n}'" for n, p in _FAMILIES) + " ELSE 'other' END AS family, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages",
    "html_extract": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages",
    "props_extract": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (SELECT event_type, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events) GROUP BY 1",
}
