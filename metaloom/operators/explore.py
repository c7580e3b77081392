"""Exploring the graph of typed links: filtered subgraphs, traces of a flow, their entries, activity of nodes, paths, search, classes of addresses.

A node is 'type::uuid'. Loops over the graph write each round below spark.checkpoint.dir. Caps (`limit`, `top`, samples of names) are the
features themselves; what they leave out is counted beside.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load, uuid
from . import edges
from .graph import cut, walk

# Events that only a user's action fires, so that no running script reaches them; limits of the saves level and of ages in days.
INTERACTION = ("OnLayoutKeystroke", "OnObjectKeystroke", "OnGestureTap", "OnExternalCommandReceived", "OnObjectModify")
SAVES_LIMITS, AGE_LIMITS = (0.3, 0.4, 0.5, 0.6), (30, 90, 365, 730)
RELATIONS = ("steps", "triggers", "layout_objects", "layouts", "relationships", "fields")


def graph_of(links: DataFrame) -> DataFrame:
    """Links as edges (a, a_type, b, b_type, link_role, link_subrole, link_kind) between nodes, each once."""
    key = lambda end: F.concat_ws("::", f"{end}_type", f"{end}_uuid")
    return links.select(key("source").alias("a"), F.col("source_type").alias("a_type"), key("target").alias("b"), F.col("target_type").alias("b_type"), "link_role", "link_subrole", "link_kind").distinct()


def back(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _node(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("node"))


def subgraph(graph: DataFrame, focus: str, depth: int = 1, direction: str = "both", roles: Sequence[str] | None = None, types: Sequence[str] | None = None, builtins: bool = False, limit: int = 1000, hub: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, type, depth, degree, is_hub, is_focus, total_reachable) within `depth` steps of the focus, and the edges between them.

    Roles filter edges before the walk, types filter nodes after it (the focus stays always). Of more than `limit` nodes the nearest stay, of
    these the ones of highest degree, then by name; total_reachable counts them all. Degrees are over all usage links.
    """
    base = graph if builtins else graph.where("b_type <> 'BuiltinFunction'")
    base = base.where(F.col("link_role").isin(*roles)) if roles else base
    ahead = base.select("a", "b")
    steps = {"out": ahead, "in": back(ahead), "both": ahead.union(back(ahead))}[direction].distinct()
    reached = walk(steps, _node(graph.sparkSession, focus), depth).withColumn("type", F.split_part("node", F.lit("::"), F.lit(1)))
    reached = reached.where(F.col("type").isin(*types) | (F.col("node") == focus)) if types else reached
    used = graph.where("link_kind = 'usage'")
    degree = used.select(F.explode(F.array("a", "b")).alias("node")).join(reached.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))
    ranked = cut(reached.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    kept = cut(ranked.orderBy("depth", F.desc("degree"), "node").limit(limit))
    nodes = kept.select("node", "type", F.col("depth").cast("long").alias("depth"), "degree", (F.col("degree") >= hub).alias("is_hub"), (F.col("node") == focus).alias("is_focus"), F.lit(ranked.count()).alias("total_reachable"))
    ends = kept.select("node")
    inside = base.join(ends, F.col("a") == F.col("node"), "left_semi").join(ends, F.col("b") == F.col("node"), "left_semi")
    return nodes, inside.select("a", "b", "link_role", "link_subrole", "link_kind").distinct()


def trace(graph: DataFrame, start: str, up: int = 3, down: int = 6, levels: int = 1, exclude: Sequence[str] = (), interaction: bool = False) -> DataFrame:
    """What a run of the start script meets: (node, trace_role, trace_depth), one row for each node.

    Chain: scripts called, `down` steps, and callers, `up` steps (negative depth). Touched: what called scripts and the start use. Triggered:
    scripts that fire on the layouts entered, by the layout or by an object on it that shows a field met so far, and what these call; so for
    `levels` levels, a level's depth being its number. A node with several roles has the first of start, chain, triggered, touched,
    trigger_touched, at its least depth. Excluded nodes are met but not left; the start can't be excluded.
    """
    spark, out = graph.sparkSession, [n for n in exclude if n != start]
    open_ = graph.where(~F.col("a").isin(*out)) if out else graph
    calls = cut(graph.where("link_role = 'calls_script'").select("a", "b").distinct())
    free = lambda pairs: pairs.where(~F.col("a").isin(*out)) if out else pairs
    uses = cut(open_.where("a_type = 'Script' and link_kind = 'usage' and link_role not in ('calls_script', 'triggers_script')").select("a", "b", "b_type", "link_role").distinct())
    fires = graph.where("link_role = 'triggers_script' and link_subrole is distinct from 'button'")
    fires = cut((fires if interaction else fires.where(F.col("link_subrole").isNull() | ~F.col("link_subrole").isin(*INTERACTION))).select("a", "a_type", "b").distinct())
    on = graph.where("link_role = 'parent_layout'").select(F.col("a").alias("object"), F.col("b").alias("layout")).distinct()
    shows = graph.where("link_role = 'displays_field' and a_type = 'LayoutObject'").select(F.col("a").alias("object"), F.col("b").alias("field")).distinct()
    row = lambda df, role, rank, depth: df.select("node", F.lit(role).alias("role"), F.lit(rank).alias("rank"), depth.cast("long").alias("depth"))

    chain = cut(walk(free(calls), _node(spark, start), down))
    rows = [row(chain, "chain", 1, F.col("depth")), row(_node(spark, start), "start", 0, F.lit(0)), row(walk(free(back(calls)), _node(spark, start), up), "chain", 1, -F.col("depth"))]
    touched = cut(uses.join(chain.select(F.col("node").alias("a"), "depth"), "a"))
    rows.append(row(touched.withColumn("node", F.col("b")), "touched", 3, F.col("depth")))
    fields = layouts = None
    for level in range(1, levels + 1):
        met = touched.where(~F.col("b").isin(*out)) if out else touched
        new = met.where("link_role = 'navigates_to_layout'").select(F.col("b").alias("layout")).distinct()
        new = cut(new if layouts is None else new.join(layouts, "layout", "left_anti"))
        layouts = new if layouts is None else layouts.union(new)
        seen = met.where("b_type = 'Field'").select(F.col("b").alias("field"))
        fields = cut((seen if fields is None else fields.union(seen)).distinct())
        objects = on.join(new, "layout", "left_semi").join(shows.join(fields, "field", "left_semi"), "object", "left_semi").select(F.col("object").alias("owner"))
        owners = new.select(F.col("layout").alias("owner")).union(objects).distinct()
        seeds = cut(fires.join(owners, F.col("a") == F.col("owner"), "left_semi").select(F.col("b").alias("node")).distinct())
        cascade = cut(walk(free(calls), seeds, down))
        touched = cut(uses.join(cascade.select(F.col("node").alias("a")), "a", "left_semi"))
        rows += [row(cascade, "triggered", 2, F.lit(level)), row(touched.withColumn("node", F.col("b")), "trigger_touched", 4, F.lit(level))]
    best = F.min(F.struct("rank", F.abs("depth").alias("far"), (F.col("depth") < 0).alias("is_up"), "role", "depth"))
    return reduce(DataFrame.union, rows).groupBy("node").agg(best.alias("x")).select("node", F.col("x.role").alias("trace_role"), F.col("x.depth").alias("trace_depth"))


def entries(graph: DataFrame, sample: int = 5) -> DataFrame:
    """Where a trace of each script or layout can begin: (start, entry, is_default, seed_count, seeds_sample: the first names, comma-separated).

    A layout has three rows even without seeds: scripts that fire on it or its objects, scripts that go there, and both.
    """
    runs = graph.where("link_role = 'triggers_script'").select("a", "a_type", F.col("b").alias("seed"))
    on = graph.where("link_role = 'parent_layout'").select("a", F.col("b").alias("start"))
    runtime = runs.where("a_type = 'Layout'").select(F.col("a").alias("start"), "seed").union(runs.where("a_type = 'LayoutObject'").join(on, "a").select("start", "seed")).distinct()
    inbound = graph.where("link_role = 'navigates_to_layout' and a_type = 'Script'").select(F.col("b").alias("start"), F.col("a").alias("seed")).distinct()
    kinds = lambda df, kind: df.select("start", "seed", F.explode(F.array(F.lit(kind), F.lit("layout_full"))).alias("entry"))
    seeds = kinds(runtime, "layout_runtime").union(kinds(inbound, "layout_inbound")).distinct()
    first = seeds.withColumn("r", F.row_number().over(Window.partitionBy("start", "entry").orderBy("seed"))).where(F.col("r") <= sample)
    names = first.groupBy("start", "entry").agg(F.array_join(F.array_sort(F.collect_list("seed")), ",").alias("seeds_sample"))
    counts = seeds.groupBy("start", "entry").agg(F.count("*").alias("seed_count"))
    nodes = graph.select(F.explode(F.array(F.struct(F.col("a").alias("start"), F.col("a_type").alias("type")), F.struct(F.col("b").alias("start"), F.col("b_type").alias("type")))).alias("x")).select("x.*").where("type in ('Layout', 'Script')").distinct()
    spine = nodes.where("type = 'Layout'").select("start", F.explode(F.array(*map(F.lit, ("layout_runtime", "layout_inbound", "layout_full")))).alias("entry"))
    of_layouts = spine.join(counts, ["start", "entry"], "left").join(names, ["start", "entry"], "left")
    of_layouts = of_layouts.select("start", "entry", (F.col("entry") == "layout_runtime").alias("is_default"), F.coalesce("seed_count", F.lit(0)).alias("seed_count"), F.coalesce("seeds_sample", F.lit("")).alias("seeds_sample"))
    return of_layouts.union(nodes.where("type = 'Script'").select("start", F.lit("script"), F.lit(True), F.lit(1).cast("long"), "start"))


def activity(stamps: DataFrame, members: DataFrame) -> DataFrame:
    """How lately and how often the members of a group were changed; stamps (object, type, modified, saves, individual, known), members (grp, object).

    Ages count from the newest individual change, else from the newest stamp. Classes: 1 to 5 by age; a stamp that doesn't date the last real
    change (not known) is 5 if old enough, else 6; 7 is a group without any stamp. The level of saves is from the mean mid-rank of the
    counters within their type, over all stamps.
    """
    dated = stamps.where("modified is not null").withColumn("saves", F.coalesce("saves", F.lit(0)))
    anchor = F.lit(dated.agg(F.coalesce(F.max(F.when(F.col("individual"), F.col("modified"))), F.max("modified"))).first()[0]).cast("date")
    per = dated.groupBy("type", "saves").agg(F.count("*").alias("c"))
    of_type = Window.partitionBy("type")
    below = F.sum("c").over(of_type.orderBy("saves")) - F.col("c")
    ranks = per.withColumn("below", below).withColumn("n", F.sum("c").over(of_type))
    ranks = ranks.select("type", "saves", ((F.when(F.col("n") > 1, F.col("below") / (F.col("n") - 1)).otherwise(0.0) + (F.col("below") + F.col("c")) / F.col("n")) / 2).alias("rank"))
    age = F.datediff(anchor, F.col("modified"))
    by_age = reduce(lambda c, x: c.when(F.col("age") <= x[1], x[0]), enumerate(AGE_LIMITS, 1), F.when(~F.col("known") & (F.col("age") <= AGE_LIMITS[-1]), 6)).otherwise(5)
    nodes = dated.withColumn("age", age).withColumn("class", by_age).join(ranks, ["type", "saves"]).select("object", "modified", "saves", "known", "age", "class", "rank")
    of = members.join(nodes, "object", "left")
    known = lambda c: F.when(F.col("known"), F.col(c))
    mean = F.round(F.avg("rank"), 9)
    level = reduce(lambda c, x: c.when(mean > x[0], x[1]), zip(reversed(SAVES_LIMITS), (5, 4, 3, 2), strict=True), F.when(F.count("rank") == 0, None)).otherwise(1)
    return of.groupBy("grp").agg(
        F.count("*").alias("members"), F.coalesce(F.min("class"), F.lit(7)).cast("long").alias("activity_class"), F.max(known("modified")).alias("newest_change"), F.min(known("age")).cast("long").alias("newest_age_days"),
        F.count_if(F.col("known") & (F.col("class") <= 2)).alias("active_90"), F.round(F.median(known("age"))).cast("long").alias("median_age_days"), F.round(F.median("saves")).cast("long").alias("median_saves"),
        F.count("class").alias("stamped"), F.count_if(~F.col("known")).alias("undated"), level.cast("long").alias("saves_level"),
    )


def nearest_paths(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """For every node that an anchor (node) reaches along pairs (a, b): the nearest anchor, the depth and the path to it as an array.

    Ties go to the smallest anchor, then the smallest path. A round extends the last round's paths, one for each node; nodes seen before are dropped, so cycles end.
    """
    seen = front = cut(anchors.select("node").distinct().select("node", F.col("node").alias("anchor"), F.array("node").alias("path")))
    while not front.isEmpty():
        met = pairs.join(front, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "anchor", F.array_append("path", F.col("b")).alias("path"))
        best = met.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("anchor", "path")).alias("x"))
        front = cut(best.select("node", "x.*"))
        seen = seen.unionByName(front)
    return seen.select("node", "anchor", (F.size("path") - 1).cast("long").alias("depth"), F.reverse("path").alias("path"))


def find(objects: DataFrame, texts: DataFrame, term: str) -> DataFrame:
    """Objects (kind, key, uuid, name) that a term finds, each with its best rank: 1 identity, 2 key, 3 whole name, 4 start of the name, 5 in the name, 6 in a text of theirs (kind, key, text)."""
    low = term.strip().lower()
    name = F.lower("name")
    rank = F.when(F.col("uuid") == low, 1).when(F.col("key").cast("string") == low, 2).when(name == low, 3).when(F.startswith(name, F.lit(low)), 4).when(F.contains(name, F.lit(low)), 5)
    hits = objects.select("kind", "key", rank.alias("rank")).where("rank is not null")
    said = texts.where(F.contains(F.lower("text"), F.lit(low))).select("kind", "key", F.lit(6).alias("rank"))
    return hits.union(said).groupBy("kind", "key").agg(F.min("rank").cast("long").alias("rank"))


@dataclass(frozen=True)
class Family:
    """A rule for addresses: any of the ilike patterns, else a regular expression; and, if given, a kind of source and whether in a comment."""

    name: str
    ilike: tuple[str, ...] = ()
    regex: str = ""
    source_type: str = ""
    in_comment: bool | None = None

    def sql(self, matches: str) -> str:
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        parts = ["(" + " OR ".join(f"url ILIKE {quoted(p)}" for p in self.ilike) + ")"] if self.ilike else [f"{matches}(url, {quoted(self.regex)})"] if self.regex else []
        parts += [f"source_type = {quoted(self.source_type)}"] if self.source_type else []
        parts += [] if self.in_comment is None else ["in_comment" if self.in_comment else "NOT in_comment"]
        return f"WHEN {' AND '.join(parts)} THEN {quoted(self.name)}" if parts else ""


def family_sql(rules: Sequence[Family], matches: str = "regexp") -> str:
    """The first rule that holds names the family; imports without one are local, the rest 'Other'. Rules without condition are left out."""
    return "CASE " + " ".join(r.sql(matches) for r in rules) + " WHEN source_type = 'Script (Import)' THEN 'Local Import' ELSE 'Other' END"


def top_and_rest(nodes: DataFrame, top: int) -> DataFrame:
    """Of each segment (segment, label, weight) the `top` heaviest labels, ties by label, and one row 'Rest' with what is left, where anything is."""
    ranked = nodes.withColumn("r", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("weight"), "label"))).where(F.col("r") <= top)
    heads = cut(ranked.select("segment", "label", "weight", F.lit(1).cast("long").alias("n_nodes"), F.col("r").cast("long").alias("place")))
    less = heads.groupBy("segment").agg(F.sum("weight").alias("w"), F.count("*").alias("k"))
    total = nodes.groupBy("segment").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_nodes"))
    rest = total.join(less, "segment").where("n_nodes > k").select("segment", F.lit("Rest").alias("label"), (F.col("weight") - F.col("w")).alias("weight"), (F.col("n_nodes") - F.col("k")).alias("n_nodes"), F.lit(top + 1).cast("long").alias("place"))
    return heads.unionByName(rest)


def authors(stamps: DataFrame, overlay: DataFrame) -> DataFrame:
    """Changes by person: stamps (author, kind, modified) under the names of the overlay (author, alias, technical), which also decides who is no person; else a known kind does."""
    own = stamps.groupBy("author", "kind").agg(F.count("*").alias("n"), F.max("modified").alias("last"))
    technical: Column = F.coalesce("technical", F.col("kind").isNotNull())
    named = own.join(overlay, "author", "left").select(F.coalesce("alias", "author").alias("name"), technical.alias("is_technical"), "author", "n", "last")
    return named.groupBy("name", "is_technical").agg(F.sum("n").alias("n_changes"), F.count_distinct("author").alias("n_authors"), F.max("last").alias("last_change"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return cut(graph_of(edges.object_links(edges.relations(spark, d, RELATIONS))))


FOCUS, START, LEFT_OUT = "Script::SCR27", "Script::SCR27", ("Script::SCR9", "Layout::LAY5", "Script::SCR27")
_TYPES, _ROLES = ("Script", "Field", "Layout"), ("calls_script", "sets_field", "references_field", "navigates_to_layout", "displays_field", "triggers_script")


def subgraph_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Scripts, fields and layouts within two steps of a script by six roles, at most 60."""
    return subgraph(_graph(spark, d), FOCUS, 2, "both", _ROLES, _TYPES, limit=60, hub=20)[0]


def subgraph_filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    """The links between them."""
    return subgraph(_graph(spark, d), FOCUS, 2, "both", _ROLES, _TYPES, limit=60, hub=20)[1]


def depth_profile_out(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by distance ahead of a script, up to four steps, and whether nothing lies beyond."""
    graph = _graph(spark, d).select("a", "b").distinct()
    per = cut(walk(graph, _node(spark, FOCUS), 5).groupBy("depth").agg(F.count("*").alias("n_nodes")))
    most = per.agg(F.max("depth")).first()[0]
    return per.where("depth <= 4").select(F.col("depth").cast("long").alias("depth"), "n_nodes", F.lit(most <= 4).alias("is_whole"))


def trace_selective(spark: SparkSession, d: str) -> DataFrame:
    """The trace of a script over two levels of triggers, two nodes excluded."""
    return trace(_graph(spark, d), START, 2, 3, 2, LEFT_OUT)


def trace_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(_graph(spark, d))


def node_activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity of customers by their orders, every sixth of which is a mass change."""
    orders = load(spark, d, "orders")
    alone = F.col("o_orderkey") % 6 != 0
    stamps = orders.select(F.col("o_orderkey").alias("object"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").cast("date").alias("modified"), (F.col("o_orderkey") % 37).alias("saves"), alone.alias("individual"), alone.alias("known"))
    members = load(spark, d, "customer").join(orders.select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("grp"), F.col("o_orderkey").alias("object"))
    return activity(stamps, members).withColumn("newest_change", F.col("newest_change").cast("string"))


def occurrence_paths(spark: SparkSession, d: str) -> DataFrame:
    """From every customer of a forest the path to the nearest one in use."""
    c = load(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    links = c.where("node >= 3 and node % 7 <> 0").select(F.col("node").alias("a"), F.expr("node div 3").alias("b"))
    found = nearest_paths(cut(links.union(back(links)).distinct()), c.where("node % 23 = 0"))
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


def search_objects(spark: SparkSession, d: str) -> DataFrame:
    """What a number and an identity find among customers, suppliers, parts and documents with their texts."""
    named = (("Customer", "customer", "c_custkey", "c_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Part", "part", "p_partkey", "p_name"), ("Document", "documents", "doc_id", "source"))
    objects = reduce(DataFrame.union, [load(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).cast("long").alias("key"), uuid(k, F.col(i)).alias("uuid"), F.col(n).alias("name")) for k, t, i, n in named])
    texts = load(spark, d, "documents").select(F.lit("Document").alias("kind"), F.col("doc_id").cast("long").alias("key"), "text")
    terms = ("12", _IDENTITY)
    return reduce(DataFrame.union, [find(objects, texts, t).select(F.lit(t).alias("term"), "kind", "key", "rank") for t in terms])


_IDENTITY = "30c704a562635da4a25f680ecbf22d8c"
FAMILIES = (Family("Commented function", source_type="CustomFunction", in_comment=True), Family("Secure", ("https://%.org/%", "https://%.net/%")), Family("Numbered", regex="[0-9]{2,}"), Family("Without condition"), Family("Web", ("http%",), in_comment=False))


def url_families(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages by family."""
    pages = load(spark, d, "pages").selectExpr("page_id", "url", "CASE page_id % 5 WHEN 0 THEN 'Script (Import)' WHEN 1 THEN 'CustomFunction' ELSE 'Script' END AS source_type", "page_id % 3 = 0 AS in_comment")
    return pages.select(F.expr(family_sql(FAMILIES)).alias("family"), "page_id").groupBy("family").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def overview_leaf(spark: SparkSession, d: str) -> DataFrame:
    """Each market segment's five customers with most orders, and the rest."""
    degree = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("weight"))
    nodes = load(spark, d, "customer").join(degree, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("label"), F.coalesce("weight", F.lit(0)).alias("weight"))
    return top_and_rest(nodes, 5)


def change_authors(spark: SparkSession, d: str) -> DataFrame:
    """Orders as changes of customers, a tenth of whom go by another name."""
    stamps = load(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS author", "CASE WHEN o_orderkey % 11 = 0 THEN 'server' END AS kind", "CAST(o_orderdate AS DATE) AS modified")
    overlay = load(spark, d, "customer").where("c_custkey % 10 = 0").selectExpr("CAST(c_custkey AS STRING) AS author", "CONCAT('Team ', c_nationkey) AS alias", "CASE WHEN c_custkey % 30 <> 0 THEN c_custkey % 20 = 0 END AS technical")
    return authors(stamps, overlay).withColumn("last_change", F.col("last_change").cast("string"))


QUERIES = {f.__name__: f for f in (subgraph_filtered, subgraph_filtered_edges, depth_profile_out, trace_selective, trace_entries, node_activity, occurrence_paths, search_objects, url_families, overview_leaf, change_authors)}

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_GRAPH = edges._links_sql(RELATIONS).replace("WITH ", "WITH RECURSIVE ", 1) + ", g AS MATERIALIZED (SELECT DISTINCT source_type || '::' || source_uuid AS a, source_type AS a_type, target_type || '::' || target_uuid AS b, target_type AS b_type, link_role, link_subrole, link_kind FROM links)"
_SUB = f"""{_GRAPH}, base AS (SELECT * FROM g WHERE b_type <> 'BuiltinFunction' AND link_role IN {_in(_ROLES)}), e AS (SELECT a, b FROM base UNION SELECT b, a FROM base),
w(node, depth) AS (SELECT '{FOCUS}', 0 UNION SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.node WHERE depth < 2),
m AS (SELECT node, split_part(node, '::', 1) AS type, min(depth) AS depth FROM w GROUP BY 1), f AS (SELECT * FROM m WHERE type IN {_in(_TYPES)} OR node = '{FOCUS}'),
ends AS (SELECT a AS node FROM g WHERE link_kind = 'usage' UNION ALL SELECT b FROM g WHERE link_kind = 'usage'), deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1),
r AS (SELECT f.*, coalesce(degree, 0) AS degree FROM f LEFT JOIN deg USING (node)), k AS (SELECT * FROM r ORDER BY depth, degree DESC, node LIMIT 60)"""
_TRACE_LEVEL = """, new{k} AS (SELECT DISTINCT b AS layout FROM t{p} WHERE link_role = 'navigates_to_layout' AND b NOT IN (SELECT node FROM x) {old}),
fld{k} AS (SELECT DISTINCT b AS field FROM t{p} WHERE b_type = 'Field' AND b NOT IN (SELECT node FROM x) {fields}),
own{k} AS (SELECT layout AS owner FROM new{k} UNION SELECT l.a FROM g l JOIN new{k} ON l.b = layout JOIN g s ON s.a = l.a JOIN fld{k} ON s.b = field WHERE l.link_role = 'parent_layout' AND s.link_role = 'displays_field' AND s.a_type = 'LayoutObject'),
c{k}(node, depth) AS (SELECT b, 0 FROM fires JOIN own{k} ON a = owner UNION SELECT calls.b, depth + 1 FROM c{k} JOIN calls ON calls.a = c{k}.node WHERE depth < 3 AND c{k}.node NOT IN (SELECT node FROM x)),
t{k} AS (SELECT DISTINCT u.* FROM uses u JOIN c{k} ON u.a = c{k}.node)"""
_TRACE = f"""{_GRAPH}, x AS (SELECT unnest([{", ".join(f"'{n}'" for n in LEFT_OUT if n != START)}]) AS node), calls AS (SELECT DISTINCT a, b FROM g WHERE link_role = 'calls_script'),
uses AS (SELECT DISTINCT a, b, b_type, link_role FROM g WHERE a_type = 'Script' AND link_kind = 'usage' AND link_role NOT IN ('calls_script', 'triggers_script') AND a NOT IN (SELECT node FROM x)),
fires AS (SELECT DISTINCT a, b FROM g WHERE link_role = 'triggers_script' AND link_subrole IS DISTINCT FROM 'button' AND (link_subrole IS NULL OR link_subrole NOT IN {_in(INTERACTION)})),
dn(node, depth) AS (SELECT '{START}', 0 UNION SELECT calls.b, depth + 1 FROM dn JOIN calls ON calls.a = dn.node WHERE depth < 3 AND dn.node NOT IN (SELECT node FROM x)),
up(node, depth) AS (SELECT '{START}', 0 UNION SELECT calls.a, depth + 1 FROM up JOIN calls ON calls.b = up.node WHERE depth < 2 AND up.node NOT IN (SELECT node FROM x)),
t0 AS (SELECT u.*, dn.depth FROM uses u JOIN dn ON u.a = dn.node)""" + _TRACE_LEVEL.format(k=1, p=0, old="", fields="") + _TRACE_LEVEL.format(k=2, p=1, old="AND b NOT IN (SELECT layout FROM new1)", fields="UNION SELECT field FROM fld1") + f""",
met AS (SELECT '{START}' AS node, 'start' AS role, 0 AS rank, 0 AS depth UNION ALL SELECT node, 'chain', 1, depth FROM dn UNION ALL SELECT node, 'chain', 1, -depth FROM up UNION ALL SELECT b, 'touched', 3, depth FROM t0
UNION ALL SELECT node, 'triggered', 2, 1 FROM c1 UNION ALL SELECT node, 'triggered', 2, 2 FROM c2 UNION ALL SELECT b, 'trigger_touched', 4, 1 FROM t1 UNION ALL SELECT b, 'trigger_touched', 4, 2 FROM t2)
SELECT node, role AS trace_role, CAST(depth AS BIGINT) AS trace_depth FROM met QUALIFY row_number() OVER (PARTITION BY node ORDER BY rank, abs(depth), depth < 0) = 1"""
_FIND = "SELECT '{t}' AS term, kind, key, CAST(min(rank) AS BIGINT) AS rank FROM (SELECT kind, key, CASE WHEN uuid = '{t}' THEN 1 WHEN CAST(key AS VARCHAR) = '{t}' THEN 2 WHEN lower(name) = '{t}' THEN 3 WHEN starts_with(lower(name), '{t}') THEN 4 WHEN contains(lower(name), '{t}') THEN 5 END AS rank FROM o UNION ALL SELECT 'Document', doc_id, 6 FROM documents WHERE contains(lower(text), '{t}')) WHERE rank IS NOT NULL GROUP BY kind, key"
ORACLE_SQL = {
    "subgraph_filtered": f"{_SUB} SELECT node, type, CAST(depth AS BIGINT) AS depth, degree, degree >= 20 AS is_hub, node = '{FOCUS}' AS is_focus, (SELECT count(*) FROM r) AS total_reachable FROM k",
    "subgraph_filtered_edges": f"{_SUB} SELECT DISTINCT a, b, link_role, link_subrole, link_kind FROM base WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k)",
    "depth_profile_out": f"{_GRAPH}, w(node, depth) AS (SELECT '{FOCUS}', 0 UNION SELECT g.b, depth + 1 FROM w JOIN g ON g.a = w.node WHERE depth < 5), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n_nodes, (SELECT max(depth) FROM m) <= 4 AS is_whole FROM m WHERE depth <= 4 GROUP BY 1",
    "trace_selective": _TRACE,
    "trace_entries": f"""{_GRAPH}, rt AS (SELECT a AS start, b AS seed FROM g WHERE link_role = 'triggers_script' AND a_type = 'Layout' UNION SELECT p.b, t.b FROM g t JOIN g p ON p.a = t.a AND p.link_role = 'parent_layout' WHERE t.link_role = 'triggers_script' AND t.a_type = 'LayoutObject'),
ib AS (SELECT DISTINCT b AS start, a AS seed FROM g WHERE link_role = 'navigates_to_layout' AND a_type = 'Script'),
s AS (SELECT start, seed, 'layout_runtime' AS entry FROM rt UNION SELECT start, seed, 'layout_inbound' FROM ib UNION SELECT start, seed, 'layout_full' FROM rt UNION SELECT start, seed, 'layout_full' FROM ib),
p AS (SELECT start, entry, count(*) AS n, array_to_string(list_slice(list_sort(list(seed)), 1, 5), ',') AS names FROM s GROUP BY ALL),
n AS (SELECT a AS start, a_type AS type FROM g UNION SELECT b, b_type FROM g)
SELECT n.start, e.entry, e.entry = 'layout_runtime' AS is_default, coalesce(p.n, 0) AS seed_count, coalesce(p.names, '') AS seeds_sample FROM n CROSS JOIN (VALUES ('layout_runtime'), ('layout_inbound'), ('layout_full')) e(entry) LEFT JOIN p ON p.start = n.start AND p.entry = e.entry WHERE type = 'Layout'
UNION ALL SELECT start, 'script', true, 1, start FROM n WHERE type = 'Script'""",
    "node_activity": """WITH st AS (SELECT o_orderkey AS object, o_orderpriority AS type, CAST(o_orderdate AS DATE) AS modified, o_orderkey % 37 AS saves, o_orderkey % 6 <> 0 AS known FROM orders WHERE o_orderdate IS NOT NULL),
an AS (SELECT coalesce(max(modified) FILTER (known), max(modified)) AS newest FROM st),
pr AS (SELECT object, (percent_rank() OVER (PARTITION BY type ORDER BY saves) + cume_dist() OVER (PARTITION BY type ORDER BY saves)) / 2 AS rank FROM st),
nd AS (SELECT st.*, pr.rank, date_diff('day', modified, (SELECT newest FROM an)) AS age FROM st JOIN pr USING (object)),
cl AS (SELECT *, CASE WHEN NOT known AND age <= 730 THEN 6 WHEN age <= 30 THEN 1 WHEN age <= 90 THEN 2 WHEN age <= 365 THEN 3 WHEN age <= 730 THEN 4 ELSE 5 END AS class FROM nd),
mb AS (SELECT c_custkey AS grp, o_orderkey AS object FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
SELECT grp, count(*) AS members, CAST(coalesce(min(class), 7) AS BIGINT) AS activity_class, CAST(max(modified) FILTER (known) AS VARCHAR) AS newest_change, min(age) FILTER (known) AS newest_age_days, count(*) FILTER (known AND class <= 2) AS active_90,
CAST(round(median(age) FILTER (known)) AS BIGINT) AS median_age_days, CAST(round(median(saves)) AS BIGINT) AS median_saves, count(class) AS stamped, count(*) FILTER (NOT known) AS undated,
CAST(CASE WHEN count(rank) = 0 THEN NULL WHEN round(avg(rank), 9) > 0.6 THEN 5 WHEN round(avg(rank), 9) > 0.5 THEN 4 WHEN round(avg(rank), 9) > 0.4 THEN 3 WHEN round(avg(rank), 9) > 0.3 THEN 2 ELSE 1 END AS BIGINT) AS saves_level
FROM mb LEFT JOIN cl USING (object) GROUP BY grp""",
    "occurrence_paths": """WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey >= 3 AND c_custkey % 7 <> 0), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w(node, path) AS (SELECT c_custkey, [c_custkey] FROM customer WHERE c_custkey % 23 = 0 UNION ALL SELECT e.b, list_append(path, e.b) FROM w JOIN e ON e.a = w.node WHERE NOT list_contains(path, e.b)),
r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(path), path[1], path) = 1)
SELECT node, path[1] AS anchor, len(path) - 1 AS depth, array_to_string(list_reverse(path), '>') AS path FROM r""",
    "search_objects": "WITH o AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {i} AS key, md5('{k}::' || {i}) AS uuid, {n} AS name FROM {t}" for k, t, i, n in (("Customer", "customer", "c_custkey", "c_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Part", "part", "p_partkey", "p_name"), ("Document", "documents", "doc_id", "source"))) + ") " + " UNION ALL ".join(_FIND.format(t=t) for t in ("12", _IDENTITY)),
    "url_families": "WITH p AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'Script (Import)' WHEN 1 THEN 'CustomFunction' ELSE 'Script' END AS source_type, page_id % 3 = 0 AS in_comment FROM pages) SELECT " + family_sql(FAMILIES, "regexp_matches") + " AS family, count(*) AS n, min(page_id) AS first_page FROM p GROUP BY 1",
    "overview_leaf": """WITH n AS (SELECT c_mktsegment AS segment, c_name AS label, count(o_orderkey) AS weight FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_name), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY weight DESC, label) AS r FROM n)
SELECT segment, CASE WHEN r <= 5 THEN label ELSE 'Rest' END AS label, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n_nodes, least(r, 6) AS place FROM r GROUP BY ALL""",
    "change_authors": """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS author, CASE WHEN o_orderkey % 11 = 0 THEN 'server' END AS kind, CAST(o_orderdate AS DATE) AS modified FROM orders), o AS (SELECT CAST(c_custkey AS VARCHAR) AS author, 'Team ' || c_nationkey AS alias, CASE WHEN c_custkey % 30 <> 0 THEN c_custkey % 20 = 0 END AS technical FROM customer WHERE c_custkey % 10 = 0)
SELECT coalesce(alias, s.author) AS name, coalesce(technical, kind IS NOT NULL) AS is_technical, count(*) AS n_changes, count(DISTINCT s.author) AS n_authors, CAST(max(modified) AS VARCHAR) AS last_change FROM s LEFT JOIN o ON s.author = o.author GROUP BY ALL""",
}
