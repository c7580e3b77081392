"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of hashes of its k-word shingles. Two documents link when their sets' similarity reaches
numerator / denominator; what is returned are the classes that the links connect.

* Order. Shingles are ordered by how often they occur, rare ones first. A sketch of fixed size counts all shingles of all documents; its
  errors can make a prefix less selective, never wrong, since any order common to all documents gives the same links.
* Prefix. Sets that link share t = ceil(share * size) elements at least, so their first size - t + m elements share m, for every m up
  to t. A document picks the m with the lowest estimated cost - elements met in the lists of its prefix, plus comparisons with the
  documents met m times - so a prefix of common elements is lengthened and asks for more shared elements in return.
* Candidates. Elements that stand in one prefix only are dropped, and then documents with fewer elements left than any pair must share. Groups of near copies are settled in rounds that stay linear in the
  group: for each element the document with the most shared elements leads, every other document is compared with the leader it shares most
  elements with, and linked documents form components. Documents that are merely related to their leader (`RELATED`) form families.
* Families. Within a family a document is described by its difference from the family's lead, the elements of one but not the other.
  The difference of two documents is that of their differences, so documents that link, but not through the lead, share a known part of
  them; prefixes of the differences, rare elements first, find these pairs without listing a family's other pairs.
* Rest. Pairs of different families and components that share enough prefix elements are compared one by one, so no link that could join
  two components is missed.
* Comparison. Pairs are dealt by their leader, in parts of bounded size; texts are shuffled only of documents in pairs, for which a fixed
  bit map is broadcast, and a task holds one leader's set and one batch.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case. With fewer than k words the sequence is the one shingle; null and empty texts have none
and link with nothing. Rows with one doc_id are one document, which links if any of its texts does; null ids count their shingles and have no
component. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, batches, columns_of, components, discard, mix, shingle_hashes, small_batches, stash, table, text_buffer, word_hashes

#: Counters of the sketch, and how many travel in one row.
SKETCH_BITS, CHUNK_BITS = 21, 18
#: Least and most prefix elements that a document asks to share; the cost of a comparison in list elements; pairs of a leader in one part; rounds.
LEAST_MATCHES, MOST_MATCHES, COMPARE_COST, PART, ROUNDS = 8, 15, 4.0, 64, 2
#: Similarity from which a document belongs to its leader's family.
RELATED = 0.3
#: Occurrences from which an element's list is dealt to several tasks.
SPLIT = 1 << 16
_MAP_BITS = 20


def sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(*text_buffer(column))
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s * np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _counted(own: list[np.ndarray]) -> np.ndarray:
    at = np.concatenate(own) >> np.uint64(64 - SKETCH_BITS) if own else np.zeros(0, np.uint64)
    return np.bincount(at.astype(np.int64), minlength=1 << SKETCH_BITS)


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """One row a document (doc_id, n, d1, d2: size and digest of its set) and rows (chunk, counts) of the sketch of each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, waiting, held = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for batch in batches(it, 2 << 20):
            own = sets(batch.column(1), k)
            n = len(own)
            if n:
                waiting += own
                held += sum(map(len, own))
                if held > 1 << 21:
                    sketch += _counted(waiting)
                    waiting, held = [], 0
                d = np.array([_digest(s) for s in own], np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        sketch += _counted(waiting)
        for chunk, part in enumerate(np.split(sketch, 1 << (SKETCH_BITS - CHUNK_BITS))):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([chunk], pa.int32()), pa.array([zlib.compress(np.minimum(part, (1 << 32) - 1).astype("<u4").tobytes(), 1)], pa.binary())], schema=schema)

    return stash(docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, chunk int, counts binary"))


def _sketch(described: DataFrame) -> np.ndarray:
    """Sums of the tasks' counters; the result has the sketch's fixed size."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(total, (1 << 31) - 1).astype("<i4").tobytes()], pa.binary())], names=["chunk", "counts"])

    rows = described.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int32)
    for row in rows.toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["counts"], "<i4")
    return out.ravel()


def prefix(s: np.ndarray, estimate: np.ndarray, noise: float, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Elements of a set's prefix, for each the least number of matches whose prefix holds it, and the number chosen."""
    n = len(s)
    least = -(-numerator * n // denominator)
    order = np.lexsort((s, estimate))
    most = min(MOST_MATCHES, least)
    fewest = min(LEAST_MATCHES, least)
    base = n - least
    met = np.cumsum(np.maximum(estimate[order[: base + most]] - noise - 1, 0.0))
    matches = np.arange(fewest, most + 1)
    cost = met[base + matches - 1] * (1 + COMPARE_COST / matches) + matches
    chosen = int(cost.argmin()) + fewest
    size = base + chosen
    return s[order[:size]], np.maximum(np.arange(size) - base + 1, 1), chosen


def _postings(docs: DataFrame, k: int, ratio: tuple[int, int], sketch: Broadcast) -> DataFrame:
    """Prefix elements that stand in more than one document's prefix: token, doc_id, packed (size, level, matches)."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        noise = float(np.median(counts))
        for batch in batches(it, 2 << 20):
            seen, out = set(), []
            for doc_id, s in zip(batch.column(0).to_pylist(), sets(batch.column(1), k), strict=True):
                if doc_id is None or not len(s) or (key := (len(s), *_digest(s))) in seen:
                    continue  # a copy in the batch has another's set; it is known by its digest
                seen.add(key)
                at = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                tokens, level, chosen = prefix(s, at, noise, *ratio)
                parts = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // SPLIT + 1
                out.append((tokens.view(np.int64), np.full(len(tokens), doc_id), (len(s) << 8) | (level << 4) | chosen, doc_id % parts * (parts > 1) + (parts > 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["token", "doc_id", "packed", "part"])

    def shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops tokens of one document; rows come in order of (token, part, doc_id), and one row is held back. Part 0 holds all of a token."""
        held = None
        for batch in it:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            token, part = columns[0], columns[3]
            same = token[1:] == token[:-1]
            keep = part > 0
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None:
                keep[0] |= kept
            held, kept = [c[-1:] for c in columns], bool(keep[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns[:3]], names=["token", "doc_id", "packed"])
        if held is not None and kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:3]], names=["token", "doc_id", "packed"])

    dealt = docs.mapInArrow(emit, "token long, doc_id long, packed long, part long").repartition("token", "part").sortWithinPartitions("token", "part", "doc_id")
    return stash(dealt.mapInArrow(shared, "token long, doc_id long, packed long"))


def _with_leaders(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts dealt by leader for pairs (a, b), a leading: leader, part, role (0: the leader's own text, which comes first), doc_id, text."""
    spark = docs.sparkSession
    mask = (1 << _MAP_BITS) - 1
    bit = F.col("a").bitwiseAND(F.lit(mask))
    words = pairs.select("a").union(pairs.select("b")).groupBy(F.shiftright(bit, 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(a & 63 as int))")).alias("bits")).collect()  # 2**_MAP_BITS / 64 rows at most
    packed = np.zeros(1 << (_MAP_BITS - 6), "<i8")
    packed[[r["word"] for r in words]] = [r["bits"] for r in words]
    bits = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
    wanted = spark.sparkContext.broadcast(bits)

    def narrow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(wanted.value[at & mask]))

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    rows = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    # a document's text goes once to each part of each leader that it belongs to
    roles = rows.select(F.col("a").alias("leader"), "part", F.lit(1).alias("role"), F.col("b").alias("doc_id")).union(rows.select("a", "part", F.lit(0), "a").distinct())
    texts = docs.mapInArrow(narrow, "doc_id long, text string")
    return texts.join(roles, "doc_id").select("leader", "part", "role", "doc_id", "text").repartition("leader", "part").sortWithinPartitions("leader", "part", "role", "doc_id")


def _met(it: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """For each batch the leader, the document and both their sets; a document with several texts meets each of its leader's."""
    here, leads = None, []
    for batch in batches(it, 2 << 20):
        out = []
        for leader, part, role, doc_id, s in zip(*(batch.column(i).to_pylist() for i in range(4)), sets(batch.column(4), k), strict=True):
            if (leader, part) != here:
                here, leads = (leader, part), []
            if role == 0:
                leads.append(s)
            else:
                out += [(leader, doc_id, x, s) for x in leads if len(x) and len(s)]
        yield out


def _links(x: int, y: int, both: int, ratio: tuple[int, int]) -> bool:
    return ratio[1] * both >= ratio[0] * (x + y - both)


def _compare(docs: DataFrame, pairs: DataFrame, k: int, ratio: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b), a leading, that are related, and whether they link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _met(it, k):
            out = []
            for leader, doc_id, x, s in met:
                both = len(np.intersect1d(x, s, assume_unique=True))
                linked = _links(len(x), len(s), both, ratio)
                if linked or both >= RELATED * (len(x) + len(s) - both):
                    out.append((leader, doc_id, linked))
            a, b, linked = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return _with_leaders(docs, pairs).mapInArrow(run, "a long, b long, linked boolean")


def _differences(docs: DataFrame, pairs: DataFrame, k: int, ratio: tuple[int, int], sketch: Broadcast) -> DataFrame:
    """Prefixes of the differences between b and its family's lead a: a, element, b, n and d (sizes of b's set and difference), place, linked (to a).

    With s the smallest similarity, sets x and y that link differ in (1 - s) / (1 + s) * (|x| + |y|) elements at most. A document that doesn't
    link with the lead differs from it in more than that, which bounds what the differences of two documents share, and so their prefixes.
    """
    share = ratio[0] / ratio[1]
    most = (1 - share) / (1 + share)
    schema = pa.schema([("a", pa.int64()), ("element", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("place", pa.int64()), ("linked", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for met in _met(it, k):
            out = []
            for leader, doc_id, x, s in met:
                new, gone = np.setdiff1d(s, x, assume_unique=True), np.setdiff1d(x, s, assume_unique=True)
                d, linked = len(new) + len(gone), _links(len(x), len(s), len(s) - len(new), ratio)
                if not d:
                    continue
                widest = most * len(s) * (1 + 1 / share)
                need = (d + most * (share * len(s) + len(x)) - widest) / 2 if linked else d - widest
                size = d - max(1, int(np.ceil(need - 1e-6))) + 1
                order = [part[np.lexsort((part, counts[(part >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))] for part in (new, gone)]
                elements = np.concatenate(order)[: max(0, size)].view(np.int64)
                m = len(elements)
                out.append((np.full(m, leader), elements, np.full(m, doc_id), np.full(m, len(s)), np.full(m, d), np.arange(m), np.full(m, linked)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _with_leaders(docs, pairs).mapInArrow(run, "a long, element long, b long, n long, d long, place long, linked boolean")


def _similar(x: Column, y: Column, ratio: tuple[int, int]) -> Column:
    """Whether sets of these sizes can link."""
    return F.least(x, y) * ratio[1] >= F.greatest(x, y) * ratio[0]


def _classes(rows: DataFrame) -> DataFrame:
    """Documents (doc_id) whose set is another's, with the smallest document (first) of that set."""
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = apart(classes.where("copies > 1").drop("copies"))
    return stash(rows.join(classes, ["n", "d1", "d2"]).where("doc_id <> first").select("doc_id", "first").distinct())


def _candidates(postings: DataFrame, aliases: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Postings of documents that have as many elements left as any pair must share, copies under one document: token, doc, n, level, matches, weight."""
    # a partner's size is at least the share of the document's, and so bounds what it may ask for
    fewest = F.least(F.lit(LEAST_MATCHES), F.ceil(F.col("n") * ratio[0] / ratio[1] * ratio[0] / ratio[1] - 1e-9))
    weight = postings.groupBy("doc_id").agg(F.count("*").alias("weight"), F.max(fewest).alias("fewest"))
    postings = postings.join(weight.where("weight >= fewest").select("doc_id", "weight"), "doc_id").join(aliases, "doc_id", "left")
    postings = postings.groupBy("token", F.coalesce("first", "doc_id").alias("doc"))
    postings = postings.agg(F.max("n").alias("n"), F.max("packed").alias("packed"), F.max("weight").alias("weight"))
    level, matches = F.shiftright("packed", 4).bitwiseAND(F.lit(15)), F.col("packed").bitwiseAND(F.lit(15))
    return stash(postings.select("token", "doc", "n", level.alias("level"), matches.alias("matches"), "weight"))


def _led(open_: DataFrame, turn: int, ratio: tuple[int, int]) -> DataFrame:
    """For each document the leader (a) with which it (b) shares most elements; elements of one component are settled."""
    lead = F.max_by(F.struct("doc", "n", "component"), F.struct("weight", F.xxhash64("doc", F.lit(turn)), "doc")).alias("lead")
    leads = open_.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), lead)
    leads = apart(leads.where("low <> high").select("token", "lead"))
    led = open_.join(leads, "token").where((F.col("component") != F.col("lead.component")) & _similar(F.col("n"), F.col("lead.n"), ratio))
    led = led.groupBy(F.col("lead.doc").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("shared"), F.first("matches").alias("matches"))
    best = F.max_by("a", F.struct("shared", F.xxhash64("a"), "a")).alias("a")
    return stash(led.where("2 * shared >= matches").groupBy("b").agg(best).select("a", "b"))


def _within(docs: DataFrame, open_: DataFrame, k: int, ratio: tuple[int, int], sketch: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Links of families' leads (a, b), and pairs (a, b) inside families whose differences leave open whether they link."""
    numerator, denominator = ratio
    rank = F.max(F.struct("weight", F.xxhash64("doc"), "doc")).alias("rank")
    own = stash(open_.groupBy("family", "doc").agg(rank, F.min("component").alias("component")))
    lead = own.groupBy("family").agg(F.max_by("doc", "rank").alias("a"), F.min("component").alias("c"), F.max("component").alias("d"))
    lead = apart(lead.where("c <> d").select("family", "a"))
    followers = stash(own.join(lead, "family").where("doc <> a").select("a", F.col("doc").alias("b")))
    differences = _differences(docs, followers, k, ratio, sketch)
    differences = stash(differences.join(own.select(F.col("doc").alias("b"), "component"), "b"))
    discard(own, followers)
    columns = ("b", "n", "d", "place", "linked", "component")
    left, right = (differences.select("a", "element", *[F.col(c).alias(f"{c}{i}") for c in columns]) for i in (1, 2))
    least = F.greatest(F.lit(1), F.expr(f"div(d1 + d2 - n1 - n2, 2) + ceil({numerator} * (n1 + n2) / {numerator + denominator}D - 1e-9)"))
    close = left.join(right, ["a", "element"]).where(
        (F.col("b1") < F.col("b2")) & (F.col("component1") != F.col("component2")) & ~(F.col("linked1") & F.col("linked2"))
        & _similar(F.col("n1"), F.col("n2"), ratio) & (F.col("place1") <= F.col("d1") - least) & (F.col("place2") <= F.col("d2") - least)
    )
    return differences.where("linked").select("a", "b").distinct(), close.select(F.col("b1").alias("a"), F.col("b2").alias("b")).distinct()


def _between(rest: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different families and components that share as many prefix elements as the less demanding of them asks for."""
    columns = ("doc", "n", "level", "matches", "component", "family")
    left, right = (rest.select("token", *[F.col(c).alias(f"{c}{i}") for c in columns]) for i in (1, 2))
    need = F.least("matches1", "matches2")
    both = left.join(right, "token").where(
        (F.col("doc1") < F.col("doc2")) & (F.col("component1") != F.col("component2")) & (F.col("family1") != F.col("family2"))
        & _similar(F.col("n1"), F.col("n2"), ratio) & (F.col("level1") <= need) & (F.col("level2") <= need)
    )
    both = both.groupBy(F.col("doc1").alias("a"), F.col("doc2").alias("b")).agg(F.count("*").alias("shared"), F.first(need).alias("need"))
    return both.where("shared >= need").select("a", "b")


def link(docs: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    spark, ratio = docs.sparkSession, (numerator, denominator)
    small_batches(spark)
    docs = columns_of(docs, {"doc_id": "long", "text": "string"})
    described = _describe(docs, k)
    rows = described.where("chunk is null").select("doc_id", "n", "d1", "d2")
    aliases = _classes(rows)
    sketch = spark.sparkContext.broadcast(_sketch(described))
    listed = _postings(docs, k, ratio, sketch)
    postings = _candidates(listed.withColumn("n", F.shiftright("packed", 8)), aliases, ratio)
    discard(listed)
    # rounds: documents against leaders; what links forms components
    open_, met, members, rounds = postings.withColumn("component", F.col("doc")), None, None, []
    for turn in range(ROUNDS):
        pairs = _led(open_, turn, ratio)
        found = stash(_compare(docs, pairs, k, ratio))
        discard(pairs)
        rounds.append(found)
        met = found if met is None else met.union(found)
        worlds = met.select(F.lit(0).alias("world"), "a", "b").where("linked")
        if turn == ROUNDS - 1:  # the related ones form families
            worlds = worlds.union(met.select(F.lit(1), "a", "b"))
        members = stash(components(worlds, "world"))
        of = lambda world: members.where(F.col("world") == world)  # noqa: B023, E731
        open_ = postings.join(of(0).select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    families = of(1).select(F.col("node").alias("doc"), F.col("component").alias("family"))
    open_ = stash(open_.join(families, "doc", "left").withColumn("family", F.coalesce("family", "doc")))
    mixed = open_.groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("family").alias("f"), F.max("family").alias("g"))
    mixed = apart(mixed.where("c <> d").select("token", (F.col("f") != F.col("g")).alias("several")))
    rest = stash(open_.join(mixed, "token"))
    discard(postings, open_, *rounds)
    straight, within = _within(docs, rest, k, ratio, sketch)
    left_over = stash(within.union(_between(rest.where("several"), ratio)).distinct())
    last = stash(_compare(docs, left_over, k, ratio).where("linked"))
    links = of(0).select(F.col("node").alias("a"), F.col("component").alias("b")).union(last.select("a", "b")).union(straight)
    members = components(links.union(aliases.select("first", "doc_id")))
    sketch.destroy()
    discard(left_over)
    return rows.join(members, rows["doc_id"] == members["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs, all columns, without the documents that aren't the first of their component; documents without shingles stay."""
    gone = link(docs, k, numerator, denominator).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"}), 4, 85, 100)
