"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's tokens are its runs of non-space characters, cut after every `TOKEN` of them; its k-mers are `K` tokens in a row (all tokens
where there are fewer). Repeated k-mers are numbered, so that each occurrence is an element of its own. An element's hash
selects one of `SLOTS` slots and its order there; the `TUPLE` smallest elements of a slot, put back into text order and hashed
together, are the slot's value. Two texts share it where they have the same small elements in the same order, which edits
and moved passages destroy in proportion to their extent. A fingerprint lists slot and value of the slots in use as hex
digits; the likeness of two is the share of equal values among slots in use in either, 1 for two without any.

Equal texts have equal fingerprints; null counts as the empty text, whose fingerprint is the empty string. Each text's edited form takes
the first characters of the next document in its last quarter; next means ascending doc_id, null ids last, equal ids by
text, and the first document follows the last. Repeated rows each count. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, table

K, TUPLE, SLOTS, TOKEN = 3, 2, 64, 16
#: Low bits of a packed element hold its place in the text, the others its hash.
_PLACE = 28


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(x: Column) -> Column:
    return F.shiftright(x, _PLACE)


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hashed, _PLACE), _PLACE).bitwiseOR(place.cast("long"))


def elements(text: Column) -> Column:
    """Packed hashes and places of a text's k-mers, sorted: equal k-mers stand together in text order."""
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), F.lit(0))
    kmers = let(tokens, lambda t: F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - K, F.lit(0))), lambda i: _packed(F.xxhash64(*[F.get(t, i + j) for j in range(K)]), i))))
    return F.sort_array(kmers)


def numbered(packed: Column) -> Column:
    """Hashes of (k-mer, number of the occurrence); a k-mer's first occurrence keeps the k-mer's hash."""

    def renumber(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_hash(F.get(s, i)) != _hash(F.get(s, i - 1))))
        occurrence = lambda i, first: F.when(i == first, F.get(s, i)).otherwise(_packed(F.xxhash64(_hash(F.get(s, i)), i - first), F.get(s, i).bitwiseAND(F.lit((1 << _PLACE) - 1))))
        every = lambda at: F.flatten(F.transform(at, lambda first, j: F.transform(F.sequence(first, F.coalesce(F.get(at, j + 1), F.size(s)) - 1), lambda i: occurrence(i, first))))
        return let(starts, lambda at: F.when(F.size(at) == F.size(s), s).otherwise(F.array_sort(every(at))))

    return let(packed, lambda s: F.when(F.size(s) == 0, s).otherwise(renumber(s)))


def signature(packed: Column) -> Column:
    """Slots in use and their values, slot * 2**16 + value, from numbered elements in order."""
    slot = lambda x: F.shiftright(x, 64 - (SLOTS - 1).bit_length())
    in_text_order = lambda x: F.shiftleft(x.bitwiseAND(F.lit((1 << _PLACE) - 1)), 64 - _PLACE).bitwiseOR(F.shiftrightunsigned(x, _PLACE))
    value = lambda own: F.xxhash64(F.transform(F.array_sort(F.transform(own, in_text_order)), lambda x: F.shiftleft(x, _PLACE)))

    def of(s: Column) -> Column:
        least = F.filter(s, lambda x, i: (i < TUPLE) | (slot(F.get(s, i - TUPLE)) != slot(x)))
        begins = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (slot(F.get(m, i)) != slot(F.get(m, i - 1))))
        own = lambda m, i: F.filter(F.slice(m, i + 1, F.least(F.lit(TUPLE), F.size(m) - i)), lambda x: slot(x) == slot(F.get(m, i)))
        return let(least, lambda m: F.transform(begins(m), lambda i: ((slot(F.get(m, i)) + SLOTS // 2) * 65536 + value(own(m, i)).bitwiseAND(F.lit(65535))).cast("int")))

    return let(packed, lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(of(s)))


def fingerprint(signed: Column) -> Column:
    return F.array_join(F.transform(signed, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values among the slots in use in either signature."""
    slots = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of docs (doc_id, text).

    The rows are dealt to stretches of ascending ids, whose bounds are quantiles; only the first document of each stretch is
    needed by another stretch, and joined to it.
    """
    spark = docs.sparkSession
    docs = columns_of(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    stretches = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / stretches for i in range(stretches - 1)], 20 * stretches)).first()[0] or []
    at = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<bigint>"), lambda b: b < F.col("doc_id"))))
    docs = docs.withColumn("stretch", at)
    # the first document of each stretch, by the stretch before it
    starts = docs.groupBy("stretch").agg(F.min("doc_id").alias("first_id"))
    around = Window.orderBy("stretch")  # a row for each stretch
    linked = starts.select("first_id", F.coalesce(F.lag("stretch").over(around), F.max("stretch").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("stretch"))
    first_texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(linked), F.col("id").eqNullSafe(F.col("first_id"))).groupBy(linked["stretch"]).agg(F.min("text").alias("beyond"))
    ascending = Window.partitionBy("stretch").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    own = docs.withColumn("following", F.lead("text").over(ascending)).withColumn("signed", signature(numbered(elements(F.col("text")))))
    own = own.withColumn("signed_next", F.lead("signed").over(ascending)).join(first_texts, "stretch", "left")
    n = F.char_length("text")
    following = F.coalesce("following", "beyond")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
    own = own.select("doc_id", n.cast("long").alias("n_chars"), "signed", F.coalesce("signed_next", signature(numbered(elements(F.col("beyond"))))).alias("signed_next"), edited.alias("edited"))
    own = own.withColumn("signed_edited", signature(numbered(elements(F.col("edited")))))
    return own.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("signed")).alias("fingerprint"), fingerprint(F.col("signed_edited")).alias("edited_fingerprint"), likeness(F.col("signed"), F.col("signed_edited")).alias("near_edited"), likeness(F.col("signed"), F.col("signed_next")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"}))
