"""Language-model scores by stupid backoff, from count tables partitioned by hash.

A word's score given the one before it is the pair's count over the count of the first word, or, for pairs that no other document has,
`ALPHA` times the word's share of all words. Counts are those of all other documents (the document's own are taken off), so a text
isn't scored by itself; a word that no other document has counts `UNSEEN`. A document's score is the mean logarithm over its words; the first has no
word before it and takes its share. Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, known by 64-bit hashes.

Pairs are exploded to rows (pair, document, times) and dealt by the pair's hash to the partitions of the count table, where a window sums a
pair's rows and joins the sum to each of them; what a row is worth is summed by document. Two things keep this in bounds:

* Pairs that no second document has change no score. They are left out where a sketch of fixed size (two bits for each of 2**`SKETCH_BITS`
  hashes: seen once, seen twice) shows it; its errors let some of them through, and drop none that a second document has.
* Pairs that stand in a large part of the documents would meet in one partition: they are found first, counted by partial sums, and looked up
  where the documents are.

Word counts are broadcast while those above one fit `WORDS` rows (all other words have one); beyond that they are joined to the documents'
distinct words by hash.

Null and empty texts have no words and the score 0. Repeated rows count and are scored each; null ids pass through; of very long texts a batch
holds one; an empty table gives an empty result; columns other than doc_id and text take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, columns_of, discard, mix, release_all, small_batches, stash, table, text_buffer, word_hashes

ALPHA, UNSEEN = 0.4, 0.5
#: Most rows of word counts to broadcast; share of a batch's documents from which a pair is looked at as frequent.
WORDS, FREQUENT = 8 << 20, 1 / 8
#: Bits of the pairs' sketch, and of a chunk of it that travels in one row.
SKETCH_BITS, CHUNK_BITS = 28, 22


def _pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each text of a batch: text, first position, times; positions are those of the second word."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[1:] == text[:-1]) + 1
    keys = mix(words[inside - 1] * np.uint64(0xA0761D6478BD642F) + words[inside])
    order = np.lexsort((keys, text[inside]))
    k, t = keys[order], text[inside][order]
    start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if len(k) else np.zeros(0, np.int64)
    return k[start], t[start], np.stack([inside[order[start]], np.diff(np.r_[start, len(k)])]) if len(k) else np.zeros((2, 0), np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64, copy=False))


class _Seen:
    """Bits of the hashes that one text and that several texts have."""

    def __init__(self):
        self.once, self.twice = (np.zeros(1 << (SKETCH_BITS - 3), np.uint8) for _ in range(2))

    def add(self, keys: np.ndarray) -> None:
        """Keys of a batch, those of one text without repeats."""
        at, n = np.unique(keys >> np.uint64(64 - SKETCH_BITS), return_counts=True)
        if not len(at):
            return
        byte, bit = (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8)
        start = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        where = byte[start]
        any_, several = np.bitwise_or.reduceat(bit, start), np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), start)
        self.twice[where] |= several | (self.once[where] & any_)
        self.once[where] |= any_

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = 1 << (CHUNK_BITS - 3)
        for k in range(1 << (SKETCH_BITS - CHUNK_BITS)):
            once, twice = (x[k * size : (k + 1) * size] for x in (self.once, self.twice))
            if once.any():
                yield k, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def _shared(rows: DataFrame) -> bytes:
    """Bits of the hashes that several texts have, from the tasks' chunks (key: chunk, once, twice); its size is fixed."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["key", "twice"])
        for batch in it:
            for i in range(batch.num_rows):
                k, a, b = batch.column(0)[i].as_py(), *(np.frombuffer(zlib.decompress(batch.column(c)[i].as_py()), np.uint8) for c in (1, 2))
                if k != here:
                    if here is not None:
                        yield done()
                    here, once, twice = k, np.zeros_like(a), np.zeros_like(a)
                twice |= b | (once & a)
                once |= a
        if here is not None:
            yield done()

    out = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for r in rows.repartition("key").sortWithinPartitions("key").mapInArrow(add, "key long, twice binary").toLocalIterator():
        out[r["key"] * size : (r["key"] + 1) * size] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out.tobytes()


_COUNTED = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def count_words(docs: DataFrame) -> tuple[DataFrame, DataFrame, bytes]:
    """Word counts (word, n); the pairs that are frequent in some batch (key) with the documents of these batches that have them (n); the pairs' sketch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, seen = [], 0, _Seen()
        for batch in batches(it, 2 << 20):
            words, first = word_hashes(*text_buffer(batch.column(0)))
            waiting.append(words)
            held += len(words)
            if held > 1 << 23:
                yield _counted(waiting, "word")
                waiting, held = [], 0
            keys, _, _ = _pairs(words, first)
            seen.add(keys)
            found, n = np.unique(keys, return_counts=True)
            often = (n >= FREQUENT * batch.num_rows) & (n >= 32)
            if often.any():
                yield _rows(["pair"] * int(often.sum()), found[often].view(np.int64), n[often])
        if waiting:
            yield _counted(waiting, "word")
        for k, once, twice in seen.chunks():
            yield pa.RecordBatch.from_arrays([pa.array(["seen"]), pa.array([k], pa.int64()), pa.array([0], pa.int64()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], schema=_COUNTED)

    every = stash(docs.select("text").mapInArrow(run, "kind string, key long, n long, once binary, twice binary"))
    words = stash(every.where("kind = 'word'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")))
    pairs = stash(every.where("kind = 'pair'").groupBy("key").agg(F.sum("n").alias("n")))
    sketch = _shared(every.where("kind = 'seen'").select("key", "once", "twice"))
    discard(every)
    return words, pairs, sketch


def _rows(kind: list[str], key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), _long(key), _long(n), *[pa.nulls(len(kind), pa.binary())] * 2], schema=_COUNTED)


def _counted(waiting: list[np.ndarray], kind: str) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(waiting), return_counts=True)
    return _rows([kind] * len(found), found.view(np.int64), n)


def _count_frequent(docs: DataFrame, candidates: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact counts of the frequent pairs, sorted by key.

    Candidates are those found in a quarter of the least number of documents, so at most 256 times the mean number of pairs of a document
    reach the driver. Others are dealt by hash like any pair, which gives the same scores.
    """
    candidates = candidates.where(F.col("n") >= least / 4).select("key")
    keys = np.sort(np.array([r[0] for r in candidates.toLocalIterator()], np.int64).view(np.uint64))
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    wanted = docs.sparkSession.sparkContext.broadcast(keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches(it, 2 << 20):
            words, first = word_hashes(*text_buffer(batch.column(0)))
            k, _, (_, n) = _pairs(words, first)
            at = np.minimum(np.searchsorted(wanted.value, k), len(wanted.value) - 1)
            hit = wanted.value[at] == k
            total += np.bincount(at[hit], n[hit], minlength=len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([_long(wanted.value.view(np.int64)), _long(total)], names=["key", "n"])

    rows = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    keys, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


#: In this order what differs between rows, the key and the logarithm's bytes, lies side by side in a shuffled row and what is equal does too, so that it compresses as one run.
_EXPLODED = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("packed", pa.int64())])
#: What a row is, in the two lowest bits of `row`; fixed points of the pairs' logarithms (24 bits, as precise as a single float) and of sums.
PAIR, SUM, SIZE, ID = range(4)
LOG_STEPS, LOG_LEAST, SUM_STEPS = 1 << 17, -64, 1 << 20


def _explode(docs: DataFrame, shared: Broadcast, joined: bool) -> DataFrame:
    """Rows (row, key, packed): of a pair the times it stands in the document, and the logarithm that a match replaces, in the lowest 24 bits.

    A document has three more rows, under keys of their own: its sum if every word backed off, its number of words, and its id unless that is null.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, word_keys, word_counts, often_keys, often_counts, sketch = shared.value
        several = np.frombuffer(sketch, np.uint8)
        for batch in batches(it, 2 << 20):
            words, first = word_hashes(*text_buffer(batch.column(2)))
            size = np.diff(first)
            text = np.repeat(np.arange(batch.num_rows), size)
            # counts of the other documents: all occurrences less the text's own
            order = np.lexsort((words, text))
            w, t = words[order], text[order]
            start = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])]) if len(w) else np.zeros(0, np.int64)
            times = np.diff(np.r_[start, len(w)])
            if joined:
                given = batch.column(3)
                known = np.frombuffer(b"".join(x or b"" for x in given.to_pylist()), np.dtype([("w", ">u8"), ("n", ">i8")]))
                found, at_first = np.unique(known["w"].astype(np.uint64), return_index=True)
                counts = _look_up(found, known["n"][at_first].astype(np.int64), w[start], 1)
            else:
                counts = _look_up(word_keys, word_counts, w[start], 1)
            own = np.empty(len(words))
            own[order] = np.repeat(np.log(np.maximum(counts - times, UNSEEN)), times)
            backed = np.log(ALPHA) + own - np.log(np.maximum(total - size, 1))[text]
            base = np.bincount(text, backed, minlength=batch.num_rows)
            k, d, (at, n) = _pairs(words, first)
            excess = own[at - 1] + backed[at]
            if len(often_keys) and len(k):
                count = _look_up(often_keys, often_counts, k, 0)
                hit = count > 0
                match = hit & (count > n)
                base += np.bincount(d[match], n[match] * (np.log(count[match] - n[match]) - excess[match]), minlength=batch.num_rows)
                k, d, n, excess = k[~hit], d[~hit], n[~hit], excess[~hit]
            cell = k >> np.uint64(64 - SKETCH_BITS)
            kept = several[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 == 1
            k, d, n, excess = k[kept], d[kept], n[kept], excess[kept]
            row = batch.column(0).to_numpy(zero_copy_only=False) * 4
            known, ids = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False)), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            own_rows = np.r_[row + SUM, row + SIZE, row[known] + ID]
            logs = np.clip(np.rint((excess - LOG_LEAST) * LOG_STEPS).astype(np.int64), 0, (1 << 24) - 1)
            packed = np.r_[np.rint(base * SUM_STEPS).astype(np.int64), size, ids[known], (n << 24) | logs]
            keys = np.r_[mix(own_rows.astype(np.uint64)), k].view(np.int64)
            every = pa.RecordBatch.from_arrays([_long(np.r_[own_rows, row[d] + PAIR]), _long(keys), _long(packed)], schema=_EXPLODED)
            for i in range(0, every.num_rows, 1 << 16):
                yield every.slice(i, 1 << 16)

    return docs.mapInArrow(run, "row long, key long, packed long")


def _distinct_words(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Each row with the counts of its distinct words, joined by the word's hash: row, doc_id, text, counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2 << 20):
            words, first = word_hashes(*text_buffer(batch.column(1)))
            own = [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([_long(row), _long(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))], names=["row", "word"])

    found = docs.select("row", "text").mapInArrow(run, "row long, word long").join(counts, "word")
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    packed = found.groupBy("row").agg(F.collect_list(F.concat(digits("word"), digits("n"))).alias("c")).select("row", F.unhex(F.array_join("c", "")).alias("counts"))
    return docs.join(packed, "row", "left").select("row", "doc_id", "text", "counts")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and score (mean natural logarithm) of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = columns_of(docs, {"doc_id": "long", "text": "string"})
    words, candidates, sketch = count_words(docs)
    repeated = words.where("n > 1")
    total, rows = (x or 0 for x in words.agg(F.sum("n"), F.count_if(F.col("n") > 1)).first())
    often = _count_frequent(docs, candidates, docs.count() / 64)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    joined = rows > WORDS
    if joined:
        docs, table_ = stash(_distinct_words(stash(docs), repeated)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    else:
        arrow = repeated.select("word", "n").toArrow()
        keys, n = arrow.column(0).to_numpy().view(np.uint64), arrow.column(1).to_numpy()
        order = np.argsort(keys)
        table_ = keys[order], n[order]
    discard(words, candidates)
    shared = spark.sparkContext.broadcast((total, *table_, *often, sketch))
    exploded = _explode(docs, shared, joined)
    release_all(spark)  # lets go of the counts' shuffle files, which one collection leaves in part
    # the count table and its join with the rows, both in the partition of the pair
    kind = F.col("row").bitwiseAND(F.lit(3))
    n = F.when(kind == PAIR, F.shiftright("packed", 24))
    counted = exploded.withColumn("others", F.sum(n).over(Window.partitionBy("key")) - n).where((kind != PAIR) | (F.col("others") > 0))
    log = F.col("packed").bitwiseAND(F.lit((1 << 24) - 1)) / LOG_STEPS + LOG_LEAST
    worth = F.when(kind == PAIR, n * (F.ln("others") - log)).when(kind == SUM, F.col("packed") / SUM_STEPS)
    of = lambda k: F.max(F.when(kind == k, F.col("packed")))
    sums = counted.groupBy(F.shiftright("row", 2).alias("row")).agg(F.sum(worth).alias("sum"), of(ID).alias("doc_id"), of(SIZE).alias("n_words"))
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"}))
