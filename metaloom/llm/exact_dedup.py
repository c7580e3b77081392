"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes one run: its distinct text digests with the row to keep and the number of rows. The rounds are those of
a binomial tree: in each the nodes with numbers 2i and 2i + 1 exchange their runs, dealt by digest so that no task holds a whole
node; the runs are merged in digest order and equal digests collapse to their smallest row, after a check that their lengths and a second,
independent hash agree. Any number of rows of one text thus shrinks to one row for each partition before the first exchange
and to one for each node after every round.

Texts are equal when identical after each `[\\x20\\x09-\\x0D]+` became one space; null counts as empty. Of rows that
share a text, the one with the smallest doc_id stays; null ids count as largest, and of rows that share the id too the first by
partition and place stays. Only a batch of texts is in memory at a time, however long they are. An empty table gives an empty result. Columns other than doc_id and text take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns_of, small_batches, stash, table

#: Runs that are merged in a round.
FAN_IN = 2
_WHITE = b" \t\n\x0b\x0c\r"
_ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("second", pa.int64())])
_RUNS = "node long, digest binary, size long, second long, keep_id long, keep_part long, keep_row long, n long"


def normalised(data: bytes) -> bytes:
    """data with each run of white space as one space, also at the ends; bytes.split() takes exactly the six ASCII ones."""
    words = data.split()
    if not words:
        return data[:1] and b" "
    return b" " * (data[0] in _WHITE) + b" ".join(words) + b" " * (data[-1] in _WHITE)


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches(it):
        digest, size, second = [], [], []
        for text in batch.column(1).to_pylist():
            data = normalised((text or "").encode())
            digest.append(hashlib.sha256(data).digest())
            size.append(len(data))
            second.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(second, pa.int64())], schema=_ROWS)
        row += n


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges rows that arrive in order of (node, digest, keep_id with nulls last, keep_part, keep_row); the last run is held back."""
    held = None
    for batch in it:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        node, digest = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
        start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (digest[1:] != digest[:-1])])
        rows = np.diff(np.r_[start, len(node)])
        for c in (2, 3):  # sizes and second hashes
            values = batch.column(c).to_numpy(zero_copy_only=False)
            if (values != np.repeat(values[start], rows)).any():
                raise ValueError("two texts share a digest but not their length and second hash")
        n = np.add.reduceat(batch.column(7).to_numpy(zero_copy_only=False), start)
        first = batch.take(pa.array(start))
        merged = pa.RecordBatch.from_arrays([*(first.column(i) for i in range(7)), pa.array(n, pa.int64())], schema=batch.schema)
        held = merged.slice(merged.num_rows - 1)
        yield merged.slice(0, merged.num_rows - 1)
    if held is not None:
        yield held


def _in_order(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("node", "digest", F.col("keep_id").asc_nulls_last(), "keep_part", "keep_row")


def assign(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, part, row, keep_id, group_size, kept, digest, where part and row name the row."""
    small_batches(docs.sparkSession)
    rows = stash(columns_of(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_digests, "doc_id long, part long, row long, digest binary, size long, second long"))
    level = rows.select(F.col("part").alias("node"), "digest", "size", "second", F.col("doc_id").alias("keep_id"), F.col("part").alias("keep_part"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    # the leaves' runs: a file holds rows of few parts, and rows of one part may be spread over tasks, so the first exchange follows at once
    local = level = stash(_in_order(level).mapInArrow(_merge, _RUNS))
    widest = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level = level.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        level = _in_order(level.repartition("node", "digest")).mapInArrow(_merge, _RUNS)
        if widest <= FAN_IN:
            break
        widest = -(-widest // FAN_IN)
    final = level.select("digest", "keep_id", "keep_part", "keep_row", F.col("n").alias("group_size"))
    # a digest stands in a leaf once for each task that read it, and once in the root
    leaves = local.select("node", "digest").distinct().join(final, "digest").withColumnRenamed("node", "part")
    return rows.join(leaves, ["part", "digest"]).select(
        "doc_id", "part", "row", "keep_id", "group_size",
        ((F.col("part") == F.col("keep_part")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return assign(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies, all columns kept; of rows with the same id and equal texts one stays.

    The decisions are joined by id and digest, so that the texts are shuffled once.
    """
    key = lambda digest: F.concat_ws(":", digest, F.col("doc_id").cast("long").cast("string"))
    kept = assign(docs).where("kept").select(key(F.hex("digest")).alias("_key"))
    digest = F.upper(F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))
    own = docs.withColumn("_key", key(digest))
    return own.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"}))
