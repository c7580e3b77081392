"""Shared plumbing of the llm operators: inputs, written intermediate tables, Arrow text buffers, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch handed to Python; texts may be long, so batches hold few rows.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """The named columns of a table, cast to the given types; a column that is absent reads as null, others are left out."""
    return columns_of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), columns)


def columns_of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select([(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; it must be set, since no local folder can stand in for it on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/metaloom-{uuid.uuid4().hex}"


#: Seconds between collections that are asked for.
RELEASE_SECONDS = 2.0
_last: dict[str, float] = {}


def release(spark: SparkSession, now: bool = False) -> None:
    """Lets the driver drop the plans, broadcasts and shuffle files of finished steps, which Spark removes once a collection finds them unused."""
    if now or time.monotonic() - _last.get("release", 0.0) > RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        trim(spark)
        _last["release"] = time.monotonic()


def trim(spark: SparkSession) -> bool:
    """Gives the memory that the driver's JVM and Python have freed outside the heap back to the system; whether the JVM could.

    C's allocator keeps what compilers, compression and buffers have let go of, spread over an arena for each thread.
    """
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:  # the server's own class isn't open to callers, so its interface's method is called
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = command, "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Py4JError:  # not every JVM has the command
        return False
    return True


def release_all(spark: SparkSession) -> None:
    """As release, for all that is unused: files go in the background, and some shuffles are found unused by the second collection only."""
    for _ in range(3):
        release(spark, now=True)
        time.sleep(1)


#: Hadoop's checksummed local file system starts a chmod process for each file, and a process just started counts its parent's memory again; the raw one starts none.
#: Other file systems aren't touched. A folder is complete when write() has returned, so no marker file is needed.
_WRITE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Folders that this process has written and not discarded.
_written: list[str] = []


def stash(df: DataFrame) -> DataFrame:
    """Writes df below the shared folder and reads it back, which cuts its lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**_WRITE).parquet(path)
    _written.append(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of stashed tables; all that reads them must have been written before."""
    for df in frames:
        if (path := getattr(df, "_stashed", None)) in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at the end what was stashed inside, but for the tables that the caller has put into the list."""
    before, keep = set(_written), []
    yield keep
    for path in [p for p in _written if p not in before and p not in {k._stashed for k in keep}]:
        _written.remove(path)
        _delete(spark, path)


def apart(df: DataFrame) -> DataFrame:
    """df dealt anew before a join by the key that it was grouped by: both sides are then shuffled for the join alone, so that Spark may split a hot key's rows."""
    return df.hint("rebalance")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def batches(it: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits batches whose buffers are large, so that what is derived from one stays bounded."""
    for batch in it:
        pieces = max(1, min(batch.num_rows, -(-batch.nbytes // most_bytes)))
        step = -(-batch.num_rows // pieces) if batch.num_rows else 1
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


# Word hashes: a polynomial over random values of the bytes, modulo 2**64, taken from running sums over a whole batch.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, in order, and for each text the index of its first word (len + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[:n], out=sums[1:])
    hashes = mix(((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


_VALUES = _byte_values()


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, repeated ones too; with fewer words the whole sequence is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    count = len(words) - k + 1
    out = words[:count] ^ np.uint64(k)
    for j in range(1, k):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + words[j : j + count])
    return out


def components(edges: DataFrame, *worlds: str) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node reachable.

    worlds: columns whose values keep graphs apart, all settled at once. Edges with a null end and loops take no part; repeated
    edges count once; no edges give no rows. Large-star and small-star steps over written tables until nothing changes; a node's
    neighbours are only aggregated, never gathered, and a hub's rows may be split where they are joined.
    """
    edges = edges.where("a <> b").select(*worlds, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current, seen, key = stash(edges.distinct()), None, [*worlds, "u"]
    least = F.least("u", "m").alias("m")
    flipped = [*worlds, F.col("v").alias("u"), F.col("m").alias("v")]
    while (state := current.agg(F.count("*"), F.bit_xor(F.xxhash64(*key, "v")), F.bit_xor(F.xxhash64("v", *key))).first()) != seen:
        seen, before = state, current
        both = before.union(before.select(*worlds, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = apart(both.groupBy(*key).agg(F.min("v").alias("m")).select(*key, least))
        large = stash(both.where("v > u").join(lowest, key).select(*flipped).distinct())
        low = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = large.join(apart(low), key).where("v <> m").select(*flipped)
        current = stash(small.union(low.select(*key, F.col("m").alias("v"))).distinct())
        discard(before, large)
    ends = current.select(*worlds, F.col("v").alias("u"), "v").distinct()
    return current.union(ends).select(*worlds, F.col("u").alias("node"), F.col("v").alias("component"))
