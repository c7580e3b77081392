"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page id, so each task holds a stretch of them and writes it to files of its own, one gzip member
for each record, rolling to the next file when the compressed size reaches a limit. Headers and digests are made anew from the
payload. A file is written under a temporary name that holds the task attempt, then renamed; the task reports it, and the
driver commits the whole with a manifest, itself renamed into place. Names, dates, record ids and bytes depend on the input
and the partitioning only, so a repeated or speculative task replaces a file by the same bytes.

Of records with equal payloads of at least `least` bytes the one with the smallest page id is a response and the others are
revisits that name it; smaller payloads are always responses. Null html counts as empty; null urls get a URN from the page id;
null page ids sort last and read back as null. Of rows repeated with the same id and payload the first is the response. An empty table
gives no record. Columns other than page_id, url and html take no part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, batches, columns_of, shared_dir, small_batches, stash, table

LEAST, ROLL_BYTES, DATE = 100, 256 << 20, "2000-01-01T00:00:00Z"
#: Most tasks that read archives; each reads its files one after the other.
READERS = 10_000
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-records")
_MANIFEST = "file string, records long, compressed_bytes long, sha256 string"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that all executors share; pyarrow's file systems are those of Python tasks."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _replace(fs: pa.fs.FileSystem, source: str, target: str) -> None:
    """Renames a file; where the file system refuses a name that exists, the older file, of the same bytes, goes first."""
    try:
        fs.move(source, target)
    except OSError:
        if fs.get_file_info(target).type != pa.fs.FileType.File:
            raise
        fs.delete_file(target)
        fs.move(source, target)


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Revisits only: page_id, digest, and the smallest page id of that payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least)
    rows = stash(rows.select("page_id", "digest"))
    groups = apart(rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(groups, "digest").where("page_id <> refers_to or (page_id is null and refers_to is not null)").select("page_id", "digest", "refers_to").distinct()


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    uri = quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {uri} {digest} {revisit}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)),
        ("X-Has-URL", int(url is not None)), ("X-Refers-To-Page-ID", refers_to if revisit else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without time stamp or name."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """A file under its temporary name, until it is closed."""

    def __init__(self, fs: pa.fs.FileSystem, root: str, name: str, attempt: int):
        self.fs, self.root, self.name, self.temporary = fs, root, name, f"{root}/_temporary/{name}.{attempt}"
        self.out, self.bytes, self.records, self.sum = fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.write(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", 0)]) + b"\r\n\r\n")
        self.records = 0

    def write(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> list:
        self.out.close()
        _replace(self.fs, self.temporary, f"{self.root}/{self.name}")
        return [self.name, self.records, self.bytes, self.sum.hexdigest()]


def write(pages: DataFrame, uri: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) below uri and commits them; returns the manifest (file, records, compressed_bytes, sha256)."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = columns_of(pages, {"page_id": "long", "url": "string", "html": "string"})
    fs, root = _open(uri)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    # a page's revisit, if it has one, comes before the page itself, so that the payloads are shuffled once
    plan = decide(pages, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(0).alias("kind"))
    both = plan.unionByName(pages.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")))
    order = [F.col("page_id").asc_nulls_last(), "kind", "digest"]
    dealt = both.repartitionByRange(F.col("page_id").asc_nulls_last()).sortWithinPartitions(*order, "url", F.xxhash64("html"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to = _open(uri)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        shard, done, here, revisits, seen = None, [], object(), {}, set()
        for batch in batches(it):
            for page_id, url, html, digest, refers_to, kind in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if page_id != here:
                    here, revisits, seen = page_id, {}, set()
                if kind == 0:
                    revisits[digest] = refers_to
                    continue
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                again = digest in seen
                if shard and shard.bytes >= roll_bytes:
                    done.append(shard.close())
                    shard = None
                shard = shard or _Shard(own, to, f"pages-{part:06d}-{len(done):06d}.warc.gz", attempt)
                shard.write(_record(page_id, url, payload, digest, revisits.get(digest, page_id), digest in revisits or again))
                if len(payload) >= least:
                    seen.add(digest)
        if shard:
            done.append(shard.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "records", "compressed_bytes", "sha256"])

    manifest = stash(dealt.mapInArrow(run, _MANIFEST))
    _commit(manifest, fs, root)
    return manifest


def _commit(manifest: DataFrame, fs: pa.fs.FileSystem, root: str) -> None:
    """Manifest under a temporary name, one line a file, then its rename; without it the folder doesn't count as written."""
    with fs.open_output_stream(f"{root}/_temporary/MANIFEST") as out:
        for row in manifest.orderBy("file").toLocalIterator():
            out.write((json.dumps(row.asDict(), sort_keys=True) + "\n").encode())
    _replace(fs, f"{root}/_temporary/MANIFEST", f"{root}/MANIFEST")
    fs.delete_dir(f"{root}/_temporary")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file of gzip members, one in memory at a time."""
    rest, z, text = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        text.append(z.decompress(data))
        rest = z.unused_data
        if not z.eof:
            continue
        z, record, text = zlib.decompressobj(31), b"".join(text), []
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def read(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """Records of the committed files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits).

    Block and payload digests are computed again and must be those of the headers.
    """
    small_batches(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(uri)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in it:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in _records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:") or not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a record of {name} doesn't match its digests")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        rows.append((number("X-Page-ID"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), fields["WARC-Target-URI"] if fields["X-Has-URL"] == "1" else None, payload))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a number of partitions is given, so that adaptive execution doesn't merge these few but large rows into one task
    files = max(1, min(manifest.count(), READERS))
    return manifest.select("file").repartition(files, "file").mapInArrow(run, _READ)


ORACLE = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM m
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark)
    manifest = write(table(spark, sf_dir, "pages", {"page_id": "long", "url": "string", "html": "string"}), uri)
    return read(spark, uri, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
