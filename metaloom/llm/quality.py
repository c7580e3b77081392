"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text's terms are hashed byte trigrams, trigrams of character classes, and buckets of a few whole-text ratios. Term
frequencies are dampened, weighted by inverse document frequency and projected on the leading singular vectors of a bounded
sample of labelled texts (`SAMPLE` rows, the first by a hash of the id). The sample's vectors and labels are broadcast: their size
doesn't depend on the corpus. Every document is compared with all of them, exactly, a block of documents at a time; the
`NEIGHBOURS` most similar vote with their labels, weighted by a power of their similarity.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: no label of theirs is used. Null and empty texts have vectors too (of
their ratios) and are scored; a null doc_id is scored, not held out. Of several labels of a document the smallest counts; null labels are no
labels. Without any label all scores are 0.5. Of several texts of a chosen id the one with the smallest counts is learned. Similarities are compared
in steps of 2**-16, so that rounding doesn't decide; of neighbours that tie for the last place those with the smallest doc_id vote.
Very long texts are counted a megabyte or one text at a time. Repeated rows are scored each; an empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns_of, small_batches, table, text_buffer, word_hashes

SAMPLE, NEIGHBOURS, RANK, POWER, THRESHOLD = 3000, 25, 64, 4, 0.7
_HASHED, _CLASSES, _RATIOS, _STEPS = 1 << 11, 12, 9, 16
_SHAPES = _CLASSES**3
TERMS = _HASHED + _SHAPES + _RATIOS * _STEPS


def _classes() -> np.ndarray:
    """Character classes of bytes: 0 other control, 1 space, 2 line end, 3 lower, 4 upper, 5 digit, 6 part of a longer character, 7 sentence mark, 8 quote or bracket, 9 bar or slash, 10 connector, 11 other sign."""
    kind = np.full(256, 11, np.int64)
    kind[:32] = 0
    kind[ord(" ")] = 1
    kind[[9, 10, 13]] = 2
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1], kind[128:] = 3, 4, 5, 6
    for k, signs in ((7, ".,;:!?"), (8, "\"'()[]{}<>"), (9, "|/\\"), (10, "-_=+@")):
        kind[[ord(c) for c in signs]] = k
    return kind


_KIND = _classes()


def counts(column: pa.Array) -> np.ndarray:
    """Term counts of a column of texts, a row each."""
    raw, at = text_buffer(column)
    n, size = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n), size)
    out = np.zeros((n, TERMS), np.float32)
    kind = _KIND[raw]
    if len(raw) > 2:
        inside = doc[:-2] == doc[2:]
        b = raw.astype(np.int64)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        hashed = ((code * 0x9E3779B1) & 0xFFFFFFFF) >> 21
        out[:, :_HASHED] = np.bincount((doc[2:] * _HASHED + hashed)[inside], minlength=n * _HASHED).reshape(n, _HASHED)
        shape = (kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]
        out[:, _HASHED : _HASHED + _SHAPES] = np.bincount((doc[2:] * _SHAPES + shape)[inside], minlength=n * _SHAPES).reshape(n, _SHAPES)
    of_kind = np.bincount(doc * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    words, first = word_hashes(raw, at)
    number = np.diff(first)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], float)
    ratios = np.stack([of_kind[:, 4], of_kind[:, 5], of_kind[:, 11], of_kind[:, 7], of_kind[:, 2], of_kind[:, 9], distinct / np.maximum(number, 1), np.minimum(size / np.maximum(number, 1) / 20, 1), np.minimum(np.log2(number + 1) / 16, 1)])
    step = np.minimum((np.sqrt(ratios) * _STEPS).astype(np.int64), _STEPS - 1)
    base = _HASHED + _SHAPES
    for k in range(_RATIOS):
        out[np.arange(n), base + k * _STEPS + step[k]] = 1
    return out


def weighted(count: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of unit length for each of the three families of terms, so that long texts don't drown the ratios."""
    x = np.log1p(count) * weights
    for a, b in ((0, _HASHED), (_HASHED, _HASHED + _SHAPES), (_HASHED + _SHAPES, TERMS)):
        x[:, a:b] /= np.maximum(np.sqrt((x[:, a:b] ** 2).sum(1, keepdims=True)), 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Term weights, projection, and the sample's vectors and labels; what is gathered is `sample` rows at most."""
    labels = columns_of(labels, {"doc_id": "long", "quality": "int"}).where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    chosen = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = columns_of(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 20):
            rows = np.minimum(counts(batch.column(1)), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "counts"])

    rows = texts.mapInArrow(run, "doc_id long, quality int, counts binary").groupBy("doc_id").agg(F.min(F.struct("counts", "quality")).alias("row"))
    rows = [(r["doc_id"], r["row"]["quality"], r["row"]["counts"]) for r in rows.orderBy("doc_id").collect()]  # one for each chosen id
    if not rows:
        return None
    count = np.stack([np.frombuffer(r[2], "<u2") for r in rows]).astype(np.float32)
    weights = np.log((1 + len(rows)) / (1 + (count > 0).sum(0))).astype(np.float32) + 0.1
    x = weighted(count, weights)
    # leading right singular vectors by subspace iteration
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((TERMS, min(RANK, len(rows)))).astype(np.float32))[0]
    for _ in range(12):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return {"weights": weights, "basis": basis, "vectors": _unit(x @ basis), "labels": np.array([r[1] for r in rows], np.float32)}


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    """The weighted share of label 1 among each text's nearest neighbours, over exact cosine products with all labelled vectors."""
    vectors = _unit(weighted(counts(column), model["weights"]) @ model["basis"])
    near = np.round(vectors @ model["vectors"].T * 65536).astype(np.int64)
    k = min(NEIGHBOURS, near.shape[1])
    # the sample is in order of ids: a smaller place wins a tie
    near = near * near.shape[1] + np.arange(near.shape[1])[::-1]
    best = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
    near = near // near.shape[1] / 65536
    weight = np.maximum(np.take_along_axis(near, best, 1), 0.0) ** POWER + 1e-9
    return np.clip((weight * model["labels"][best]).sum(1) / weight.sum(1), 0.0, 1.0).astype(np.float64)


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text)."""
    shared = _share(docs, model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), shared))], names=["doc_id", "score"])

    scored = columns_of(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose score reaches the threshold; without a model all of them."""
    if model is None:
        return docs
    shared, text = _share(docs, model), docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 20):
            yield batch.filter(pa.array(_scores(batch.column(text).cast(pa.string()), shared) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _share(docs: DataFrame, model: dict[str, np.ndarray] | None) -> Broadcast:
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model)


def _scores(column: pa.Array, model: Broadcast) -> np.ndarray:
    return np.full(len(column), 0.5) if model.value is None else scores(column, model.value)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"})
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
