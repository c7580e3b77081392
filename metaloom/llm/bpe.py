"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern; each match is encoded by itself. The leaves of a match's tree are its byte
positions; a leaf holds the rank of the pair that its part forms with the next live part, an inner node the leftmost smallest
rank below it, so the root names the next merge. A merge joins two neighbours, kills the right one's leaf and renews the two
leaves whose pairs changed, each by a walk to the root: O(n log n) for a match of n bytes.

Short matches are encoded many at a time: trees of equal height are the rows of one array and every step merges one pair in
each. Long ones have a tree each. A bounded cache of encoded matches serves repeated words; it changes no result.

Nulls and empty texts have no ids and decode to empty bytes. Text is encoded as it stands: the strings of special tokens are
ordinary text. Decoding is the exact inverse for every text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import batches, small_batches, table

CACHE = 300_000
_SHORT = 64
_NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = size
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        self.pairs = pairs
        # an open-addressed table, for many look-ups at once
        self.bits = (len(pairs) * 4).bit_length()
        self.slot_keys, self.slot_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        todo_k, todo_r = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, self.probes = self._slot(todo_k), 0
        while len(todo_k):
            self.probes += 1
            free = self.slot_keys[slot] == -1
            self.slot_keys[slot[free]] = todo_k[free]
            rest = self.slot_keys[slot] != todo_k
            placed = ~rest
            self.slot_ranks[slot[placed]] = todo_r[placed]
            todo_k, todo_r, slot = todo_k[rest], todo_r[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.cache: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; a negative right id has none."""
        key = left * self.size + right
        slot = self._slot(key)
        found = np.where(self.slot_keys[slot] == key, self.slot_ranks[slot], _NONE)
        for p in range(1, self.probes):
            open_ = np.flatnonzero((found == _NONE) & (self.slot_keys[(slot + p - 1) & ((1 << self.bits) - 1)] != -1))
            if not len(open_):
                break
            at = (slot[open_] + p) & ((1 << self.bits) - 1)
            found[open_] = np.where(self.slot_keys[at] == key[open_], self.slot_ranks[at], _NONE)
        found[right < 0] = _NONE
        return found

    def _encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of up to width bytes (a power of two), as little-endian 32-bit integers."""
        rows = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        at = np.arange(width)
        ids = self.byte_ids[raw]
        ids[at >= lengths[:, None]] = -1
        after = np.broadcast_to(at + 1, (rows, width)).copy()
        before = np.broadcast_to(at - 1, (rows, width)).copy()
        # node i's children are 2i and 2i + 1; a value is rank * width + position, so the smallest is the leftmost of the least rank
        tree = np.full((rows, 2 * width), _NONE * width, np.int64)
        ranks = self._rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        tree[:, width : 2 * width - 1] = ranks * width + at[:-1]
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE * width)
        while len(live):
            best = tree[live, 1]
            i, rank = best % width, best // width
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = rank
            ids[live, j] = -2
            after[live, i] = k
            inside = k < lengths[live]
            before[live[inside], k[inside]] = i[inside]
            right = np.where(inside, ids[live, np.minimum(k, width - 1)], -1)
            new = self._rank_of(rank, right)
            self._renew(tree, live, j, np.full(len(live), _NONE, np.int64), width)
            self._renew(tree, live, i, new, width)
            h = before[live, i]
            has = h >= 0
            if has.any():
                rows_h, at_h = live[has], h[has]
                self._renew(tree, rows_h, at_h, self._rank_of(ids[rows_h, at_h], rank[has]), width)
            live = live[tree[live, 1] < _NONE * width]
        keep = ids >= 0
        packed, ends = ids[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _renew(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        """Point updates: new leaf values, then the smaller child at each node up to the root."""
        node = at + width
        tree[rows, node] = rank * width + at
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def _encode_long(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        pairs, size = self.pairs, self.size
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        none = _NONE * width
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pairs.get(ids[i] * size + ids[i + 1], _NONE) * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def renew(i: int, rank: int) -> None:
            node = i + width
            tree[node] = rank * width + i
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = rank, -1, k
            renew(j, _NONE)
            if k < n:
                before[k] = i
                renew(i, pairs.get(rank * size + ids[k], _NONE))
            else:
                renew(i, _NONE)
            h = before[i]
            if h >= 0:
                renew(h, pairs.get(ids[h] * size + rank, _NONE))
        return array("I", [x for x in ids if x >= 0]).tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct matches."""
        out, short = {}, {}
        for piece in pieces:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(data) > _SHORT:
                out[piece] = self._encode_long(data)
            else:
                short.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, found in short.items():
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                out.update(zip((p for p, _ in part), self._encode_many([d for _, d in part], width), strict=True))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t) for t in texts]
        missing = set().union(*cut).difference(self.cache) if cut else ()
        if missing:
            if len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
                missing = set().union(*cut)
            self.cache.update(self.encode_pieces(list(missing)))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@functools.cache
def _codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


_OUT = "doc_id long, n_tokens long, ids binary, decoded binary"


def round_trip(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encodes and decodes docs (doc_id, text): doc_id, n_tokens, ids (little-endian 32-bit) and decoded, or with digests their SHA-256 in hex as ids_sha256 and decoded_sha256.

    path is a rank file that every executor can open, as an installed tokenizer package's, or one given to SparkContext.addFile (then its name).
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else _OUT
    names = [f.split()[0] for f in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path if path.startswith("/") else SparkFiles.get(path), pattern)
        for batch in batches(it, 1 << 20):
            ids = codec.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            back = [codec.decode(x) for x in ids]
            both = [pa.array([hashlib.sha256(x).hexdigest() for x in col], pa.string()) for col in (ids, back)] if digests else [pa.array(col, pa.binary()) for col in (ids, back)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *both], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"})
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
