"""Packing of tokenised documents into sequences of a fixed length, by a configuration linear program.

Each document's token ids end with an end id; only those longer than a sequence are cut, into full pieces behind a first one
that may be shorter. What is packed is the histogram of piece lengths, which has at most `capacity` entries however many
documents there are. A configuration is a multiset of lengths that fits a sequence; the covering program over all of them is
solved by multiplicative weights: the lengths' weights price configurations by dynamic programming over the capacity (an unbounded
knapsack), and change by factors with what the configurations leave and cover, until the solution is within `GAP` of the dual bound
or `ROUNDS` are over. It is rounded down, configurations that fill a sequence take one more while pieces last, and the same weights
fill up what is left, or best fit where that takes fewer sequences.

Every piece then finds its place alone: its rank among the pieces of its length (a rank within its task plus an offset for
the task) selects a slot of a configuration's copies. Null texts count as empty (one end id); very long texts make many pieces of a
sequence each; repeated rows are packed as often as they occur; null ids pass through; pieces of one length are interchangeable, so a
tie is settled by task and row order; an empty table gives an empty result; columns other than doc_id and text take no part.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, columns_of, small_batches, stash, table

#: Relative gap between the fractional solution and its dual bound at which rounds end; most rounds; rounds after which the sums begin anew, as weights have settled.
GAP, ROUNDS, SETTLED = 0.01, 64, (8, 24)
#: How fast a length's weight grows with the room that its configurations leave, and falls with what it has been covered beyond its turn; share of its demand for which a length may run ahead.
RAISE, LOWER, AHEAD = 0.6, 0.3, 0.25
#: Times that the program is solved again for what full sequences have left, and how near the bound a packing must be not to need it.
AGAIN, CLOSE = 1, 0.002
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long"


def knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """For every capacity up to the given one the most weight that a multiset of the lengths (ascending) has within it."""
    value = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if n := fits[c]:
            value[c] = max(value[c], (value[c - lengths[:n]] + weights[:n]).max())
    return value


def _filled(first: int, lengths: np.ndarray, weights: np.ndarray, value: np.ndarray, free: np.ndarray) -> tuple[Counter, int]:
    """A configuration with the length of index `first`, filled up by those of most weight of which free[i] are left, and its spare room."""
    chosen, room = Counter({first: 1}), len(value) - 1 - int(lengths[first])
    while room >= lengths[0]:
        n = int(np.searchsorted(lengths, room, "right"))
        gain = np.where(free[:n] > 0, weights[:n] + value[room - lengths[:n]], -1.0)
        for k, used in chosen.items():
            if k < n and used >= free[k]:
                gain[k] = -1.0
        k = int(gain.argmax())
        if gain[k] < 0:
            break
        chosen[k] += 1
        room -= int(lengths[k])
    return chosen, room


def fractional(demand: dict[int, int], capacity: int) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Configurations (lengths, longest first) and how often to use each, the lengths' weights, and a lower bound of all solutions' sums.

    In each round the weights price all capacities by the knapsack, and every length, longest first, is covered once by the best
    configurations that hold it and lengths whose turn isn't exceeded by `AHEAD`. Then weights change by factors: those grow whose
    configurations had room to spare, those fall that are ahead. Weights over the best configuration's are a solution of the dual program.
    """
    lengths = np.array(sorted(demand))
    need = np.array([demand[x] for x in lengths.tolist()], float)
    weights, raised, best = lengths / capacity, np.zeros(len(lengths)), 0.0
    covered, uses, turn = np.zeros(len(lengths)), defaultdict(float), 0
    for done in range(ROUNDS):
        if done in SETTLED:
            covered, uses, turn = np.zeros(len(lengths)), defaultdict(float), 0
        value = knapsack(lengths, weights, capacity)
        best = max(best, float(weights @ need) / value[capacity])
        turn += 1
        most, wasted, times = turn + AHEAD, np.zeros(len(lengths)), np.full(len(lengths), 1e-9)
        ahead = most - covered
        for i in range(len(lengths) - 1, -1, -1):
            while covered[i] < turn - 1e-9:
                chosen, room = _filled(i, lengths, weights, value, np.where(ahead > 1e-9, np.inf, 0))
                at, n = np.array(list(chosen)), np.array(list(chosen.values()), float)
                amount = float((np.where(at == i, turn - covered[at], ahead[at]) * need[at] / n).min())
                share = amount * n / need[at]
                covered[at] += share
                ahead[at] -= share
                times[at] += share
                wasted[at] += share * room / capacity
                uses[tuple(sorted((int(lengths[k]) for k in chosen.elements()), reverse=True))] += amount
        raised += wasted / times
        weights = lengths / capacity * np.exp(RAISE * raised - LOWER * (covered / turn - 1))
        if done >= SETTLED[-1] and sum(uses.values()) <= best * (1 + GAP) * turn:
            break
    return {k: v / turn for k, v in uses.items()}, weights, best


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Sequences (lengths) and how many of each when the longest pieces go first, each where least room is left; equal pieces and sequences move together."""
    room: list[Counter] = [Counter() for _ in range(capacity + 1)]
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            c = next((c for c in range(x, capacity) if room[c]), capacity)
            if c == capacity:
                own, fits = (), n
            else:
                own, there = next(iter(room[c].items()))
                fits = min(n, there)
                room[c][own] -= fits
                room[c] += Counter()
            full = (c // x) if c == capacity else 1
            if c == capacity and n >= full:
                room[c - full * x][(x,) * full] += n // full
                n -= n // full * full
            elif c == capacity:
                room[c - n * x][(x,) * n] += 1
                n = 0
            else:
                room[c - x][(*own, x)] += fits
                n -= fits
    return Counter({k: v for r in room for k, v in r.items() if v})


def filled_up(left: dict[int, int], prices: dict[int, float], capacity: int) -> Counter:
    """Sequences (lengths) and how many of each that use up what is left: the longest piece first, filled up by the most weight that is there."""
    left, out = {k: v for k, v in left.items() if v}, Counter()
    while left:
        lengths = np.array(sorted(left))
        weights = np.array([prices[x] for x in lengths.tolist()])
        value, free = knapsack(lengths, weights, capacity), np.array([left[x] for x in lengths.tolist()])
        gone = 0
        for i in range(len(lengths) - 1, -1, -1):
            while free[i] and gone <= len(lengths) // 8:
                chosen, _ = _filled(i, lengths, weights, value, free)
                at, n = np.array(list(chosen)), np.array(list(chosen.values()))
                times = int((free[at] // n).min())
                out[tuple(sorted((int(lengths[k]) for k in chosen.elements()), reverse=True))] += times
                free[at] -= times * n
                gone += int((free[at] == 0).sum())
        left = {x: int(v) for x, v in zip(lengths.tolist(), free.tolist(), strict=True) if v}
    return out


def _take(configurations: list[tuple[tuple[int, ...], int]], left: dict[int, int], out: Counter) -> None:
    """Uses configurations as often as asked for while their pieces last."""
    for lengths, wanted in configurations:
        counts = Counter(lengths)
        if times := min(wanted, *(left[x] // n for x, n in counts.items())):
            out[lengths] += times
            for x, n in counts.items():
                left[x] -= n * times


def _packed(demand: dict[int, int], capacity: int, again: int) -> Counter:
    uses, weights, bound = fractional(demand, capacity)
    ranked = sorted(uses.items(), key=lambda x: (-sum(x[0]), -x[1], x[0]))
    full = [x for x in ranked if sum(x[0]) == capacity]
    left, out = dict(demand), Counter()
    _take([(k, int(v)) for k, v in full], left, out)
    _take([(k, 1) for k, _ in full], left, out)
    left = {k: v for k, v in left.items() if v}
    if not left:
        return out
    prices = dict(zip(sorted(demand), weights.tolist(), strict=True))
    rests = [filled_up(left, prices, capacity), best_fit(left, capacity)]
    if again and out.total() + min(r.total() for r in rests) > bound * (1 + CLOSE) + 1:
        rests.append(_packed(left, capacity, again - 1))
    if out.total() + min(r.total() for r in rests) > bound * (1 + CLOSE) + 1:
        other, rest = Counter(), dict(demand)
        _take([(k, int(v)) for k, v in ranked], rest, other)
        other += filled_up(rest, prices, capacity)
        if other.total() < out.total() + min(r.total() for r in rests):
            return other
    return out + min(rests, key=lambda r: r.total())


def plan(demand: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (the lengths in a sequence, in order) and how many sequences have each; they use up the demand exactly.

    Configurations that fill a sequence are rounded down, then take one more while their pieces last. The rest is filled up by the same
    weights, or packed by best fit where that takes fewer sequences. Where the sum isn't within `CLOSE` of the dual bound, the program is
    solved again for the rest, and all configurations rounded down are tried too. Work depends on the histogram's entries, not on its counts.
    """
    left = {k: v for k, v in demand.items() if 0 < k < capacity and v > 0}
    out = Counter({(capacity,): demand[capacity]}) if demand.get(capacity) else Counter()
    return sorted((out + _packed(left, capacity, AGAIN) if left else out).items())


@functools.cache
def _encoding(path: str, ranks: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file, run by tiktoken from the same ranks, which is several times as fast; the special tokens are the file's."""
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens=special)


def tokenise(docs: DataFrame, files: tuple[str, str, str], end_id: int, capacity: int) -> DataFrame:
    """Pieces of docs: doc_id, piece, start, length, ids_crc32, the task and the rank among the task's pieces of that length."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, ranks = _encoding(*files), TaskContext.get().partitionId(), Counter()
        for batch in batches(it, 1 << 20):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoding.encode(text or "", allowed_special="all"), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : first if piece == 0 else start + capacity]
                    for column, x in zip(out, (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), ranks[len(own)]), strict=True):
                        column.append(x)
                    ranks[len(own)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out[:5], kinds, strict=True)), pa.array([part] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())], names=[f.split()[0] for f in _PIECES.split(", ")])

    return docs.mapInArrow(run, _PIECES)


def _slots(configurations: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, sequence of that rank, and offset of every slot, ranks ascending."""
    base, used = 0, Counter()
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for lengths, times in configurations:
        offset = 0
        for x in lengths:
            slots[x].append((used[x], base, offset))
            used[x] += times
            offset += x
        base += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for x, s in slots.items()}


def pack(docs: DataFrame, files: tuple[str, str, str], end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Places all pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    files: the tokenizers file, the rank file of the same vocabulary, and the pattern that cuts text before the merges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stash(tokenise(columns_of(docs, {"doc_id": "long", "text": "string"}), files, end_id, capacity))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("local")).alias("rank"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, at = slots.value[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), batch.column(3).cast(pa.int64()), batch.column(4), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", {"doc_id": "long", "text": "string"}), tokenizer_files())
