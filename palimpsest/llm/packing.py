"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

A document's ids are cut into pieces of at most ``capacity``; only longer
documents are cut, and their first piece takes the remainder. Which pieces share
a sequence depends on lengths only, so packing works on the histogram of piece
lengths: at most ``capacity`` numbers, whatever the corpus size. The plan made
from it names, for the r-th piece of a length, its sequence and its place there;
it has a few rows per length. Pieces are numbered per length in parallel: each
task numbers its own, and a prefix sum over (length, task) counts adds the rest.

The reduction fixes sets that some optimal packing contains: pieces that fill a
sequence alone, pairs that fill it exactly, pieces that nothing else fits to, and
largest pieces whose best partners dominate every other choice. Best-fit
decreasing packs what remains.

Defined results: null text counts as empty (only the end id); repeated rows are
packed as often as they come; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common, tokens

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its number among the task's pieces of that length."""
    common.ship(docs.sparkSession)

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for ids, codes in tokens.encoded(batches, tokenizer_path, end_id):
            rows: list[tuple] = []
            for doc_id, code in zip(ids.to_pylist(), codes, strict=True):
                n = len(code) // 4
                view = memoryview(code)
                first = n if n <= capacity else n % capacity or capacity
                at, to, piece = 0, first, 0
                while at < n:
                    size = to - at
                    rows.append((doc_id, piece, at, size, zlib.crc32(view[4 * at : 4 * to]), part, seen[size]))
                    seen[size] += 1
                    at, to, piece = to, to + capacity, piece + 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.utf8("text").alias("text"))
    return given.mapInArrow(cut, PIECES)


class _Lengths:
    """Multiset of lengths: counts and the sorted lengths that are present."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, many: int = 1) -> None:
        self.n[length] -= many
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def least(self, many: int, without: int) -> list[int]:
        """The ``many`` smallest pieces when one of ``without`` is set aside."""
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(many - len(out), self.n[k] - (k == without))
            if len(out) == many:
                break
        return out

    def largest(self, most: int, without: int) -> int:
        """Largest length up to ``most`` when one of ``without`` is set aside; 0 if none."""
        i = bisect_left(self.keys, most + 1) - 1
        if i >= 0 and self.keys[i] == without and self.n[without] == 1:
            i -= 1
        return self.keys[i] if i >= 0 else 0

    def best_pair(self, most: int, without: int) -> tuple[int, int]:
        """Largest sum of two pieces up to ``most``, and their lengths' smaller one."""
        i, j, best, low = 0, len(self.keys) - 1, 0, 0
        have = lambda k: self.n[k] - (k == without)
        while i <= j:
            a, b = self.keys[i], self.keys[j]
            if a + b > most or not have(b):
                j -= 1
            elif not have(a) or (i == j and have(a) < 2):
                i += 1
            else:
                if a + b > best:
                    best, low = a + b, a
                i += 1
        return best, low


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing of a histogram of lengths: (lengths in a sequence, how many such sequences)."""
    left = _Lengths(counts)
    bins: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], many: int) -> None:
        bins.append((pattern, many))
        for length in set(pattern):
            left.take(length, pattern.count(length) * many)

    if left.n.get(capacity):
        fix((capacity,), left.n[capacity])
    # Exact pairs dominate every other use of either piece.
    for length in [k for k in left.keys if 2 * k > capacity]:
        if many := min(left.n[length], left.n.get(capacity - length, 0)):
            fix((length, capacity - length), many)
    if capacity % 2 == 0 and left.n.get(capacity // 2, 0) > 1:
        fix((capacity // 2,) * 2, left.n[capacity // 2] // 2)
    # Largest pieces whose best set dominates all others.
    for length in reversed(list(left.keys)):
        while left.n.get(length):
            room = capacity - length
            one = left.largest(room, length)
            if not one:
                fix((length,), left.n[length])
                continue
            least = left.least(3, length)
            pair = left.best_pair(room, length)[0] if len(least) > 1 and sum(least[:2]) <= room else 0
            if pair and len(least) == 3 and sum(least) <= room:
                break  # three or more may fit: no simple set dominates
            if pair > one:
                break
            many = left.n[length] // 2 if one == length else min(left.n[length], left.n[one])
            fix((length, one), max(1, many))
    # Best-fit decreasing, equal pieces and equal sequences together.
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], many: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, many))

    for length in sorted(left.n, reverse=True):
        items = left.n[length]
        while items:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                pattern, many = (), -(-items // (capacity // length))
            else:
                pattern, many = open_bins[rooms[i]].pop()
                if not open_bins[rooms[i]]:
                    del open_bins[rooms[i]]
                    rooms.pop(i)
            fits = (capacity - sum(pattern)) // length
            full = min(many, items // fits)
            rest = 0
            if full:
                put(pattern + (length,) * fits, full)
            items -= full * fits
            if items and full < many:
                rest = min(items, fits)
                put(pattern + (length,) * rest, 1)
                items -= rest
            unused = many - full - bool(rest)
            if unused and pattern:
                put(pattern, unused)
    return bins + [x for own in open_bins.values() for x in own]


class Places:
    """Sequence and offset of the r-th piece of a length, for arrays of pieces."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        spans: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, pieces a sequence
        offsets: list[list[int]] = []
        used: dict[int, int] = {}
        sequence = 0
        for pattern, many in bins:
            at, places = 0, {}
            for length in pattern:
                places.setdefault(length, []).append(at)
                at += length
            for length, own in places.items():
                spans.append((length, used.get(length, 0), sequence, len(own)))
                offsets.append(own)
                used[length] = used.get(length, 0) + many * len(own)
            sequence += many
        self.sequences = sequence
        order = sorted(range(len(spans)), key=lambda i: spans[i][:2])
        table = np.array([spans[i] for i in order], dtype=np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 44) + table[:, 1]
        self.first, self.sequence, self.per = table[:, 1], table[:, 2], table[:, 3]
        self.at = np.concatenate([[0], np.cumsum(self.per)])
        self.offset = np.array([x for i in order for x in offsets[i]], dtype=np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        k = rank - self.first[i]
        return self.sequence[i] + k // self.per[i], self.offset[self.at[i] + k % self.per[i]]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = common.save(cut_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            length = common.column(batch, "length").to_numpy(zero_copy_only=False)
            rank = common.column(batch, "rank").to_numpy(zero_copy_only=False)
            sequence, offset = places(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    if not histogram:
        return spark.createDataFrame([], schema)
    return ranked.mapInArrow(place, schema)

