"""Fuzzy line deduplication: MinHash banding, exact Jaccard, distributed union-find.

A line is compared in lower case without outer white space. Equal lines are one
node from the start. A node's signature holds ``BANDS`` x ``ROWS`` minima over
its shingles of ``SHINGLE`` characters; a pair of Jaccard similarity 0.8 misses
every band with a probability of 6e-4, a pair of 0.85 with one of 2e-5.

Nodes that share a band key are a group. Tasks reduce a group before the
exchange: members are paired with the group's smallest member only, never with
each other. Texts of these pairs are compared exactly, and union-find joins
those of at least ``SIMILARITY``. Groups that still hold members of several
components are then looked at again, member against member of another
component, in units of at most 2 * ``GROUP`` members, so that a link between
two members which both differ from the smallest one is not lost. Members of
groups with very many components, as lines made from one template are, first go into
groups of those that share one of their rarest shingles: two lines of the
similarity must, so lines that only share the template are not compared.

Of each component the line that comes first, by (doc_id, line number), is kept;
all others are removed. Blank lines are never removed.

Defined results: null text counts as empty; a row without doc_id is returned
unchanged and takes no part; rows that share a doc_id share the decision on a
line number, so repeated rows stay equal; an empty table gives no rows; other
columns pass through ``apply`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common
from palimpsest.llm.components import UnionFind, connected

SHINGLE = 7
ROWS = 4
BANDS = 14
SIMILARITY = 0.8
#: Fills up short lines; no text holds a surrogate.
PAD = "\udfff"
#: Members of a group that are compared with each other at once.
GROUP = 256
#: Blocks of GROUP members outside the largest component from which on a group is split by rare shingles.
MANY = 16
#: Characters of lines whose shingles a task holds, and shingles that one comparison of a group takes at a time.
HELD = 1 << 20
SLICE = 1 << 21
#: The order of shingles in large groups comes from SAMPLE lines under LONG characters, and names ORDERED shingles at most.
SAMPLE = 2_000
LONG = 4_000
ORDERED = 200_000
#: Shingles that are hashed at once: what a core's cache holds.
STEP = 1 << 15

_RNG = np.random.default_rng(20240117)
_A = (_RNG.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_MUL = 0x9E3779B97F4A7C15


def normal(line: str) -> str:
    return line.lower().strip()


def shingles(line: str) -> set[str]:
    """Distinct runs of SHINGLE characters; a shorter line is one shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Values by their rank among the distinct ones, and how many those are."""
    seen, rank = np.unique(values, return_inverse=True)
    return rank.astype(np.uint64), len(seen)


def shingle_ids(lines: list[str]) -> list[np.ndarray]:
    """Distinct shingles of each line as sorted numbers, one number for one shingle throughout the lines."""
    if not lines:
        return []
    joined = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, PAD) for x in lines)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    there = np.zeros(0x110000, dtype=bool)
    there[codes] = True
    letters = int(there.sum())
    c = (np.cumsum(there) - 1).astype(np.uint64)[codes]
    if letters <= 1 << 9:
        # Seven characters of nine bits are one number.
        two = c[:-1] << np.uint64(9) | c[1:]
        four = two[:-2] << np.uint64(18) | two[2:]
        seven = four[:-3] << np.uint64(27) | two[4 : len(four) + 1] << np.uint64(9) | c[6 : 6 + len(four) - 3]
    else:
        # Two runs of four characters that overlap in one, each by its rank.
        two = c[:-1] * np.uint64(letters) + c[1:]
        two = _ranked(two)[0]
        four, n = _ranked(two[:-2] << np.uint64(32) | two[2:])
        seven = four[:-3] * np.uint64(n) + four[3:]
    out, at = [], 0
    for x in lines:
        size = max(len(x), SHINGLE)
        own = np.sort(seven[at : at + size - SHINGLE + 1])
        fresh = np.ones(len(own), dtype=bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        out.append(own[fresh])
        at += size
    return out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct ones share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _wide_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle, first shingle of each line)."""
    joined = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, PAD) for x in lines)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([max(len(x), SHINGLE) for x in lines], dtype=np.int64)
    c = _mix(codes + np.uint64(1))
    power = lambda n: np.uint64(pow(_MUL, n, 1 << 64))
    two = c[:-1] * power(1) + c[1:]
    four = two[:-2] * power(2) + two[2:]
    seven = four[:-3] * power(3) + two[4 : len(four) + 1] * power(1) + c[6 : 6 + len(four) - 3]
    ends = np.cumsum(sizes)
    good = np.ones(len(seven), dtype=bool)
    for k in range(1, SHINGLE):
        at = ends - k
        good[at[at < len(good)]] = False
    counts = sizes - SHINGLE + 1
    return _mix(seven[good]), np.concatenate([[0], np.cumsum(counts)[:-1]])


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash of every shingle, first shingle of each line)."""
    h, first = _wide_hashes(lines)
    return (h >> np.uint64(32)).astype(np.uint32), first


def _steps(lines: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of lines with about ``most`` shingles."""
    ends = np.cumsum([max(len(x) - SHINGLE + 1, 1) for x in lines])
    at, before = 0, 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at, before = to, int(ends[to - 1])


def signatures(lines: list[str]) -> np.ndarray:
    """(line, minimum) for ROWS * BANDS hash functions."""
    out = np.empty((ROWS * BANDS, len(lines)), np.uint32)
    for at, to in _steps(lines, STEP):
        h, first = _shingle_hashes(lines[at:to])
        buf = np.empty(len(h), np.uint32)
        for j in range(ROWS * BANDS):
            np.multiply(h, _A[j], out=buf)
            np.add(buf, _B[j], out=buf)
            np.minimum.reduceat(buf, first, out=out[j, at:to])
    return out.T


def band_keys(lines: list[str]) -> np.ndarray:
    """(line, band) 64-bit keys."""
    s = signatures(lines).astype(np.uint64).reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(_MUL) + s[:, :, r])
    return key


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, line, doc_id, pos: every distinct line that is not blank, with its first place.

    Lines travel to the task of their hash in compressed blocks, once per block.
    Ids are smaller the more often a line comes: of a group of near copies the
    original, which most others are near, tends to have the smallest.
    """
    n = common.parts_for(docs.select("doc_id", "text"))

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for ids, text in common.rows_of(batches, ("doc_id", "text"), "text", 16 << 20):
            first: dict[str, tuple[int, int]] = {}
            times: dict[str, int] = {}
            for doc_id, t in zip(ids.to_pylist(), text.to_pylist(), strict=True):
                for pos, line in enumerate(t.split("\n")):
                    line = normal(line)
                    if line:
                        times[line] = times.get(line, 0) + 1
                        if (place := (doc_id, pos)) < first.get(line, (1 << 63, 0)):
                            first[line] = place
            dealt: dict[int, list[tuple[bytes, tuple[int, int, int]]]] = {}
            for line, place in first.items():
                raw = line.encode("utf-8", "surrogatepass")
                dealt.setdefault(xxhash.xxh32_intdigest(raw) % n, []).append((raw, (*place, times[line])))
            rows = [(k, pack.compress(b"\n".join(x for x, _ in own)), pack.compress(struct.pack(f"<{3 * len(own)}q", *[v for _, p in own for v in p]))) for k, own in dealt.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "lines", "places"])

    def gather(batches):
        part = TaskContext.get().partitionId()
        first: dict[bytes, tuple[int, int, int]] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lines, places in zip(common.column(batch, "lines").to_pylist(), common.column(batch, "places").to_pylist(), strict=True):
                flat = np.frombuffer(unpack.decompress(places), np.int64).reshape(-1, 3).tolist()
                for line, (doc_id, pos, times) in zip(unpack.decompress(lines).split(b"\n"), flat, strict=True):
                    if held := first.get(line):
                        first[line] = (*min(held[:2], (doc_id, pos)), held[2] + times)
                    else:
                        first[line] = doc_id, pos, times
        own = list(first.items())
        for i in range(0, len(own), 20_000):
            some = own[i : i + 20_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(i, i + len(some)) + (part << 36) + np.array([max(0, 64 - p[2].bit_length()) << 56 for _, p in some]), pa.int64()),
                    pa.array([x.decode("utf-8", "surrogatepass") for x, _ in some], pa.string()),
                    pa.array([p[0] for _, p in some], pa.int64()),
                    pa.array([p[1] for _, p in some], pa.int64()),
                ],
                names=["id", "line", "doc_id", "pos"],
            )

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.utf8("text").alias("text")).where("doc_id is not null")
    sent = given.mapInArrow(send, "bucket int, lines binary, places binary")
    return common.save(sent.repartitionById(n, F.col("bucket")).mapInArrow(gather, "id bigint, line string, doc_id bigint, pos bigint"), "lines")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest id of each key (keys, ids), and stars (keys, centres, others) to the rest."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    centre = ids[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
    rest = ~head & (centre != ids)
    return keys[head], ids[head], keys[rest], centre[rest], ids[rest]


def candidate_stars(lines: DataFrame) -> DataFrame:
    """key, a, b: for every band key that several nodes share, links from its smallest nodes to the others.

    A task sends one entry per key; entries travel as packed arrays.
    """
    n = common.parts_for(lines)

    def send(batches):
        for ids, line in common.rows_of(batches, ("id", "line"), "line", 16 << 20):
            names = ids.to_numpy()
            keys = band_keys(line.to_pylist())
            flat, who = keys.ravel(), np.repeat(names, BANDS)
            head_keys, head_ids, k, a, b = _stars(flat, who)
            bucket = (head_keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            rows = []
            for i in range(n):
                own = order[cuts[i] : cuts[i + 1]]
                if len(own):
                    rows.append((i, head_keys[own].tobytes() + head_ids[own].tobytes(), b""))
            # Stars found here need no more work; they travel with any bucket.
            rows.append((xxhash.xxh32_intdigest(names[:1].tobytes()) % n, b"", k.tobytes() + a.tobytes() + b.tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "heads", "stars"])

    def batch_of(k, a, b):
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    def gather(batches):
        keys, ids = [], []
        for batch in batches:
            for heads, stars in zip(common.column(batch, "heads").to_pylist(), common.column(batch, "stars").to_pylist(), strict=True):
                h = np.frombuffer(heads, np.int64)
                keys.append(h[: len(h) // 2].view(np.uint64))
                ids.append(h[len(h) // 2 :])
                s = np.frombuffer(stars, np.int64)
                third = len(s) // 3
                if third:
                    yield batch_of(s[:third].view(np.uint64), s[third : 2 * third], s[2 * third :])
        if keys:
            _, _, k, a, b = _stars(np.concatenate(keys), np.concatenate(ids))
            yield batch_of(k, a, b)

    sent = lines.select("id", "line").mapInArrow(send, "bucket int, heads binary, stars binary")
    return common.save(sent.repartitionById(n, F.col("bucket")).mapInArrow(gather, "key bigint, a bigint, b bigint"), "stars")


def _verify(similarity: float):
    """Pairs of at least the similarity; rows may repeat a line, whose shingles are then cut once."""

    def run(batches):
        for batch in batches:
            ids = [common.column(batch, c).to_pylist() for c in ("a", "b")]
            text = [common.column(batch, c).to_pylist() for c in ("line_a", "line_b")]
            for at, to in _steps(text[1], HELD):
                place = {x: k for k, x in enumerate(dict.fromkeys(text[0][at:to] + text[1][at:to]))}
                sets = shingle_ids(list(place))
                good = []
                for k in range(at, to):
                    x, y = sets[place[text[0][k]]], sets[place[text[1][k]]]
                    low, high = sorted((len(x), len(y)))
                    good.append(low >= similarity * high and (both := shared(x, y)) / (low + high - both) >= similarity)
                keep = [[v for v, g in zip(own[at:to], good, strict=True) if g] for own in ids]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in keep], names=["a", "b"])

    return run


def close_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of at least the similarity: all exact intersections of a few lines at once.

    A shingle that several lines have is a column of a matrix of zeros and ones,
    whose product with itself counts what two lines share. Shingles are taken
    in slices, so that memory does not grow with the lines' length.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    both = np.zeros((n, n), np.float32)
    slices = -(-int(sizes.sum()) // SLICE)
    for k in range(slices):
        some = sets if slices == 1 else [x[x % np.uint64(slices) == k] for x in sets]
        seen, column, count = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        several = count > 1
        where = np.where(several, np.cumsum(several) - 1, -1)[column]
        line = np.repeat(np.arange(n), [len(x) for x in some])[where >= 0]
        where = where[where >= 0]
        order = np.argsort(where, kind="stable")
        line, where = line[order], where[order]
        for at in range(0, int(several.sum()), 4096):
            a, b = np.searchsorted(where, (at, at + 4096))
            matrix = np.zeros((n, min(4096, int(several.sum()) - at)), np.float32)
            matrix[line[a:b], where[a:b] - at] = 1
            both += matrix @ matrix.T
    union = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu(both / union >= similarity, 1))


def close_pairs(lines: list[str], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of lines of at least the similarity."""
    return close_sets(shingle_ids(lines), similarity)


def _unit_links(similarity: float):
    """Links between members of different components, per unit; rows come sorted by unit."""

    def links(ids: list[int], roots: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        known = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        if len(known) < 2:
            return
        uf = UnionFind(len(known))
        for x, y in zip(*(v.tolist() for v in close_sets(sets, similarity)), strict=True):
            if uf.union(known[roots[x]], known[roots[y]]):
                yield ids[x], ids[y]

    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0

        def flush():
            unit, ids, roots, text = held
            place = {x: k for k, x in enumerate(dict.fromkeys(text))}
            sets = shingle_ids(list(place))
            found, cuts = [], [i for i in range(len(unit)) if not i or unit[i] != unit[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(unit)], strict=True):
                own = {i: k for k, i in enumerate(ids[a:b], a)}.values()
                found += links([ids[k] for k in own], [roots[k] for k in own], [sets[place[text[k]]] for k in own])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(common.column(batch, c).to_pylist() for c in ("unit", "id", "root", "line")), strict=True):
                # Several units at once, each whole.
                if size > HELD and row[0] != held[0][-1]:
                    yield flush()
                    held, size = [[], [], [], []], 0
                for own, v in zip(held, row, strict=True):
                    own.append(v)
                size += len(row[3])
        if held[0]:
            yield flush()

    return run


def _prefixes(similarity: float, common_shingles: tuple[np.ndarray, np.ndarray]):
    """token, id, root: the rarest shingles of each line, of which two lines of the similarity share one.

    Two sets of Jaccard similarity s share so much that the first
    n - ceil(s n) + 1 members of either, in one order for all, cannot be disjoint.
    The order is by the number in ``common_shingles`` (others: none), then by hash.
    """
    names, counts = common_shingles

    def run(batches):
        for ids, roots, line in common.rows_of(batches, ("id", "root", "line"), "line", 4 << 20):
            text, names_of, root_of = line.to_pylist(), ids.to_numpy(), roots.to_numpy()
            for at, to in _steps(text, HELD):
                h, first = _wide_hashes(text[at:to])
                token, owner, root = [], [], []
                for k, own in enumerate(np.split(h, first[1:]), at):
                    own = np.unique(own)
                    if len(names):
                        place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                        own = own[np.argsort(np.where(names[place] == own, counts[place], 0), kind="stable")]
                    own = own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
                    token.append(own)
                    owner.append(np.full(len(own), names_of[k]))
                    root.append(np.full(len(own), root_of[k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(root))], names=["key", "id", "root"])

    return run


def _frequent(batches):
    """token, n: shingles that several of the lines hold, the most frequent ones first and at most ORDERED."""
    own = [np.unique(x) for batch in batches for line in common.column(batch, "line").to_pylist() for x in [_wide_hashes([line])[0]]]
    if own:
        names, n = np.unique(np.concatenate(own), return_counts=True)
        top = np.argsort(-n, kind="stable")[: min(ORDERED, int((n > 1).sum()))]
        yield pa.RecordBatch.from_arrays([pa.array(names[top].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["token", "n"])


def _members_of_hot(hot: DataFrame, text: DataFrame, similarity: float) -> DataFrame:
    """key, id, root: members of large groups again, in groups of those that share a rare shingle.

    A band that holds very many lines says that they share a passage. What a
    line has beside it are its rare shingles; every two lines of the similarity
    share one (see _prefixes), so no link is lost. The order of the shingles
    comes from a few lines and decides about speed only.
    """
    lines = common.save(hot.select("id", "root").distinct().join(text, "id"), "hot")
    few = lines.where(F.length("line") < LONG).orderBy(F.xxhash64("id")).limit(SAMPLE).select("line")
    known = few.coalesce(1).mapInArrow(_frequent, "token bigint, n bigint").collect()  # at most ORDERED
    names = np.array([r["token"] for r in known], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    table = (names[order], np.array([r["n"] for r in known], dtype=np.int64)[order])
    found = common.save(lines.mapInArrow(_prefixes(similarity, table), "key bigint, id bigint, root bigint"), "prefixes")
    several = found.groupBy("key").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("open"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    # Shingles of one passage name the same lines: one of them stands for all.
    one = several.where("open").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return found.join(one, "key").select("key", "n", "id", "root")


def _units(members: DataFrame, text: DataFrame, similarity: float, group: int, many: int) -> DataFrame:
    """unit, id, root, line: members (key, n, id, root) in units of those to compare with each other.

    A group of at most ``group`` members is a unit. Of a larger one, those
    outside its largest component meet all members, in blocks of both; if they
    are more than ``many`` blocks, members are regrouped by rare shingles first.
    """
    small = members.where(F.col("n") < group).select(F.xxhash64("key").alias("unit"), "id", "root")
    large = members.where(F.col("n") >= group)
    if large.isEmpty():
        return small.join(text, "id")
    per_root = large.groupBy("key", "root").agg(F.count("*").alias("m"))
    blocks = lambda x: F.ceil(x / F.lit(group)).cast("int")
    sizes = per_root.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), blocks(F.sum("m")).alias("gm"), blocks(F.sum("m") - F.max("m")).alias("gq"))
    large = common.save(large.join(sizes, "key"), "large")
    parts = [small]
    of = lambda g: F.pmod(F.xxhash64("id"), g)
    meets = F.when(F.col("root") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("gm") - 1), lambda i: F.xxhash64("key", i.cast("bigint"), of(F.col("gq")))))
    held = F.transform(F.sequence(F.lit(0), F.col("gq") - 1), lambda j: F.xxhash64("key", of(F.col("gm")), j.cast("bigint")))
    none = F.array().cast("array<bigint>")
    direct = large.where(F.col("gq") <= many) if many else large
    parts.append(direct.select(F.explode(F.array_distinct(F.concat(held, F.coalesce(meets, none)))).alias("unit"), "id", "root"))
    units = reduce(DataFrame.unionByName, parts).join(text, "id")
    hot = large.where(F.col("gq") > many)
    if many and not hot.isEmpty():
        units = units.unionByName(_units(common.save(_members_of_hot(hot, text, similarity), "members"), text, similarity, group, 0))
    return units


def components(lines: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, many: int = MANY) -> DataFrame:
    """node, root for every line id that is near another one."""
    n = common.parts_for(lines)
    stars = candidate_stars(lines)
    pairs = stars.select("a", "b").distinct()
    # Texts of candidates only: the one time that lines are dealt by id.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = common.save(lines.select("id", "line").join(wanted, "id", "left_semi"), "texts")
    with_b = pairs.join(text.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    both = with_b.join(text.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    linked = common.save(both.select("a", "b", "line_a", "line_b").mapInArrow(_verify(similarity), "a bigint, b bigint"), "linked")
    found = common.save(connected(linked), "components")
    # Groups of three or more that are not one component yet.
    named = (
        stars.join(found.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(found.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select("key", "a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    )
    # Bands repeat groups; one key stands for all groups of the same members. Apart
    # from the smallest, a member is a group's ``b`` just once.
    groups = named.groupBy("key").agg(
        F.count("*").alias("n"),
        F.max((F.col("ra") != F.col("rb")).cast("int")).alias("open"),
        F.min("a").alias("least"),
        F.bit_xor(F.xxhash64("b")).alias("x"),
        F.bit_xor(F.xxhash64("b", F.lit(1))).alias("y"),
    )
    split = common.save(groups.where("open = 1 and n > 1").groupBy("n", "least", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "split")
    rows = named.join(split, "key")
    members = rows.select("key", "n", F.col("a").alias("id"), F.col("ra").alias("root")).unionByName(rows.select("key", "n", F.col("b").alias("id"), F.col("rb").alias("root"))).distinct()
    units = _units(common.save(members, "members"), text, similarity, group, many)
    more = units.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(_unit_links(similarity), "a bigint, b bigint")
    extra = common.save(more.distinct(), "extra")
    for done in (stars, text, linked, split):
        common.discard(done)
    if extra.isEmpty():
        return found
    return common.save(connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(extra)), "components")


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, keep (sorted line numbers): the lines that are not blank and stay."""
    common.ship(docs.sparkSession)
    lines = distinct_lines(docs)
    found = components(lines, similarity)
    rooted = lines.select("id", "doc_id", "pos").join(found.select(F.col("node").alias("id"), "root"), "id", "left")
    alone = rooted.where("root is null").select("doc_id", "pos")
    first = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "pos")).alias("p")).select("p.doc_id", "p.pos")
    keep = common.save(alone.unionByName(first).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("keep")), "keep")
    for done in (lines, found):
        common.discard(done)
    return keep


def decisions(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_kept, kept (sorted numbers, from 0, of lines that stay and are not blank) per row with a doc_id."""
    keep = kept_lines(docs, similarity)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size(F.split(common.utf8("text"), "\n", -1)).cast("bigint").alias("n_lines")).where("doc_id is not null")
    kept = F.coalesce("keep", F.array().cast("array<int>"))
    return rows.join(keep, "doc_id", "left").select("doc_id", "n_lines", F.size(kept).cast("bigint").alias("n_kept"), kept.alias("kept"))


def apply(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The given rows, ``text`` cut down to the lines that stay; blank lines stay."""
    keep = kept_lines(docs, similarity).withColumnRenamed("doc_id", "kept_id")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("own_id"))
    joined = whole.join(keep, F.col("own_id") == F.col("kept_id"), "left").select("row", "own_id", "keep")

    def cut(batches):
        given = common.with_field(batches, "row", "text", "text")
        for rows, ids, text, kept in common.rows_of(given, ("row", "own_id", "text", "keep"), "text"):
            out = []
            for i, t, stay in zip(ids.to_pylist(), text.to_pylist(), kept.to_pylist(), strict=True):
                t = t or ""
                if i is not None:
                    some = set(stay or ())
                    t = "\n".join([x for n, x in enumerate(t.split("\n")) if n in some or not normal(x)])
                out.append(t)
            yield pa.RecordBatch.from_arrays([rows, pa.array(out, pa.string())], names=["row", "text"])

    schema = joined.select("row", common.utf8("row.text").alias("text")).schema
    done = joined.mapInArrow(cut, schema)
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
