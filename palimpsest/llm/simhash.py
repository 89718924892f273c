"""SimHash near-duplicates: pigeonhole blocks, a join on them, Hamming verification.

A fingerprint of 64 bits is cut into six blocks. Two fingerprints that differ in
at most three bits agree on at least three whole blocks, so every such pair
shares one of the 20 keys made of three blocks (about 32 bits each). Equal
fingerprints are one node from the start. Members of a key's group are compared
inside a task, which emits a spanning forest of the group's links, not its
pairs. A group over ``GROUP`` members is dealt into sub-blocks, and every pair
of sub-blocks is a task's unit of its own, so no unit holds more than 2 * GROUP
members and no link is lost.

Defined results: null and wordless texts have fingerprint zero and link like
any other; fewer than three words make one shingle; repeated rows link to each
other; a null doc_id keeps its row but never names a component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common
from palimpsest.llm.components import connected

SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 3
#: (first bit, bits) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
KEYS = tuple(combinations(range(6), 3))
GROUP = 4096
#: Bytes of text, and shingles, that are held at once.
TEXT_STEP = 1 << 20
COUNT_STEP = 1 << 16

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes, keep: int) -> Iterator[list[bytes]]:
    """Runs of words of a text; each begins with the last ``keep`` words of the one before."""
    at, carry = 0, []
    while at < len(text):
        to = at + TEXT_STEP
        if to >= len(text):
            to = len(text)
        else:
            m = _BLANK.search(text, to)
            to = m.start() if m else len(text)
        words = carry + text[at:to].lower().split()
        yield words
        carry = words[-keep:] if keep else []
        at = to


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the shingles' hashes; zero without words."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    few: list[bytes] = []
    for words in _words(text, SHINGLE_WORDS - 1):
        n = len(words) - SHINGLE_WORDS + 1
        if n <= 0:
            few = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:n].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)]
        total += n
        h = np.array(hashes, dtype="<u8")
        for i in range(0, n, COUNT_STEP):
            counts += np.unpackbits(h[i : i + COUNT_STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not total:
        return digest(b" ".join(few), SEED) if few else 0
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > total)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint as a signed long) per row."""
    common.ship(docs.sparkSession)

    def run(batches):
        for ids, h, text in common.rows_of(batches, ("doc_id", "h", "text"), "text"):
            fps = [fingerprint(t or b"") for t in text.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, h, pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "h", "fp"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(common.utf8("text")).alias("h"), common.utf8("text").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _key(fp: Column, k: int) -> Column:
    """Three blocks of a fingerprint beside the number of their choice, as one long."""
    out = F.lit(k).cast("bigint")
    for block in KEYS[k]:
        at, bits = BLOCKS[block]
        own = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
        out = F.shiftleft(out, bits).bitwiseOR(own)
    return out


def spanning_links(fps: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the graph of distinct fingerprints within ``most`` bits."""
    left = np.arange(len(fps))
    out = []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= most
            if near.any():
                found = left[near].tolist()
                out += [(i, j) for j in found]
                todo += found
                left = left[~near]
    return out


def _link_units(batches):
    """Spanning links of runs of equal unit; rows come sorted by unit."""
    unit_held, fp_held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(units, fps):
        cuts = np.flatnonzero(units[1:] != units[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(units)]]))
        two = starts[sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
        a, b = [fps[two][near]], [fps[two + 1][near]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = np.unique(fps[s : s + n])
            pairs = np.array(spanning_links(own), dtype=np.int64).reshape(-1, 2)
            a.append(own[pairs[:, 0]])
            b.append(own[pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        units = np.concatenate([unit_held, common.column(batch, "unit").to_numpy()])
        fps = np.concatenate([fp_held, common.column(batch, "fp").to_numpy().view(np.uint64)])
        if not len(units):
            continue
        last = int(np.searchsorted(units, units[-1], side="left")) if np.all(units[1:] >= units[:-1]) else int(np.flatnonzero(units != units[-1])[-1]) + 1
        if last:
            yield links(units[:last], fps[:last])
        unit_held, fp_held = units[last:], fps[last:]
    if len(unit_held):
        yield links(unit_held, fp_held)


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) fingerprints within DISTANCE bits that connect what the full graph connects."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.explode(F.array(*[_key(F.col("fp"), k) for k in range(len(KEYS))])).alias("key"))
    shared = common.save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    g = F.ceil(F.col("n") / F.lit(group)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    members = keyed.join(shared, "key").withColumn("g", g).withColumn("own", own)
    pairs = F.when(F.col("g") == 1, F.array(F.xxhash64("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.xxhash64("key", F.least("own", j), F.greatest("own", j)))
    )
    units = members.select("fp", F.explode(pairs).alias("unit"))
    dealt = units.repartition(common.parts(spark), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(_link_units, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, h (a hash of the text), fp and component_id (smallest doc_id that links reach) per row."""
    fps = common.save(fingerprints(docs), "fingerprints")
    distinct = common.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = common.save(connected(links(distinct, group)).select(F.col("node").alias("fp"), "root"), "components")
    rooted = distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.save(rooted.join(least, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "h", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
