"""Suffix-array dedup: bytes of a text that an earlier document already holds, by deep-shallow sorting.

Every string of ``LENGTH`` bytes has one anchor: the k-gram of smallest hash in
it (a minimizer), so equal strings have equal anchors at equal places. The
strings of one anchor overlap in a context of at most 84 bytes. Suffixes and
reversed prefixes of contexts around the same k-gram are sorted: multikey
quicksort by eight-byte words down to a shallow depth, all groups of a depth at
once, then blind tries order the groups that share a long prefix. Common prefix
lengths of neighbours give, for each string, the smallest document it starts in.
A context that is the only one around its k-gram needs no sorting.

Documents are dealt to units by hash. A unit asks in two rounds, each key once
per unit however often it occurs there: (a) which anchors also occur in another
document; (b) for contexts of these, the smallest document of each string. Only
equal bytes count between units; a unit finds its own contexts and strings again
by 64-bit hashes. A key that a third of all rows hold thus makes as many
requests as there are units, never as many as rows.

Many texts share a k-gram by chance. A string of LENGTH bytes also holds HALF
bytes behind its anchor or one more before it, so (a) asks for these longer
grams as well, and (b) only for contexts that have a shared one. Requests of (b)
come in rounds, each of a part of the k-grams, so that those of one round take
about ROUND times the input's bytes of disk, however much the texts share.

A k-gram may stand in many different contexts, as a separator does. If units ask
for more than ``HOT`` contexts of it, its strings are asked for one by one, dealt by all
of their bytes, so no task sorts more than ``HOT`` contexts around one k-gram.

Defined results: null text counts as empty; texts under LENGTH bytes lose
nothing; rows that share a doc_id do not remove each other's bytes; rows
without doc_id are returned whole and take no part; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

LENGTH = 50
GRAM = 16
#: k-grams in a string, and so the most strings that one anchor may have.
SPAN = LENGTH - GRAM + 1
WIDTH = LENGTH + SPAN - 1
#: A string holds so many bytes behind its anchor, or one more before it.
HALF = (LENGTH - GRAM) // 2
PAD = 0xFF  # never a byte of UTF-8
#: Bytes of text that are worked on at once; places in it fit PLACE_BITS.
STEP = 1 << 21
PLACE_BITS = 22
#: Bytes whose hashes are found at once; arrays of so many numbers stay in a core's cache.
PIECE = 1 << 15
#: Depth of multikey quicksort in words of eight bytes.
SHALLOW = 4
#: Contexts of a k-gram, each counted once per unit, beyond which its strings are dealt by their own bytes.
HOT = 4096
#: Contexts whose strings are cut out at a time.
CUT = 20_000
#: Bytes of requests for contexts in one round, as a part of the input's bytes.
ROUND = 1.0
#: Bytes of requests for contexts that a byte of the answers before them stands for.
PER_BYTE = 12

_MUL = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_ROWS = "unit int, kind int, payload binary"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MUL, n, 1 << 64))


@cache
def _weights() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, for every place in a step."""
    out = []
    for base in (_MUL, pow(_MUL, -1, 1 << 64)):
        steps = np.full(STEP + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# Deep-shallow sorting


class _Blind:
    """Blind trie: inner nodes hold a depth and branch on one byte; leaves hold equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = []

    def _common(self, a: bytes, b: bytes) -> int:
        if a == b:
            return len(a)
        differ = int.from_bytes(a) ^ int.from_bytes(b)
        return len(a) - (differ.bit_length() + 7) // 8

    def add(self, i: int) -> None:
        s = self.strings[i]
        if not self.root:
            self.root = [-1, [i]]
            return
        # Walk down blindly to some leaf, compare with it, then branch where they differ.
        node = self.root
        while node[0] >= 0:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        depth = self._common(s, self.strings[node[1][0]])
        if depth == len(s):
            node[1].append(i)
            return
        other = self.strings[node[1][0]][depth]
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = [-1, [i]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        new = [depth, {other: node, s[depth]: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def order(self) -> Iterator[int]:
        todo = [self.root]
        while todo:
            depth, what = todo.pop()
            if depth < 0:
                yield from what
            else:
                todo += [what[c] for c in sorted(what, reverse=True)]


def deep_shallow_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte strings of equal width (n, width)."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, start = np.arange(n), np.zeros(n, np.int64)  # start: of each place's group
    tied = np.arange(n if n > 1 else 0)  # places in groups of several rows
    for depth in range(min(SHALLOW, words.shape[1])):
        own, key = start[tied], words[order[tied], depth]
        by = np.lexsort((key, own)) if depth else np.argsort(key)
        order[tied], key = order[tied[by]], key[by]
        head = np.ones(len(tied), dtype=bool)
        head[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        start[tied] = np.repeat(tied[head], np.diff(np.append(np.flatnonzero(head), len(tied))))
        head = np.append(head, True)
        tied = tied[~(head[:-1] & head[1:])]
    if len(tied):
        flat = np.ascontiguousarray(rows[order[tied]]).tobytes()
        cuts = np.append(np.flatnonzero(np.diff(start[tied], prepend=-1)), len(tied)).tolist()
        names = order[tied]
        for a, b in zip(cuts, cuts[1:]):
            trie = _Blind([flat[i * width : (i + 1) * width] for i in range(a, b)])
            for k in range(b - a):
                trie.add(k)
            order[tied[a:b]] = names[a:b][list(trie.order())]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length of each row in order with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        s = rows[order]
        differ = s[1:] != s[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


# Anchors


def _minimizers(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-gram, and for every string the place of its k-gram of smallest hash, the first of equals."""
    n = len(buf) - LENGTH + 1
    grams, places = np.empty(len(buf) - GRAM + 1, np.uint64), np.empty(n, np.int32)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        h, size = _BYTE[buf[at : to + LENGTH - 1]], 1
        while size < GRAM:
            h = h[:-size] * _power(size) + h[size:]
            size *= 2
        grams[at : at + len(h)] = h = _mix(h)
        least = (h & ~low) | np.arange(at, at + len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
        places[at:to] = least & low
    return grams, places


class Runs:
    """Anchors of some texts: for each, the run of strings (first..last start) that it stands for."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        """buf: texts one after another, at most STEP + LENGTH bytes; offsets: n + 1 places."""
        self.buf, n = buf, len(buf)
        doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        if n < LENGTH:
            self.first = self.last = self.place = np.zeros(0, np.int64)
            self.doc, self.gram = np.zeros(0, np.int32), np.zeros(0, np.uint64)
            return
        gram, place = _minimizers(buf)
        own = doc[: len(place)]
        inside = own == doc[LENGTH - 1 :]
        edge = np.ones(len(place), dtype=bool)
        edge[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
        last = np.ones(len(place), dtype=bool)
        last[:-1] = edge[1:] | ~inside[1:]
        edge[1:] |= ~inside[:-1]
        self.first, self.last = np.flatnonzero(edge & inside), np.flatnonzero(last & inside)
        self.place, self.doc = place[self.first].astype(np.int64), own[self.first]
        self.gram = gram[self.place]

    def keep(self, which: np.ndarray) -> None:
        self.first, self.last, self.place, self.doc, self.gram = (x[which] for x in (self.first, self.last, self.place, self.doc, self.gram))

    @cached_property
    def prefix(self) -> np.ndarray:
        """Weighted sums of the bytes before each place."""
        weights = _weights()[0]
        out = np.zeros(len(self.buf) + 1, np.uint64)
        for at in range(0, len(self.buf), PIECE):
            to = min(len(self.buf), at + PIECE)
            sums = _BYTE[self.buf[at:to]] * weights[at:to]
            sums[:1] += out[at]
            np.cumsum(sums, out=out[at + 1 : to + 1])
        return out

    def context_hashes(self) -> np.ndarray:
        """64-bit hash of each anchor's context and its place in it."""
        prefix, back = self.prefix, _weights()[1]
        a, b = self.first, self.last + LENGTH
        h = (prefix[b] - prefix[a]) * back[a]
        shape = ((self.place - a) * 128 + (b - a)).astype(np.uint64)
        return _mix(h * _power(1) + _mix(shape + np.uint64(1)))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, 64-bit hash) of its k-gram with HALF bytes behind it or HALF + 1 before it; each string holds one of these."""
        prefix, back = self.prefix, _weights()[1]
        behind, before = np.flatnonzero(self.last >= self.place - HALF), np.flatnonzero(self.first < self.place - HALF)
        a, b = self.place[behind], self.place[before] - HALF - 1
        right = (prefix[a + GRAM + HALF] - prefix[a]) * back[a]
        left = (prefix[b + HALF + 1 + GRAM] - prefix[b]) * back[b]
        return np.concatenate([behind, before]), np.concatenate([_mix(right), _mix(~left)])

    def string_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, start, 64-bit hash) of every string of the anchors."""
        prefix, back = self.prefix, _weights()[1]
        many = self.last - self.first + 1
        who = np.repeat(np.arange(len(many)), many)
        start = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + self.first[who]
        return who, start, _mix((prefix[start + LENGTH] - prefix[start]) * back[start])

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """(anchor, WIDTH) bytes with the k-gram at SPAN - 1, PAD outside its strings."""
        place = self.place[which]
        padded = np.full(len(self.buf) + 2 * WIDTH, PAD, np.uint8)
        padded[SPAN - 1 : SPAN - 1 + len(self.buf)] = self.buf
        out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[place]
        lead, end = ((x - place + SPAN - 1).astype(np.uint8)[:, None] for x in (self.first[which], self.last[which] + LENGTH))
        column = np.arange(WIDTH, dtype=np.uint8)
        out[(column < lead) | (column >= end)] = PAD
        return out


def strings_of(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, 64-bit hash) of every string in contexts; hashes as of Runs.string_hashes."""
    weights = _weights()[0][:LENGTH]
    rows, offsets, hashes = [], [], []
    for at in range(0, len(contexts), CUT):
        own = contexts[at : at + CUT]
        real = own != PAD
        lead, end = real.argmax(axis=1), WIDTH - real[:, ::-1].argmax(axis=1)
        for o in range(SPAN):
            some = np.flatnonzero((lead <= o) & (o + LENGTH <= end))
            if len(some):
                rows.append(some + at)
                offsets.append(np.full(len(some), o, np.int64))
                hashes.append(_mix((_BYTE[own[some, o : o + LENGTH]] * weights).sum(axis=1, dtype=np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(hashes)


def string_minima(strings: np.ndarray, names: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each string (n, LENGTH), the smallest document of those that are equal; equal strings have equal names."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    equal = (strings[order[1:]] == strings[order[:-1]]).all(axis=1)
    if (same & ~equal).any():  # two strings of one name: by bytes as well
        order = np.lexsort((*strings.T[::-1], names))
        equal = (strings[order[1:]] == strings[order[:-1]]).all(axis=1)
    head = np.concatenate([[True], ~equal])
    least = np.minimum.reduceat(docs[order], np.flatnonzero(head))
    out = np.empty(len(order), np.int64)
    out[order] = least[np.cumsum(head) - 1]
    return out


def _spans(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset of the first string in each context, and how many strings it has."""
    real = contexts != PAD
    lead = real.argmax(axis=1)
    return lead, np.maximum(WIDTH - real[:, ::-1].argmax(axis=1) - lead - LENGTH + 1, 0)


def _numbered(many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in it) of the elements of rows with so many each, and where each row's begin."""
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - first[row], first


def window_minima(contexts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, smallest document) of every string in contexts around the same k-grams."""
    n = len(contexts)
    right, left = contexts[:, SPAN - 1 :], np.ascontiguousarray(contexts[:, SPAN - 2 :: -1])
    classes = []
    for part in (right, left):
        order = deep_shallow_order(part)
        classes.append((order, common_prefixes(part, order)))
    lead, many = _spans(contexts)
    row, offset, first = _numbered(many)
    offset += lead[row]
    least = np.empty(len(row), np.int64)
    for o in range(SPAN):
        rows = np.flatnonzero((lead <= o) & (o < lead + many))
        if not len(rows):
            continue
        key = np.zeros(n, np.int64)
        for (order, lcp), size in zip(classes, (o + GRAM, SPAN - 1 - o), strict=True):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(lcp < size)
            key = key * (n + 1) + own
        key = key[rows]
        by = np.argsort(key)
        key, rows = key[by], rows[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least[first[rows] + o - lead[rows]] = np.repeat(np.minimum.reduceat(docs[rows], starts), np.diff(np.append(starts, len(rows))))
    return row, offset, least


def window_minima_by_gram(contexts: np.ndarray, docs: np.ndarray, most: int = 40_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window_minima over whole k-gram groups, about ``most`` contexts at a time; a context alone in its group has its own document."""
    head = np.ascontiguousarray(contexts[:, SPAN - 1 : SPAN + 7]).view(np.uint64).ravel()
    order = np.argsort(head)
    new = np.concatenate([[True], head[order][1:] != head[order][:-1], [True]])
    order = order[~(new[:-1] & new[1:])]
    lead, many = _spans(contexts)
    row, offset, first = _numbered(many)
    offset += lead[row]
    least = docs[row]
    edges = np.flatnonzero(np.diff(head[order])) + 1
    at = 0
    while at < len(order):
        i = int(np.searchsorted(edges, at + most))
        to = int(edges[i]) if i < len(edges) else len(order)
        own = order[at:to]
        part, place, low = window_minima(contexts[own], docs[own])
        part = own[part]
        least[first[part] + place - lead[part]] = low
        at = to
    return row, offset, least


# Rows between units


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["unit", "kind", "payload"])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; _unpack returns them with the given types."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<{len(raw)}q", *map(len, raw)) + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(payload: bytes, *types: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}q", payload)
    raw = zstandard.ZstdDecompressor().decompress(payload[8 * len(types) :], max_output_size=max(1, sum(sizes)))
    out, at = [], 0
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw[at : at + size], dtype=kind))
        at += size
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    """Sorted 32-bit numbers as bytes that compress; _sums returns them."""
    return np.ascontiguousarray(np.diff(values, prepend=values[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(gaps.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(common.column(batch, c).to_pylist() for c in ("unit", "kind", "payload")), strict=True)


def _packed(docs: DataFrame, n: int) -> DataFrame:
    """Documents as compressed blocks of kind 1, addressed to their units."""

    def run(batches):
        for ids, unit, text in common.rows_of(batches, ("doc_id", "unit", "text"), "text", 16 << 20):
            buf, off = common.text_slices(text)
            names, units, sizes = ids.to_numpy(), unit.to_numpy(), np.diff(off)
            order = np.argsort(units, kind="stable")
            cuts = np.flatnonzero(np.diff(units[order])) + 1
            rows = []
            for own in np.split(order, cuts):
                flat = [buf[off[i] : off[i + 1]] for i in own.tolist()]
                rows.append((int(units[own[0]]), BLOCK, _pack(names[own], sizes[own], np.concatenate(flat))))
            yield _batch(rows)

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.utf8("text").alias("text")).where("doc_id is not null")
    dealt = given.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).select("doc_id", "unit", "text")
    return dealt.mapInArrow(run, _ROWS)


def _steps(payload: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, bytes, offsets, places of the bytes in the block) in steps of about STEP bytes.

    A text over STEP bytes is cut into parts that overlap by LENGTH - 1 bytes, so
    every string starts in just one part.
    """
    ids, sizes, buf = _unpack(payload, "<i8", "<i8", "u1")
    off = np.concatenate([[0], np.cumsum(sizes)])
    cuts: list[tuple[int, int, int]] = []  # document, from, to
    held = 0
    for i in range(len(ids)):
        at = int(off[i])
        while True:
            to = min(int(off[i + 1]), at + STEP)
            if held and held + to - at > STEP:
                yield _step(ids, buf, cuts)
                cuts, held = [], 0
            cuts.append((i, at, to))
            held += to - at
            if to == off[i + 1]:
                break
            at = to - (LENGTH - 1)
    if cuts:
        yield _step(ids, buf, cuts)


def _step(ids, buf, cuts):
    sizes = np.array([b - a for _, a, b in cuts], dtype=np.int64)
    return ids[[i for i, _, _ in cuts]], np.concatenate([buf[a:b] for _, a, b in cuts]), np.concatenate([[0], np.cumsum(sizes)]), np.array([a for _, a, _ in cuts], dtype=np.int64)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _answered(packed: DataFrame, answers: DataFrame | None, n: int) -> DataFrame:
    both = packed if answers is None else packed.unionByName(answers)
    return both.repartitionById(n, F.col("unit")).sortWithinPartitions("unit", "kind")


#: Kinds of rows: about keys of anchors, strings, contexts (and k-grams), and documents, in the order in which a unit meets them.
KEYS, STRINGS, CONTEXTS, BLOCK = -2, -1, 0, 1


def _per_unit(batches):
    """(unit, what it was told by kind, blocks); rows come sorted."""
    unit, told, blocks = None, {KEYS: [], STRINGS: [], CONTEXTS: []}, []
    for u, kind, payload in _rows(batches):
        if u != unit and unit is not None:
            yield unit, told, blocks
            told, blocks = {KEYS: [], STRINGS: [], CONTEXTS: []}, []
        unit = u
        (blocks if kind == BLOCK else told[kind]).append(payload)
    if unit is not None:
        yield unit, told, blocks


def _columns(payloads: list[bytes], *types: str) -> list[np.ndarray]:
    """The arrays of all payloads, one after another."""
    parts = [_unpack(x, *types) for x in payloads]
    return [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, t if t != "?" else bool) for i, t in enumerate(types)]


def _distinct(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many different values each group of neighbours has; groups begin at starts."""
    sizes = np.diff(np.append(starts, len(values)))
    out = sizes.copy()
    several = np.flatnonzero(sizes > 1)
    group = np.repeat(several, sizes[several])
    own = values[np.repeat(sizes > 1, sizes)]
    order = np.lexsort((own, group))
    group, own = group[order], own[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
    out[several] = np.bincount(group[new], minlength=len(starts))[several]
    return out


def _ask_grams(n: int):
    def run(batches):
        for unit, _, blocks in _per_unit(batches):
            grams, owners, hashes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            keys, holders = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for block in blocks:
                for ids, buf, off, _ in _steps(block):
                    runs = Runs(buf, off)
                    grams.append(runs.gram)
                    owners.append(ids[runs.doc])
                    hashes.append(runs.context_hashes() if len(runs.gram) else runs.gram)
                    if len(runs.gram):
                        who, key = runs.keys()
                        keys.append(key)
                        holders.append(ids[runs.doc[who]])
            grams, owners, hashes = np.concatenate(grams), np.concatenate(owners), np.concatenate(hashes)
            order = np.argsort(grams)
            grams, owners, hashes = grams[order], owners[order], hashes[order]
            head = np.ones(len(grams), dtype=bool)
            head[1:] = grams[1:] != grams[:-1]
            starts = np.flatnonzero(head)
            several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts) if len(starts) else np.zeros(0, bool)
            times = _distinct(hashes, starts).astype(np.uint32)
            grams = grams[starts]
            to = (grams % np.uint64(n)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(n + 1))
            rows = []
            for k in range(n):
                own = by[cuts[k] : cuts[k + 1]]
                if len(own):
                    rows.append((k, CONTEXTS, _pack(np.array([unit]), grams[own], several[own], times[own])))
            del grams, owners, hashes, order, head, starts, several, times
            yield _batch(rows + _ask_keys(unit, n, np.concatenate(keys), np.concatenate(holders)))

    return run


def _ask_keys(unit: int, n: int, keys: np.ndarray, holders: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Requests for keys, each once: dealt by one half of the hash, told apart by the other, as equal ones only cost work."""
    if not len(keys):
        return []
    order = np.argsort(keys)
    keys, holders = keys[order], holders[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    several = np.minimum.reduceat(holders, starts) != np.maximum.reduceat(holders, starts)
    keys = keys[starts]
    to, low = ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64), keys.astype(np.uint32)
    order = np.argsort(to << 32 | low)
    cuts = np.searchsorted(to[order], np.arange(n + 1))
    parts = ((k, order[cuts[k] : cuts[k + 1]]) for k in range(n))
    return [(k, KEYS, _pack(np.array([unit]), _gaps(low[own]), several[own])) for k, own in parts if len(own)]


def _in_groups(values: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """For each element, the sums of numbers over the elements of equal value."""
    order = np.argsort(values, kind="stable")
    head = np.ones(len(order), dtype=bool)
    head[1:] = values[order[1:]] != values[order[:-1]]
    starts, group = np.flatnonzero(head), np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    return [np.add.reduceat(x[order], starts, dtype=np.int64)[group] for x in numbers]


def _answer_grams(hot: int):
    """Which of the keys also occur in another document, and which of the k-grams in others in more than ``hot`` contexts."""

    def run(batches):
        for _, told, _ in _per_unit(batches):
            rows = []
            if told[CONTEXTS]:
                asked = [_unpack(x, "<i8", "<u8", "?", "<u4") for x in told[CONTEXTS]]
                grams, several, times = (np.concatenate([a[i] for a in asked]) for i in (1, 2, 3))
                shared, times = _in_groups(grams, several.astype(np.int8) + 1, times)
                rows += _told(CONTEXTS, asked, grams, (shared > 1) & (times > hot), lambda x: x)
            if told[KEYS]:
                asked = [_unpack(x, "<i8", "u1", "?") for x in told[KEYS]]
                asked = [(unit, _sums(gaps), several) for unit, gaps, several in asked]
                keys, several = (np.concatenate([a[i] for a in asked]) for i in (1, 2))
                [shared] = _in_groups(keys, several.astype(np.int8) + 1)
                rows += _told(KEYS, asked, keys, shared > 1, _gaps)
            yield _batch(rows)

    return run


def _told(kind: int, asked: list, values: np.ndarray, flag: np.ndarray, form) -> list[tuple[int, int, bytes]]:
    """The flagged values to each unit that asked for them."""
    at, rows = 0, []
    for unit, own, *_ in asked:
        part = slice(at, at + len(own))
        at += len(own)
        if flag[part].any():
            rows.append((int(unit[0]), kind, _pack(form(values[part][flag[part]]))))
    return rows


def _ask_contexts(n: int, turn: int = 0, turns: int = 1):
    """Requests for contexts of anchors that have a shared key; those of one k-gram come in one turn."""

    def run(batches):
        for unit, told, blocks in _per_unit(batches):
            hot = np.sort(_columns(told[CONTEXTS], "<u8")[0])
            shared = np.sort(np.concatenate([np.zeros(0, np.uint32), *(_sums(_unpack(x, "u1")[0]) for x in told[KEYS])]))
            hashes, docs, grams, contexts = [], [], [], []
            seen = np.zeros(0, np.uint64)
            for block in blocks:
                for ids, buf, off, _ in _steps(block):
                    runs = Runs(buf, off)
                    if turns > 1:
                        runs.keep(runs.gram // np.uint64(n) % np.uint64(turns) == turn)
                    if not len(runs.gram):
                        continue
                    who, key = runs.keys()
                    own = np.zeros(len(runs.gram), dtype=bool)
                    own[who[_among(key.astype(np.uint32), shared)]] = True
                    runs.keep(own)
                    if not len(runs.gram):
                        continue
                    h = runs.context_hashes()
                    _, first = np.unique(h, return_index=True)
                    new = first[~_among(h[first], seen)]
                    seen = np.sort(np.concatenate([seen, h[new]]))
                    hashes.append(h)
                    docs.append(ids[runs.doc])
                    grams.append((h[new], runs.gram[new]))
                    contexts.append(runs.contexts(new))
            if not hashes:
                continue
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            least, most = np.minimum.reduceat(d[order], starts), np.maximum.reduceat(d[order], starts)
            names = np.concatenate([x for x, _ in grams])
            by_name = np.argsort(names, kind="stable")  # the order of h[order][starts]
            gram, context = np.concatenate([g for _, g in grams])[by_name], np.concatenate(contexts)[by_name]
            names = names[by_name]
            split = _among(gram, hot)
            to = (gram % np.uint64(n)).astype(np.int64)
            rows = []
            rest = np.flatnonzero(~split)
            rest = rest[np.lexsort((gram[rest], to[rest]))]  # like contexts side by side
            cuts = np.searchsorted(to[rest], np.arange(n + 1)).tolist()
            for k in range(n):
                own = rest[cuts[k] : cuts[k + 1]]
                if not len(own):
                    continue
                rows.append((k, CONTEXTS, _pack(np.array([unit]), names[own], least[own], most[own] > least[own], context[own])))
            if split.any():
                rows += _ask_strings(unit, n, *(x[split] for x in (gram, context, least, most)))
            yield _batch(rows)

    return run


def _ask_strings(unit: int, n: int, gram: np.ndarray, context: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Requests for the strings of contexts, each once, dealt by their hash."""
    row, offset, name = strings_of(context)
    order = np.argsort(name, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    low, high = np.minimum.reduceat(least[row[order]], starts), np.maximum.reduceat(most[row[order]], starts)
    one = order[starts]
    row, offset, name = row[one], offset[one], name[one]
    to = (name % np.uint64(n)).astype(np.int64)
    out = []
    order = np.lexsort((offset, row, to))  # strings that overlap side by side
    cuts = np.searchsorted(to[order], np.arange(n + 1)).tolist()
    for k in range(n):
        own = order[cuts[k] : cuts[k + 1]]
        if not len(own):
            continue
        strings = context[row[own, None], offset[own, None] + np.arange(LENGTH)]
        out.append((k, STRINGS, _pack(np.array([unit]), name[own], gram[row[own]], low[own], high[own] > low[own], strings)))
    return out


def _answer_contexts(batches):
    for _, told, _ in _per_unit(batches):
        out = []
        if told[STRINGS]:
            asked = [_unpack(x, "<i8", "<u8", "<u8", "<i8", "?", "u1") for x in told[STRINGS]]
            names, grams, docs, several, strings = (np.concatenate([a[i] for a in asked]) for i in range(1, 6))
            least = string_minima(strings.reshape(-1, LENGTH), names, docs)
            use, at = several | (least < docs), 0
            for a in asked:
                own = np.flatnonzero(use[at : at + len(a[1])]) + at
                at += len(a[1])
                if len(own):
                    out.append((int(a[0][0]), STRINGS, _pack(names[own], grams[own], least[own])))
        if told[CONTEXTS]:
            out += _answer_runs([_unpack(x, "<i8", "<u8", "<i8", "?", "u1") for x in told[CONTEXTS]])
        yield _batch(out)


def _answer_runs(asked: list[list[np.ndarray]]) -> list[tuple[int, int, bytes]]:
    names = np.concatenate([a[1] for a in asked])
    docs = np.concatenate([a[2] for a in asked])
    several = np.concatenate([a[3] for a in asked])
    contexts = np.concatenate([a[4] for a in asked]).reshape(-1, WIDTH)
    # Each context is sorted once, whatever number of units ask for it.
    order = np.argsort(names, kind="stable")
    head = np.ones(len(order), dtype=bool)
    same = np.flatnonzero(names[order[1:]] == names[order[:-1]]) + 1
    head[same] = (contexts[order[same]] != contexts[order[same - 1]]).any(axis=1)
    starts = np.flatnonzero(head)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    row, offset, least = window_minima_by_gram(contexts[order[starts]], np.minimum.reduceat(docs[order], starts))
    first = np.searchsorted(row, np.arange(len(starts) + 1))
    many = np.diff(first)[group]
    row = np.repeat(np.arange(len(group)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[group], many)
    offset, least = offset[at], least[at]
    use = several[row] | (least < docs[row])
    row, offset, least = row[use], offset[use], least[use]
    head = np.ones(len(row), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1) | (least[1:] != least[:-1])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.concatenate([starts, [len(row)]]))
    row, offset, least = row[starts], offset[starts], least[starts]
    ends = np.cumsum([len(a[1]) for a in asked])
    cuts = np.concatenate([[0], np.searchsorted(row, ends)])
    out = []
    for k, a in enumerate(asked):
        own = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            out.append((int(a[0][0]), CONTEXTS, _pack(names[row[own]], offset[own].astype(np.uint8), sizes[own].astype(np.uint8), least[own])))
    return out


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _finish(keep_bytes: bool):
    def run(batches):
        for _, told, blocks in _per_unit(batches):
            names, offset, size, least = _columns(told[CONTEXTS], "<u8", "u1", "u1", "<i8")
            order = np.argsort(names, kind="stable")
            names, offset, size, least = names[order], offset[order].astype(np.int64), size[order].astype(np.int64), least[order]
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
            names, each = names[starts], np.diff(np.append(starts, len(names)))
            string, hot, string_least = _columns(told[STRINGS], "<u8", "<u8", "<i8")
            order, hot = np.argsort(string, kind="stable"), np.unique(hot)
            string, string_least = string[order], string_least[order]
            for block in blocks:
                ids, sizes, buf = _unpack(block, "<i8", "<i8", "u1")
                off = np.concatenate([[0], np.cumsum(sizes)])
                cover = np.zeros(len(buf) + 1, np.int32)
                for owner, part, part_off, place in _steps(block) if len(names) or len(string) else ():
                    runs = Runs(part, part_off)
                    if not len(runs.gram):
                        continue
                    h, split = runs.context_hashes(), _among(runs.gram, hot)
                    if split.any():
                        one = copy.copy(runs)
                        one.keep(split)
                        who, start, own = one.string_hashes()
                        at = np.minimum(np.searchsorted(string, own), len(string) - 1)
                        earlier = (string[at] == own) & (string_least[at] < owner[one.doc[who]])
                        who, start = who[earlier], start[earlier]
                        start = start + place[one.doc[who]] - part_off[one.doc[who]]
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + LENGTH, -1)
                    if not len(names):
                        continue
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    hit, which, _ = _numbered(np.where(names[at] == h, each[at], 0))
                    which += starts[at[hit]]
                    earlier = least[which] < owner[runs.doc[hit]]
                    hit, which = hit[earlier], which[earlier]
                    shift = place[runs.doc[hit]] - part_off[runs.doc[hit]]
                    start = runs.place[hit] - (SPAN - 1) + offset[which] + shift
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + size[which] - 1 + LENGTH, -1)
                gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
                rows = []
                for i in range(len(ids)):
                    g, b = gone[off[i] : off[i + 1]], buf[off[i] : off[i + 1]]
                    left = b[~g].tobytes() if g.any() else b.tobytes()
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    rows.append((int(ids[i]), len(b), int(g.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _rounds(shared: DataFrame, size: int) -> int:
    """Rounds in which contexts are asked for, so that the requests of one stay near ROUND times the input."""
    told = shared.where(F.col("kind") == KEYS).agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    return max(1, -(-told * PER_BYTE // max(int(size * ROUND), 64 << 20)))


def dedup(docs: DataFrame, keep_bytes: bool = True, hot: int = HOT, rounds: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes, per row.

    rounds: how often contexts are asked for, a part of the k-grams each time; found from the input if not given.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = common.parts_for(docs.select("doc_id", "text"))
    packed = _packed(docs, n)
    deal = lambda df: df.repartitionById(n, F.col("unit")).sortWithinPartitions("unit", "kind")
    asked = _answered(packed, None, n).mapInArrow(_ask_grams(n), _ROWS)
    shared = common.save(deal(asked).mapInArrow(_answer_grams(hot), _ROWS), "shared")
    rounds = rounds or _rounds(shared, common.input_bytes(docs))
    least = None
    for turn in range(rounds):
        asked = _answered(packed, shared, n).mapInArrow(_ask_contexts(n, turn, rounds), _ROWS)
        own = common.save(deal(asked).mapInArrow(_answer_contexts, _ROWS), "least")
        least = own if least is None else least.unionByName(own)
    common.discard(shared)
    done = _answered(packed, least, n).mapInArrow(_finish(keep_bytes), _RESULT)
    whole = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc_id"), common.utf8("text").cast("binary").alias("b"))
    alone = whole.select(
        "doc_id",
        F.octet_length("b").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2("b", 256).alias("kept_sha256"),
        (F.col("b") if keep_bytes else F.lit(None).cast("binary")).alias("kept"),
    )
    return done.unionByName(alone)


# Every string of every document with the smallest document it starts in, then
# gaps and islands over bytes.
ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
w as (select rid, doc_id, s, substr(h, (2 * s + 1)::int, {2 * LENGTH}) as x from (select rid, doc_id, h, unnest(range(0, greatest(n - {LENGTH - 1}, 0))) as s from d where doc_id is not null)),
f as (select x, min(doc_id) as first from w group by x),
r as (select rid, s from w join f using (x) where doc_id > first),
b as (select rid, i, substr(h, (2 * i + 1)::int, 2) as byte from (select rid, h, unnest(range(0, n)) as i from d where rid in (select rid from r))),
c as (select b.rid, b.i, byte, max(r.s) over (partition by b.rid order by b.i) as last from b left join r on r.rid = b.rid and r.s = b.i),
g as (select rid, i, byte, coalesce(i - last < {LENGTH}, false) as gone from c),
e as (select *, lag(gone) over (partition by rid order by i) as before from g),
t as (select rid, count(*) filter (gone) as n_removed, count(*) filter (gone and before is distinct from true) as n_spans,
  string_agg(byte, '' order by i) filter (not gone) as kept from e group by rid)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when t.rid is null then h else coalesce(kept, '') end)) as kept_sha256 from d left join t using (rid)"""
