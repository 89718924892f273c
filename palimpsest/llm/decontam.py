"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, units after a number, and names
(capitalised words) turn into typed placeholders, other words into lower case; a
letter of a script without spaces is a word.
A capital that starts a sentence or text may be a name or a plain word, and a
unit that starts a window after a number may be a plain word: a window is
emitted for every such reading, so that what precedes a copy does not matter.
Windows of ``WINDOW`` template tokens of documents and
benchmark items are joined by hash. Matches on one diagonal (document position
less item position) are one occurrence of the item; its placeholders must be
filled consistently: one slot value of the item always by one value of the
document. Inconsistent occurrences count only windows whose slots are equal.

A document is contaminated by an item if an occurrence matches half of the
item's windows, or ``RUN`` of them. Placeholders vary only in windows of
``LITERALS`` plain words, which are counted on their own; all windows together
count with those poor in plain words, which match by equal tokens only. The
windows whose sentence starts are all plain words also count on their own, since
a first word that differs says nothing against the rest. An item
shorter than the window is one window. An item of one token matches only where
it is a whole sentence or line, as a single word of running text is no copy.

Defined results: null and empty texts match nothing; an item without a token
matches nothing; rows that share a doc_id share the verdict; rows with a
null doc_id or item_id are kept (documents) or ignored (items); empty tables
give no rows or no matches; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

WINDOW = 8
LITERALS = 4
RUN = 6
#: Bits of the filter of benchmark windows that all tasks get, whatever their number, and of one row of it.
FILTER_BITS = 27
ROW_BITS = 15
CACHE_WORDS = 400_000
#: Bytes of text that are tokens at once; a longer text is worked on alone.
TEXT_BYTES = 1 << 20

# Unit words (fixed values).
UNITS = frozenset(
    "mm cm m km g mg kg t l ml s sec seconds min minutes h hour hours day days week weeks month months year years "
    "ft feet inch inches mile miles yard yards lb lbs oz pound pounds dollar dollars cent cents usd eur euro euros percent "
    "meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres degrees "
    "stunde stunden tag tage jahr jahre heure heures jour jours an ans hora horas dia dias".split()
)

_TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?\n]")
# Scripts written without spaces, by ranges of code points (fixed values): Thai to Lao, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
PLAIN, NUMBER, UNIT, CAPITAL, END = range(5)
#: How a window matches: by template with sentence starts as plain words, by template in another reading, or by equal tokens.
LITERAL, TEMPLATE, EXACT = range(3)
#: Windows read at a time; one has at most 2**WINDOW readings.
STEP = 1 << 14
_KIND_HASH = np.array([0] + [xxhash.xxh64_intdigest(f"<{k}>") for k in ("number", "unit", "name")], dtype=np.uint64)
_MUL = 0x9E3779B97F4A7C15


def _tokens(text: str) -> list[str]:
    """Words, numbers and sentence ends; a letter of a script without spaces is a word."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return _TOKEN.findall(text)


def _kind(token: str) -> int:
    if token[0].isdecimal() and token[0].isascii():
        return NUMBER
    if token in ".!?\n":
        return END
    if token.lower() in UNITS:
        return UNIT
    return CAPITAL if token[0].isupper() else PLAIN


class Lexicon:
    """Kind and hash of each token, kept per worker up to CACHE_WORDS."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.kind = np.zeros(1 << 16, np.uint8)
        self.hash = np.zeros(1 << 16, np.uint64)

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        slot = self.slot
        idx = np.fromiter(map(slot.get, tokens, repeat(-1)), np.int64, len(tokens))
        unknown = np.flatnonzero(idx < 0).tolist()
        if not unknown:
            return self.kind[idx], self.hash[idx]
        new = list({tokens[i] for i in unknown})
        kinds = np.array([_kind(t) for t in new], dtype=np.uint8)
        hashes = np.array([xxhash.xxh64_intdigest(t.lower().encode("utf-8", "surrogatepass")) for t in new], dtype=np.uint64)
        keep, at = min(len(new), CACHE_WORDS - len(slot)), len(slot)
        while at + keep > len(self.kind):
            self.kind, self.hash = np.concatenate([self.kind, self.kind * 0]), np.concatenate([self.hash, self.hash * 0])
        self.kind[at : at + keep], self.hash[at : at + keep] = kinds[:keep], hashes[:keep]
        slot.update(zip(new[:keep], range(at, at + keep), strict=True))
        own = {w: len(self.kind) + i for i, w in enumerate(new)}
        idx[unknown] = [own[tokens[i]] for i in unknown]
        return np.concatenate([self.kind, kinds])[idx], np.concatenate([self.hash, hashes])[idx]


class Templates:
    """Template tokens of many texts, one after another."""

    def __init__(self, texts: list[str], lexicon: Lexicon):
        cut = [_tokens(t) for t in texts]
        flat = [x for own in cut for x in own]
        kind, h = lexicon(flat)
        doc = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (kind[:-1] == END) | (doc[1:] != doc[:-1])
        number_before = np.zeros(len(flat), dtype=bool)
        number_before[1:] = (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])
        last = np.append(first[1:] | (kind[1:] == END), True)
        sure = kind == PLAIN
        kind = np.where((kind == UNIT) & ~number_before, PLAIN, kind)
        real = np.flatnonzero(kind != END)
        self.kind, self.doc, self.flat, self.real = kind[real], doc[real], flat, real
        self.word, self.alone = h[real], (first & last)[real]
        self.open = ((kind == CAPITAL) & first)[real]
        self.hash = np.where(self.kind == PLAIN, self.word, _KIND_HASH[self.kind])
        self.plain = np.concatenate([[0], np.cumsum(self.kind == PLAIN)])
        self.opened = np.concatenate([[0], np.cumsum(self.open)])
        # Words that are plain wherever they stand: they say which windows are poor, alike in item and document.
        self.sure = np.concatenate([[0], np.cumsum(sure[real])])
        self.starts = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def windows(self, size: int, a: int = 0, b: int | None = None):
        """(first token, hash, form, tokens read as plain words) of every window of ``size`` tokens inside one text, of the tokens from a to b, in parts."""
        to = (len(self.hash) if b is None else b) - size + 1
        for lo in range(a, to, STEP):
            yield self._readings(size, lo, min(to, lo + STEP))

    def _readings(self, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mul = np.uint64(_MUL)
        h = np.full(hi - lo, size, np.uint64)
        for j in range(size):
            h = h * mul + self.hash[lo + j : hi + j]
        at = np.arange(lo, hi)
        inside = self.doc[lo + size - 1 : hi + size - 1] == self.doc[lo:hi]
        plain, opened = self.plain[at + size] - self.plain[at], self.opened[at + size] - self.opened[at]
        unit = self.kind[lo:hi] == UNIT
        rich = inside & (plain + opened + unit >= LITERALS)
        several = rich & ((opened > 0) | unit)
        one, many = np.flatnonzero(rich & ~several), np.flatnonzero(several)
        k, mask, g = many, np.zeros(len(many), np.uint8), h[many]
        for j in range(size):
            other = self.open[lo + k + j] if j else self.open[lo + k] | unit[k]
            sel = np.flatnonzero(other)
            token = lo + k[sel] + j
            change = (self.word[token] - self.hash[token]) * np.uint64(pow(_MUL, size - 1 - j, 1 << 64))
            k, mask, g = np.concatenate([k, k[sel]]), np.concatenate([mask, mask[sel] | np.uint8(1 << j)]), np.concatenate([g, g[sel] + change])
        chosen, first_unit = np.bitwise_count(mask), (mask & 1).astype(bool) & unit[k]
        form = np.where((chosen == opened[k]) & ~first_unit, LITERAL, TEMPLATE)
        enough = plain[k] + chosen >= LITERALS
        k, mask, g, form = k[enough], mask[enough], g[enough], form[enough]
        poor = inside & (self.sure[at + size] - self.sure[at] < LITERALS)
        if size == 1:
            poor &= self.alone[lo:hi]
        poor = at[poor]
        same = np.full(len(poor), size + 256, np.uint64)
        for j in range(size):
            same = same * mul + self.word[poor + j]
        h = np.concatenate([h[one], g, same])
        forms = np.concatenate([np.full(len(one), LITERAL), form, np.full(len(poor), EXACT)])
        masks = np.concatenate([np.zeros(len(one), np.uint8), mask, np.zeros(len(poor), np.uint8)])
        return np.concatenate([at[one], at[k], poor]), h ^ (h >> np.uint64(29)), forms, masks

    def slots(self, at: int, size: int, form: int, mask: int) -> list[str]:
        span = range(at, at + size)
        if form == EXACT:
            return [f"{NUMBER if self.kind[i] == NUMBER else CAPITAL}:{self.flat[self.real[i]].lower()}" for i in span]
        return [f"{int(self.kind[i])}:{self.flat[self.real[i]].lower()}" for i in span if self.kind[i] != PLAIN and not mask >> (i - at) & 1]


_SCHEMA = "id bigint, pos int, size int, hash bigint, form int, slots array<string>, windows int, rich int"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()]
    names = ["id", "pos", "size", "hash", "form", "slots", "windows", "rich"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of benchmark items, with the number of the item's windows and of those that match by template."""

    def run(batches):
        lexicon = Lexicon()
        for ids, text in common.rows_of(batches, ("id", "text"), "text", TEXT_BYTES):
            t = Templates(text.to_pylist(), lexicon)
            names, rows = ids.to_pylist(), []
            for d, (a, b) in enumerate(zip(t.starts[:-1].tolist(), t.starts[1:].tolist(), strict=True)):
                size = min(WINDOW, b - a)
                if size:
                    parts = list(t.windows(size, a, b))
                    n, rich = b - a - size + 1, sum(int((form == LITERAL).sum()) for _, _, form, _ in parts)
                    for at, h, form, mask in parts:
                        for i, x, f, m in zip(at.tolist(), h.view(np.int64).tolist(), form.tolist(), mask.tolist(), strict=True):
                            rows.append((names[d], i - a, size, x, f, t.slots(i, size, f, m), n, rich))
            yield _emit(rows)

    given = items.select(F.col("item_id").cast("bigint").alias("id"), common.utf8("text").alias("text")).where("id is not null")
    return given.mapInArrow(run, _SCHEMA)


def filter_rows(bench: DataFrame) -> DataFrame:
    """block, bits: the parts of a bitmap of FILTER_BITS places, one for the last bits of every window's hash."""

    def pack(batches):
        held, bits = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            block, low = common.column(batch, "block").to_numpy(), common.column(batch, "low").to_numpy()
            cuts = np.flatnonzero(np.diff(block)) + 1
            for own, places in zip(np.split(block, cuts), np.split(low, cuts), strict=True):
                if len(own) and own[0] != held:
                    if held is not None:
                        yield row()
                    held, bits = int(own[0]), np.zeros(1 << ROW_BITS, dtype=bool)
                if len(own):
                    bits[places] = True
        if held is not None:
            yield row()

    place = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parted = bench.select(F.shiftright(place, ROW_BITS).cast("int").alias("block"), place.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int").alias("low")).distinct()
    return parted.repartition(common.parts(bench.sparkSession), "block").sortWithinPartitions("block").mapInArrow(pack, "block int, bits binary")


def window_filter(bench: DataFrame) -> np.ndarray:
    """The bitmap as bytes: 16 MB, or as many as the filter's bits need."""
    size = 1 << ROW_BITS - 3
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in filter_rows(bench).toLocalIterator():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _found(batches, sizes: list[int], bits: np.ndarray, lexicon: Lexicon):
    # The bitmap folded to 20 bits, which a core's cache holds, looks first.
    low = np.unpackbits(np.bitwise_or.reduce(bits.reshape(-1, 1 << 17), axis=0), bitorder="little").astype(bool)
    for ids, text in common.rows_of(batches, ("id", "text"), "text", TEXT_BYTES):
        t = Templates(text.to_pylist(), lexicon)
        names, rows = ids.to_pylist(), []
        for size in sizes:
            for at, h, form, mask in t.windows(size):
                maybe = np.flatnonzero(low[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                place = (h[maybe] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                there = maybe[(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
                for i, x, f, m in zip(at[there].tolist(), h[there].view(np.int64).tolist(), form[there].tolist(), mask[there].tolist(), strict=True):
                    d = int(t.doc[i])
                    rows.append((names[d], i - int(t.starts[d]), size, x, f, t.slots(i, size, f, m), 0, 0))
                    if len(rows) >= 50_000:
                        yield _emit(rows)
                        rows = []
        yield _emit(rows)


def document_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray) -> DataFrame:
    """Windows of documents whose hash may be one of the benchmark's, as the bitmap ``wanted`` says."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(zlib.compress(wanted.tobytes(), 1))

    def run(batches):
        lexicon = common.worker_state("lexicon", "", Lexicon)
        yield from _found(batches, sizes, np.frombuffer(zlib.decompress(shared.value), np.uint8), lexicon)

    return docs.where("id is not null").mapInArrow(run, _SCHEMA)


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, windows: one row per document and item that contaminates it."""
    spark = docs.sparkSession
    common.ship(spark)
    bench = common.save(item_windows(items), "bench")
    sizes = sorted({r["size"] for r in bench.select("size").distinct().collect()})
    given = docs.select(F.col("doc_id").cast("bigint").alias("id"), common.utf8("text").alias("text"))
    found = document_windows(given, sizes, window_filter(bench))
    met = found.select(F.col("id").alias("doc_id"), "pos", "hash", F.col("form").alias("doc_form"), F.col("slots").alias("doc_slots")).join(
        bench.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", "form", F.col("slots").alias("item_slots"), "windows", "rich"),
        "hash",
    )
    # Literal windows are counted on their own, then with the other templates, both of the item's rich windows; all together of all.
    views = F.sequence(F.greatest("form", "doc_form"), F.lit(EXACT))
    met = met.withColumn("view", F.explode(views)).withColumn("windows", F.when(F.col("view") == EXACT, F.col("windows")).otherwise(F.col("rich")))
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    occurrences = met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "view").agg(
        F.max("windows").alias("windows"),
        F.count_distinct("item_pos").alias("matched"),
        F.count_distinct(F.when(F.col("item_slots") == F.col("doc_slots"), F.col("item_pos"))).alias("equal"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.i")))
    need = F.least(F.ceil(F.col("windows") / 2), F.lit(RUN))
    counted = occurrences.select("doc_id", "item_id", "windows", F.when(consistent, F.col("matched")).otherwise(F.col("equal")).alias("matched"))
    return (
        counted.where(F.col("matched") >= need)
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"))
    )


def verdicts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted) per row of docs."""
    hits = common.save(
        contaminations(docs, items).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")), "hits"
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    none = F.array().cast("array<bigint>")
    return ids.join(hits, "doc_id", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )
