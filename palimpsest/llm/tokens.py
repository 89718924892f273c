"""Token ids of whole texts, stored as directly addressable codes.

``CachedTokenizer`` gives exactly the ids of a public tokenizer. Both kinds it
knows cut a text at white space before they merge, so the ids of a word do not
depend on its neighbours: each distinct word is tokenized once per worker. The
file's added tokens (``<|endoftext|>``) that stand in a text get the file's ids
for them, as from the library; ``special=False`` makes them ordinary text.

``DirectCodes`` is the file format. An id is cut into chunks of eight bits,
lowest first. Level 0 holds the first chunk of every id, level 1 the second
chunk of those ids that have one, and so on; a bitmap per level says whether an
id continues, and a rank directory (set bits before every 512th) finds the
place on the next level. Any id is read with one chunk and one rank per level,
without decoding a block.

Files are rows (part, shard, start_in_part, doc_ids, blob) of a Parquet table,
written by Spark, hence on any file system; a shard holds consecutive documents
in ascending doc_id order.

Defined results: null text counts as empty (only the end id); a null doc_id
sorts first; repeated rows are written as often as they come; an empty table
gives no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Words whose ids a worker keeps; later words are tokenized anew in each batch.
CACHE_WORDS = 700_000
#: Words up to this many characters are kept.
CACHE_CHARS = 64
#: Chunks that go to the library in one text.
JOINED = 32
#: Bytes of text that one call works on.
BATCH_BYTES = 8 << 20

_SPACE_PAIR = re.compile(r"\s\s")
_CHUNK = re.compile(r"(?<=\S)(?=[ ]\S)")


@lru_cache(4096)
def _stays_letter(char: str) -> bool:
    """Whether a letter is followed by no mark once it is normalized and in lower case."""
    return char.isalpha() and unicodedata.normalize("NFC", char).lower()[-1].isalpha()


class CachedTokenizer:
    """Ids of a tokenizers file, word by word.

    spaced: the file's pre-tokenizer keeps one space with the word after it
    (byte-level BPE); else white space is dropped (BPE with word ends).
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        self.spaced = pre.get("type") == "ByteLevel"
        if not self.spaced and pre.get("pretokenizers", [{}])[0].get("behavior") != "Removed":
            raise ValueError(f"{path}: this pre-tokenizer may join words; it is not supported")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or not special and not all(t["special"] for t in added):
            raise ValueError(f"{path}: added tokens that match other than literally are not supported")
        longest = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, longest))})") if special and longest else None
        self.between = next(filter(self._parts, self.added), None) if self.at_added else None
        if self.between is not None:
            (self.between_id,) = struct.unpack("<I", self.added[self.between])
        self.cache: dict[str, bytes] = {}

    def _parts(self, token: str) -> bool:
        """Whether an added token between two texts is found there, whatever the texts are."""
        overlap = lambda a, b: any(b.startswith(a[i:]) for i in range(1, len(a)))
        return not any(overlap(token, t) or overlap(t, token) or (t != token and token in t) for t in self.added)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; many go to the library in one text, with an added token between them that none of them holds."""
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        joined = JOINED if self.between is not None else 1
        texts = [(self.between or "").join(chunks[i : i + joined]) for i in range(0, len(chunks), joined)]
        out: list[bytes] = []
        for at in range(0, len(texts), 4096 // joined):
            for e in encode(texts[at : at + 4096 // joined], add_special_tokens=False):
                ids = np.array(e.ids, dtype="<u4")
                data, begin = ids.tobytes(), 0
                if self.between is not None:
                    for end in (4 * np.flatnonzero(ids == self.between_id)).tolist():
                        out.append(data[begin:end])
                        begin = end + 4
                out.append(data[begin:])
        return out

    def _add(self, words: Iterable[str], local: dict[str, bytes]) -> None:
        """Put the ids of new words into ``local``; a final point or comma is a token of its own."""
        stems: dict[str, None] = {}
        split: list[tuple[str, str, str]] = []
        for w in words:
            if len(w) > 2 and w[-1] in ".," and _stays_letter(w[-2]):
                split.append((w, w[:-1], w[-1]))
                stems[w[:-1]] = None
            else:
                stems[w] = None
        stems.setdefault(".")
        stems.setdefault(",")
        new = []
        for s in stems:
            ids = self.cache.get(s)
            if ids is None:
                new.append(s)
            else:
                local[s] = ids
        local.update(zip(new, self._ids(new), strict=True))
        for w, stem, end in split:
            local[w] = local[stem] + local[end]
        if len(self.cache) < CACHE_WORDS:
            for w, ids in local.items():
                if len(w) <= CACHE_CHARS:
                    self.cache[w] = ids
                    if len(self.cache) >= CACHE_WORDS:
                        break

    def _cut(self, text: str) -> list[str]:
        """Chunks whose ids, one after another, are the text's ids."""
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if not text:
            return []
        if _SPACE_PAIR.search(text) or text[0].isspace() or text[-1].isspace() or "\x00" in text:
            return _CHUNK.split(text)
        # Every white space stands alone: a space goes with the next word, a line end is a chunk.
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.at_added is None or not any(x in t for t in texts for x in self.added):
            return self._encode(texts)
        # Added tokens cut a text before anything else; what is between them stands alone.
        split = [self.at_added.split(t) for t in texts]
        between = iter(self._encode([x for own in split for x in own[::2]]))
        return [b"".join(self.added[x] if i % 2 else next(between) for i, x in enumerate(own)) for own in split]

    def _encode(self, texts: list[str]) -> list[bytes]:
        get = self.cache.get
        out: list[bytes] = []
        held: list[tuple[int, list[bytes | None], list[int], list[str]]] = []
        new: dict[str, None] = {}
        for n, text in enumerate(texts):
            words = self._cut(text)
            found = list(map(get, words))
            try:
                out.append(b"".join(found))
            except TypeError:  # a word without ids yet
                out.append(b"")
                places = [i for i, ids in enumerate(found) if ids is None]
                missing = [words[i] for i in places]
                held.append((n, found, places, missing))
                new.update(dict.fromkeys(missing))
        if held:
            local: dict[str, bytes] = {}
            self._add(new, local)
            for n, found, places, missing in held:
                for i, w in zip(places, missing, strict=True):
                    found[i] = local[w]
                out[n] = b"".join(found)
        return out


def tokenizer(path: str) -> CachedTokenizer:
    """The worker's tokenizer for a file; it lives as long as the worker."""
    return common.worker_state("tokenizer", path, lambda: CachedTokenizer(path))


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_id, ids with the end id) for Arrow batches of doc_id, text."""
    tok = tokenizer(path)
    end = struct.pack("<I", end_id)
    for ids, text in common.rows_of(batches, ("doc_id", "text"), "text", BATCH_BYTES):
        yield ids, [x + end for x in tok.encode([t or "" for t in text.to_pylist()])]


class DirectCodes:
    """A sequence of unsigned integers under 2^32 with random access."""

    MAGIC = b"DAC1"
    BLOCK = 512
    _POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        #: per level: chunks, continuation bitmap (bytes, lowest bit first), rank directory
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> bytes:
        """The codes of ids as bytes."""
        rest = np.ascontiguousarray(ids, dtype=np.uint32)
        out = [b""]
        n_levels = 0
        while True:
            more = rest > 0xFF
            chunks = (rest & 0xFF).astype(np.uint8)
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (cls.BLOCK // 8), np.uint8)])
            counts = cls._POP[bits].reshape(-1, cls.BLOCK // 8).sum(axis=1) if len(bits) else np.zeros(0, np.uint32)
            ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
            out += [struct.pack("<Q", len(rest)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
            n_levels += 1
            if not more.any():
                break
            rest = rest[more] >> np.uint32(8)
        out[0] = cls.MAGIC + struct.pack("<I", n_levels)
        return b"".join(out)

    @classmethod
    def read(cls, blob: bytes) -> DirectCodes:
        if blob[:4] != cls.MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (n_levels,) = struct.unpack_from("<I", blob, 4)
        at, levels = 8, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            blocks = -(-n // cls.BLOCK)
            bits = np.frombuffer(blob, np.uint8, blocks * cls.BLOCK // 8, at)
            at += len(bits)
            ranks = np.frombuffer(blob, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            levels.append((chunks, bits, ranks))
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // self.BLOCK
            upto = bits[block * self.BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(self._POP[upto].sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value = None
        for k in range(len(self.levels) - 1, -1, -1):
            chunks, bits, _ = self.levels[k]
            own = chunks.astype(np.uint32)
            if value is not None and len(value):
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                own[more] |= value << np.uint32(8)
            value = own
        return value


SHARDS = "part int, shard int, start_in_part bigint, doc_ids array<bigint>, ends array<bigint>, blob binary"


def write_codes(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = 2_000_000) -> DataFrame:
    """Encode documents in ascending doc_id order into the file format at ``path``.

    Rows are dealt by ranges of (doc_id, text hash), so rows that share an id
    need not share a task. Returns the files, read back.
    """
    spark = docs.sparkSession
    common.ship(spark)
    h = F.xxhash64("text")

    def write(batches):
        part = TaskContext.get().partitionId()
        shard, start, n = 0, 0, 0
        ids: list = []
        held: list[bytes] = []

        def flush():
            nonlocal shard, start, ids, held, n
            ends = np.cumsum([len(x) // 4 for x in held], dtype=np.int64)
            blob = DirectCodes.encode(np.frombuffer(b"".join(held), dtype="<u4"))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([ends], pa.list_(pa.int64())),
                    pa.array([blob], pa.binary()),
                ],
                names=["part", "shard", "start_in_part", "doc_ids", "ends", "blob"],
            )
            shard, start, ids, held, n = shard + 1, start + int(ends[-1]), [], [], 0
            return row

        for doc_ids, codes in encoded(batches, tokenizer_path, end_id):
            for doc_id, x in zip(doc_ids.to_pylist(), codes, strict=True):
                ids.append(doc_id)
                held.append(x)
                n += len(x) // 4
                if n >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    dealt = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.utf8("text").alias("text"))
        .repartitionByRange(common.parts(spark), "doc_id", h)
        .sortWithinPartitions("doc_id", h)
    )
    common.write(dealt.mapInArrow(write, SHARDS), path)
    return spark.read.schema(SHARDS).parquet(path)


def read_codes(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids."""
    spark = files.sparkSession
    # One number per range partition, not per row: bounded by the partition count.
    totals = files.groupBy("part").agg(F.max(F.col("start_in_part") + F.element_at("ends", -1)).alias("n")).collect()
    base, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        base[row["part"]] = at
        at += row["n"]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = DirectCodes.read(row["blob"]).all().astype("<u4")
                ends = np.array(row["ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + base[row["part"]] + row["start_in_part"], pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not base:
        return spark.createDataFrame([], schema)
    return files.mapInArrow(read, schema)
