"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words, and the prediction
is the language of largest posterior under equal priors. Piece probabilities
come from expectation-maximisation (forward-backward) on a bounded sample of
labelled documents, ``SAMPLE_DOCS`` per language.

A word is a run of letters in lower case, begun by the vocabulary's word mark;
runs over ``WORD_CHARS`` letters are cut into words of that length. Characters
without a piece have one small probability in every language. Words are scored
once per worker as long as ``CACHE_WORDS`` has room.

Defined results: ``und`` with score 0 where text is null or has no letter, and
for all rows where no labelled document may be learned from; ties go to the
language that sorts first; repeated rows get equal results; other columns,
lang, source and doc_id among them, are never inputs of a prediction.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

SAMPLE_DOCS = 400
#: Bytes of text that are learned from at most, in equal shares of the languages.
SAMPLE_BYTES = 24 << 20
EM_ROUNDS = 4
WORD_CHARS = 24
SMOOTHING = 0.05
UNKNOWN = 1e-6
CACHE_WORDS = 1_000_000
MARK = "▁"

_LETTERS = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-case letter runs of at most WORD_CHARS letters."""
    found = _LETTERS.findall(text.lower())
    if any(len(w) > WORD_CHARS for w in found):
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


class Pieces:
    """Vocabulary pieces, found by hash at every place of many words at once."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.tables = []
        rest = np.arange(len(pieces))
        salt = 1
        while len(rest):  # keys that meet another one go to the next table
            mul = np.uint64(int(_MUL) * (2 * salt + 1) & (2**64 - 1))
            slot = (keys[rest] * mul) >> np.uint64(64 - self.BITS)
            _, first = np.unique(slot, return_index=True)
            table_key = np.zeros(1 << self.BITS, np.uint64)
            table_id = np.full(1 << self.BITS, -1, np.int32)
            table_key[slot[first]] = keys[rest[first]]
            table_id[slot[first]] = rest[first]
            self.tables.append((mul, table_key, table_id))
            rest = np.delete(rest, first)
            salt += 1

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MUL) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, codes: np.ndarray) -> np.ndarray:
        """(word, start, length - 1) -> piece or -1, for code points padded with zeros."""
        n, width = codes.shape
        longest = min(self.longest, width)
        out = np.full((n, width, longest), -1, np.int32)
        h = np.zeros((n, width), np.uint64)
        for size in range(1, longest + 1):
            stop = width - size + 1
            h = h[:, :stop] * _MUL + (codes[:, size - 1 :] + np.uint64(1))
            found = np.full(h.shape, -1, np.int32)
            for mul, table_key, table_id in self.tables:
                slot = (h * mul) >> np.uint64(64 - self.BITS)
                found = np.where((found < 0) & (table_key[slot] == h), table_id[slot], found)
            found[codes[:, size - 1 :] == 0] = -1
            out[:, :stop, size - 1] = found
        return out


def vocabulary(model_path: str) -> list[str]:
    """Pieces of a sentencepiece model, in lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    seen: dict[str, None] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).lower()
            if all(c == MARK or c.isalpha() for c in piece):
                seen[piece] = None
    return list(seen)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of marked words, one row each, padded with zeros."""
    width = max(map(len, words)) + 1
    flat = "".join((MARK + w).ljust(width, "\0") for w in words)
    return np.frombuffer(flat.encode("utf-32-le"), dtype="<u4").astype(np.uint64).reshape(len(words), width)


def _blocks(words: list[str], most: int = 20_000):
    """Words of similar length together: (indexes, code points)."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(words), most):
        own = order[i : i + most]
        yield own, _codes([words[k] for k in own])


class Model:
    """Piece probabilities of each language; the last row is the unknown character."""

    def __init__(self, langs: list[str], pieces: Pieces, probs: np.ndarray):
        self.langs, self.pieces = langs, pieces
        self.probs = np.vstack([probs, np.full((1, probs.shape[1]), UNKNOWN)])

    def _steps(self, codes: np.ndarray):
        found = self.pieces.find(codes)
        there = codes != 0
        found[:, :, 0] = np.where((found[:, :, 0] < 0) & there, len(self.probs) - 1, found[:, :, 0])
        return found, there.sum(axis=1)

    def forward(self, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
        n, width = codes.shape
        alpha = np.zeros((width + 1, n, self.probs.shape[1]))
        alpha[0] = 1.0
        for j in range(1, width + 1):
            for size in range(1, min(self.pieces.longest, j) + 1):
                p = found[:, j - size, size - 1]
                rows = np.flatnonzero(p >= 0)
                if len(rows):
                    alpha[j][rows] += alpha[j - size][rows] * self.probs[p[rows]]
        return alpha

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """(word, language): log of the sum over all segmentations."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float64)
        for own, codes in _blocks(words):
            found, sizes = self._steps(codes)
            out[own] = np.log(self.forward(codes, found)[sizes, np.arange(len(own))] + 1e-300)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of a one-language model (forward-backward)."""
        total = np.zeros(len(self.probs))
        for own, codes in _blocks(words):
            found, sizes = self._steps(codes)
            n, width = codes.shape
            alpha = self.forward(codes, found)[:, :, 0]
            beta = np.zeros((width + 1, n))
            beta[sizes, np.arange(n)] = 1.0
            whole = alpha[sizes, np.arange(n)]
            weight = counts[own] / np.maximum(whole, 1e-300)
            for i in range(width - 1, -1, -1):
                for size in range(1, min(self.pieces.longest, width - i) + 1):
                    p = found[:, i, size - 1]
                    rows = np.flatnonzero((p >= 0) & (i + size <= sizes))
                    if len(rows):
                        step = self.probs[p[rows], 0] * beta[i + size][rows]
                        beta[i][rows] += step
                        np.add.at(total, p[rows], alpha[i][rows] * step * weight[rows])
        return total[:-1]


def fit(samples: dict[str, list[str]], model_path: str) -> Model:
    """EM of every language's piece probabilities on its sample of texts."""
    pieces = Pieces(vocabulary(model_path))
    n = len(pieces.pieces)
    columns = []
    for lang in sorted(samples):
        count: dict[str, int] = {}
        for text in samples[lang]:
            for w in words_of(text):
                count[w] = count.get(w, 0) + 1
        words, counts = list(count), np.array(list(count.values()), dtype=np.float64)
        probs = np.full((n, 1), 1.0 / n)
        for _ in range(EM_ROUNDS if words else 0):
            got = Model([lang], pieces, probs).expected(words, counts) + SMOOTHING
            probs = (got / got.sum())[:, None]
        columns.append(probs)
    return Model(sorted(samples), pieces, np.hstack(columns))


class Scorer:
    """Predictions for batches of texts, with word scores kept per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.slot: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(model.langs)), np.float32)

    def _rows(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        """Slots of words that the kept table lacks, and their scores."""
        new = list(words)
        scores = self.model.log_likelihood(new).astype(np.float32) if new else np.zeros((0, len(self.model.langs)), np.float32)
        keep = min(len(new), CACHE_WORDS - len(self.slot))
        at = len(self.slot)
        while at + keep > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + keep] = scores[:keep]
        self.slot.update(zip(new[:keep], range(at, at + keep), strict=True))
        return {w: i for i, w in enumerate(new[keep:])}, scores[keep:]

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        cut = [words_of(t) for t in texts]
        slot = self.slot
        extra, more = self._rows({w for words in cut for w in words if w not in slot})
        table = self.table if not len(more) else np.concatenate([self.table, more])
        base = len(self.table)
        langs, scores = [], []
        for words in cut:
            if not words or not has_letter(words):
                langs.append("und")
                scores.append(0.0)
                continue
            idx = [i if (i := slot.get(w)) is not None else base + extra[w] for w in words]
            total = table[idx].sum(axis=0, dtype=np.float64)
            best = int(np.argmax(total))
            langs.append(self.model.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """At most per_lang texts of each language among documents that may be learned from.

    The choice follows a hash of the row, so it does not depend on partitioning.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.crc_bucket("doc_id", 3) != 1)
    )
    counts = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return {}
    # Twice the expected need, one row per language and id, then exactly per_lang in hash order as far as the bytes go.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * per_lang / max(n, 1)))).otherwise(share)
    drawn = given.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))).where(F.col("draw") < share * 1_000_000)
    one = common.save(drawn.groupBy("lang", "draw", "doc_id").agg(F.min("text").alias("text")), "sample")
    rows = sorted(tuple(r) for r in one.select("lang", "draw", F.xxhash64("text"), F.octet_length("text")).collect())
    out: dict[str, list[str]] = {lang: [] for lang in counts}
    for lang in out:
        chosen = common.within(((r[:3], r[3]) for r in rows if r[0] == lang), SAMPLE_BYTES // len(counts))[:per_lang]
        if chosen:
            few = docs.sparkSession.createDataFrame(chosen, "lang string, draw bigint, h bigint")
            own = one.where(F.col("lang") == lang).withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["lang", "draw", "h"], "left_semi")
            out[lang] = [r["text"] for r in own.select("draw", "text").orderBy("draw", "text").limit(per_lang).collect()]
    common.discard(one)
    return out


def predict(docs: DataFrame, model_path: str, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row."""
    spark = docs.sparkSession
    common.ship(spark)
    samples = sample(docs, per_lang)
    model = fit(samples, model_path) if samples else None
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages, whatever the corpus size
    key = uuid.uuid4().hex

    def run(batches):
        own = shared.value
        scorer = common.worker_state("langid", key, lambda: Scorer(own)) if own is not None else None
        for ids, held, text in common.rows_of(batches, ("doc_id", "held_out", "text"), "text"):
            texts = text.to_pylist()
            langs, scores = scorer(texts) if scorer else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (common.crc_bucket("doc_id", 3) == 1).alias("held_out"), common.utf8("text").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
