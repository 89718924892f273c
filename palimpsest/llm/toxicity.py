"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of a hashed table, so two words are
confused only if both rows collide. Filters of one to three words slide over
the whole text; each keeps its largest response; a logistic layer scores them.
Training (Adam, on the driver) uses a bounded sample of labelled documents,
``SAMPLE`` per label. The first embedding dimension starts from shrunken
log-odds of the table rows in the sample, the rest from small random numbers.

Thresholds are calibrated by language on a part of the sample that training
does not see. The language is guessed from the text alone, by unigrams over the
same hashed words; scores are rescaled piecewise so that each language's
threshold becomes 0.5.

Defined results: null and wordless texts are scored like an empty text; without
labels of both kinds every score is 0; of several labels of a doc_id the
largest counts; repeated rows get equal results; doc_id, lang and source are
never inputs of a score, and other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Most labelled documents of each label that the model is fitted on.
SAMPLE = {0: 4000, 1: 2500}
#: Bytes of text that are learned from at most; a document that goes beyond is passed over.
SAMPLE_BYTES = 24 << 20
CALIBRATION = 0.25
ROWS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
BATCH = 64
RATE = 0.01
SHRINK = 8.0
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class WordIds:
    """Two table rows for each word, with a bounded cache."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = {w for w in words if w not in known}
        digest = xxhash.xxh64_intdigest
        ids = {w: digest(w.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF for w in new}
        if len(known) + len(ids) <= CACHE_WORDS:
            known.update(ids)
            return np.array([known[w] for w in words], dtype=np.int64)
        return np.array([i if (i := known.get(w)) is not None else ids[w] for w in words], dtype=np.int64)


PAD = 2 * ROWS  # a row of zeros after the table


def rows_of_texts(texts: list[str], ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rows, second rows, starts): texts one after another, each followed by padding."""
    pad = max(WIDTHS)
    cut = [words_of(t) for t in texts]
    sizes = np.array([len(w) + pad for w in cut], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = ids([w for words in cut for w in words])
    where = np.ones(int(starts[-1]), dtype=bool)
    for k in range(1, pad + 1):
        where[starts[1:] - k] = False
    a, b = np.full(len(where), PAD, np.int64), np.full(len(where), PAD, np.int64)
    a[where] = flat & (ROWS - 1)
    b[where] = ROWS + (flat >> 16 & (ROWS - 1))
    return a, b, starts[:-1]


class Model:
    """Table, filters and logistic layer; language unigrams and thresholds."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (2 * ROWS + 1, DIM)).astype(np.float32)
        self.table[PAD] = 0
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0, : FILTERS // 2] += 0.5
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out_bias = np.float32(-1.0)
        self.langs: list[str] = []
        self.lang_table = np.zeros((ROWS, 0), np.float32)
        self.thresholds = np.zeros(0)

    def responses(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray):
        """Embeddings, and each filter's response at each place."""
        x = self.table[a] + self.table[b]
        out = np.empty((len(x), len(self.bias)), np.float32)
        for k, f in enumerate(self.filters):
            y = out[:, k * FILTERS : (k + 1) * FILTERS]
            np.matmul(x, f[0], out=y)
            for j in range(1, len(f)):
                y[:-j] += x[j:] @ f[j]
        return x, out

    def logits(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        _, y = self.responses(a, b, starts)
        pooled = np.maximum(np.maximum.reduceat(y, starts, axis=0) + self.bias, 0)
        return pooled @ self.out + self.out_bias

    def languages(self, a: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not self.langs:
            return np.zeros(len(starts), np.int64)
        table = np.vstack([self.lang_table, np.zeros((1, len(self.langs)), np.float32)])
        return np.add.reduceat(table[np.minimum(a, ROWS)], starts, axis=0).argmax(axis=1)

    def scores(self, texts: list[str], ids: WordIds) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        a, b, starts = rows_of_texts(texts, ids)
        p = 1 / (1 + np.exp(-self.logits(a, b, starts).astype(np.float64)))
        t = self.thresholds[self.languages(a, starts)] if len(self.thresholds) else 0.5
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def _log_odds(model: Model, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """First embedding dimension: half the shrunken log-odds of each row of the table."""
    seen = np.zeros((2, 2 * ROWS + 1))
    for rows, y in zip(docs, labels, strict=True):
        seen[int(y), np.unique(rows)] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    total = seen.sum(axis=0)
    model.table[:, 0] = 0.5 * odds * total / (total + SHRINK)
    model.table[PAD] = 0


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in self.m:
            self.m[name], self.v[name] = np.zeros_like(value), np.zeros_like(value)
        at = rows if rows is not None else slice(None)
        m, v = self.m[name], self.v[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.999**self.t)) + 1e-8)


def _train(model: Model, texts: list[str], labels: np.ndarray, ids: WordIds, seed: int = 7) -> None:
    docs = []
    for t in texts:
        a, b, _ = rows_of_texts([t], ids)
        docs.append((a, b))
    _log_odds(model, [np.concatenate(d) for d in docs], labels)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    adam = _Adam(RATE)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            sizes = np.array([len(docs[k][0]) for k in own])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            a, b = (np.concatenate([docs[k][j] for k in own]) for j in (0, 1))
            x, y = model.responses(a, b, starts)
            best = np.maximum.reduceat(y, starts, axis=0)
            # Place of each filter's largest response in each document.
            place = np.empty(best.shape, np.int64)
            for d, (s, n) in enumerate(zip(starts, sizes, strict=True)):
                place[d] = s + y[s : s + n].argmax(axis=0)
            pooled = np.maximum(best + model.bias, 0)
            p = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias)))
            g = ((p - labels[own]) * weight[own] / len(own)).astype(np.float32)
            adam.t += 1
            gp = g[:, None] * model.out * (pooled > 0)
            rows, grads = [], []
            for k, f in enumerate(model.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                at, gk = place[:, cols], gp[:, cols]
                gf = np.empty_like(f)
                for j in range(len(f)):
                    here = np.minimum(at + j, len(x) - 1)
                    gf[j] = np.einsum("dfe,df->ef", x[here], gk)
                    ge = gk[:, :, None] * f[j].T[None]
                    for side in (a, b):
                        rows.append(side[here].ravel())
                        grads.append(ge.reshape(-1, DIM))
                adam.step(f"filter{k}", f, gf)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            real = rows != PAD
            unique, inverse = np.unique(rows[real], return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, grads[real])
            adam.step("table", model.table, total, unique)
            adam.step("bias", model.bias, gp.sum(axis=0))
            adam.step("out", model.out, g @ pooled)
            bias = np.array([model.out_bias], np.float32)
            adam.step("out_bias", bias, np.array([g.sum()], np.float32))
            model.out_bias = bias[0]


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the best F1; between the scores on its two sides."""
    order = np.argsort(-p, kind="stable")
    ps, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(ps) + 1) + y.sum())
    f1[:-1][ps[1:] == ps[:-1]] = -1
    k = int(np.argmax(f1))
    after = ps[k + 1] if k + 1 < len(ps) else 0.0
    return float(np.clip((ps[k] + after) / 2, 0.02, 0.98))


def fit(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 7) -> Model:
    """Train on three quarters of the sample, calibrate thresholds on the rest."""
    y = np.array(labels, dtype=np.float32)
    ids, model = WordIds(), Model(seed)
    held = np.array([xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % 1000 < 1000 * CALIBRATION for t in texts], dtype=bool)
    if y[~held].sum() == 0 or (1 - y[~held]).sum() == 0 or y[held].sum() == 0:
        held[:] = False
    _train(model, [t for t, h in zip(texts, held, strict=True) if not h], y[~held], ids, seed)
    # Unigrams of each language for the guess from text.
    model.langs = sorted({x for x in langs if x is not None})
    if model.langs:
        counts = np.full((ROWS, len(model.langs)), 0.1)
        for t, lang in zip(texts, langs, strict=True):
            if lang is not None:
                a, _, _ = rows_of_texts([t], ids)
                np.add.at(counts[:, model.langs.index(lang)], a[a < ROWS], 1)
        model.lang_table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    cal = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    a, b, starts = rows_of_texts([texts[i] for i in cal], ids)
    p = 1 / (1 + np.exp(-model.logits(a, b, starts).astype(np.float64)))
    guess = model.languages(a, starts)
    whole = _best_threshold(p, y[cal])
    model.thresholds = np.full(max(1, len(model.langs)), whole)
    for k in range(len(model.langs)):
        own = guess == k
        n1 = y[cal][own].sum()
        if n1 >= 5 and own.sum() - n1 >= 5:
            # Few positives say little: pull towards the common threshold.
            model.thresholds[k] = (n1 * _best_threshold(p[own], y[cal][own]) + 20 * whole) / (n1 + 20)
    return model


def sample(docs: DataFrame, labels: DataFrame, bound: dict[int, int] | None = None) -> list[tuple[str, int, str | None]]:
    """At most ``bound`` labelled texts of each label that may be learned from, by hash order."""
    bound = bound or SAMPLE
    given = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(common.crc_bucket("doc_id", 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("toxic") == y, F.lit(min(1.0, 1.2 * bound[y] / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = given.withColumn("draw", draw).where(F.col("draw") < share * 1_000_000).collect()
    kept, used = [], {0: 0, 1: 0}
    for r in sorted(chosen, key=lambda r: (r["draw"], r["doc_id"])):
        if used[r["toxic"]] < bound[r["toxic"]]:
            used[r["toxic"]] += 1
            kept.append((r["doc_id"], r["toxic"]))
    if not kept:
        return []
    spark = docs.sparkSession
    few = spark.createDataFrame(kept, "doc_id bigint, toxic int")  # at most sum(bound) rows
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(common.utf8("text").alias("text"), F.col("lang").cast("string").alias("lang")).alias("own"))
    # One row per id, of those that share it the one of the smallest text; then ids in hash order as far as the bytes go.
    one = common.save(own.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("own").alias("own")).select("doc_id", "toxic", "own.*"), "sample")
    sizes = {r["doc_id"]: r["n"] for r in one.select("doc_id", F.octet_length("text").alias("n")).collect()}
    chosen = common.within(((i, sizes[i]) for i, _ in kept if i in sizes), SAMPLE_BYTES)
    picked = one.join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id bigint")), "doc_id", "left_semi").orderBy("doc_id").collect()
    common.discard(one)
    return [(r["text"], r["toxic"], r["lang"]) for r in picked]


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), row: str | None = None) -> DataFrame:
    """The kept columns, held_out, score and predicted, per row of docs.

    row: a kept struct column whose field ``text`` is the text, so that it travels once.
    """
    spark = docs.sparkSession
    common.ship(spark)
    fitted = sample(docs, labels)
    kinds = {y for _, y, _ in fitted}
    model = fit([t for t, _, _ in fitted], [y for _, y, _ in fitted], [x for _, _, x in fitted]) if kinds == {0, 1} else None
    shared = spark.sparkContext.broadcast(model)  # the table's size, whatever the corpus size
    key = uuid.uuid4().hex

    texts = () if row else (common.utf8("text").alias("scored_text"),)
    given = docs.select(*keep, (common.crc_bucket("doc_id", 5) == 0).alias("held_out"), *texts)
    schema = given.drop("scored_text").schema.add("score", "double").add("predicted", "integer")
    names = [f.name for f in schema.fields[:-2]]

    def run(batches):
        own = shared.value
        ids = common.worker_state("toxicity", key, WordIds)
        if row:
            batches = common.with_field(batches, row, "text", "scored_text")
        for *cols, text in common.rows_of(batches, (*names, "scored_text"), "scored_text", 2 << 20):
            texts = [t or "" for t in text.to_pylist()]
            p = own.scores(texts, ids) if own is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return given.mapInArrow(run, schema)
