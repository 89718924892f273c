"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns
the next stage's documents, the last one the packed pieces. Each stage works on
all that the one before kept. No stage is expressible in SQL as a whole (the
first is a trained classifier), so ORACLE_SQL is None and the tests compare the
stages with brute force.

Rows without doc_id stay through the filtering stages, unless toxic or
contaminated, and are packed with a null doc_id; repeated rows of a doc_id end
in the near-duplicate stage, where one of them stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, decontam, linededup, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = common.table(spark, sf_dir, "labels")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    scored = toxicity.score(whole, labels, keep=("row",), row="row")
    return scored.where("predicted = 0").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, exactly or nearly, an earlier line."""
    return linededup.apply(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group.

    Of rows that share this doc_id within their groups, the one whose text has
    the smallest hash stays; of rows equal in both, the smallest row.
    """
    found = common.save(simhash.near_duplicates(docs), "near")
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("first_id")).agg(F.min("h").alias("first_h"), F.count("*").alias("n"))
    first = common.save(first, "first")
    common.discard(found)
    own_id, own_h = docs["doc_id"].cast("bigint"), F.xxhash64(common.utf8(docs["text"]))
    kept = docs.join(first, (own_id == F.col("first_id")) & (own_h == F.col("first_h")), "left_semi")
    if not first.where("n > 1").isEmpty():
        whole = kept.select(F.struct(*docs.columns).alias("row"))
        kept = whole.groupBy(F.col("row.doc_id").alias("own_id")).agg(F.min("row").alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other numbers, names or units."""
    benchmark = common.table(spark, sf_dir, "benchmark")

    def clean(rows: DataFrame, own: Column) -> DataFrame:
        hits = decontam.contaminations(rows.select(own.alias("doc_id"), "text"), benchmark)
        bad = common.save(hits.select(F.col("doc_id").alias("bad_id")).distinct(), "bad")
        return rows.join(bad, own == F.col("bad_id"), "left_anti")

    kept = clean(docs.where("doc_id is not null"), F.col("doc_id").cast("bigint"))
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    # Rows without an id are told apart by their texts.
    return kept.unionByName(clean(nameless, F.xxhash64(common.utf8("text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as best-fit packing finds."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
