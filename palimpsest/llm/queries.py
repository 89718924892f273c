"""The opN_<name> queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, common, decontam, langid, linededup, packing, pii, simhash, suffixdedup, tokens, toxicity
from palimpsest.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.decisions(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_root(spark)}/codes-{uuid.uuid4().hex}"
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokens.read_codes(tokens.write_codes(table(spark, sf_dir, "documents"), path, vocabulary, end_id=1))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest five of every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, end_id=0, capacity=2048)


def queries() -> dict[str, Query]:
    own = (
        op1_line_dedup, op2_toxicity, op3_decontamination, op4_suffix_dedup, op5_langid, op6_token_codes, op7_pii, op8_neighbours, op9_simhash, op10_packing,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_dedup": suffixdedup.ORACLE_SQL, "op7_pii": pii.ORACLE_SQL}
