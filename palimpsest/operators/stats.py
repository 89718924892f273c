"""Numbers that a run leaves behind: ingest statistics and observed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Status letters of items (fixed values).
STATUS = {"A": "added", "M": "modified", "U": "unchanged", "C": "changed while read", "h": "hard link", "d": "directory", "s": "symlink", "f": "fifo", "c": "character device", "b": "block device", "E": "error", "-": "excluded"}


def ingest_stats(items: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: files, original size, chunks, new chunks and their size, for items (status, size) and chunks (chunk_id, size)."""
    files = items.agg(F.count("*").alias("nfiles"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("original_size"))
    known = index.select("chunk_id", F.lit(True).alias("known"))
    per_chunk = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("size").alias("size")).join(known, "chunk_id", "left")
    new = F.col("known").isNull()
    sums = per_chunk.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("chunks"),
        F.count_if(new).alias("new_chunks"),
        F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).cast("bigint").alias("new_size"),
    )
    return files.join(F.broadcast(sums))


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("files"))


def observed(rows: DataFrame, name: str, size: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation of their count and bytes that costs no pass of its own."""
    watch = Observation(name)
    return rows.observe(watch, F.count(F.lit(1)).alias("calls"), F.sum(size).alias("volume")), watch


def hit_ratio(hits: int, misses: int) -> float:
    return hits / (hits + misses) if hits + misses else 0.0
