"""What snapshots cost after deduplication, and where they change.

References are rows (archive_id, name, chunk_id, size, ...); the index is one row
per stored chunk (chunk_id, obj_size). Every function reduces references to one
row per chunk with a map-side combined aggregate before it joins the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARED, UNREFERENCED = "shared", "unreferenced"


def by_name(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Each chunk counted once: under the one name that refers to it, else shared, else unreferenced.

    Columns: name, archives (of that name, null for the buckets), chunks, source_size, stored_size.
    """
    # min = max of the name says "one name only" without a distinct count.
    per_chunk = refs.groupBy("chunk_id").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.max("size").alias("size"))
    bucket = F.when(F.col("low").isNull(), UNREFERENCED).when(F.col("low") == F.col("high"), F.col("low")).otherwise(SHARED)
    sums = (
        index.join(per_chunk, "chunk_id", "left")
        .select(bucket.alias("name"), F.coalesce("size", F.lit(0)).alias("size"), "obj_size")
        .groupBy("name")
        .agg(F.count("*").alias("chunks"), F.sum("size").alias("source_size"), F.sum("obj_size").alias("stored_size"))
    )
    archives = refs.select("name", "archive_id").distinct().groupBy("name").agg(F.count("*").alias("archives"))
    return archives.join(sums, "name", "full_outer").select(
        "name",
        "archives",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("chunks", "source_size", "stored_size")],
    )


def of_set(refs: DataFrame, index: DataFrame, considered: Column) -> DataFrame:
    """One row: deduplicated, exclusive and unreferenced sizes of the considered references, totals, missing.

    exclusive is null when nothing else refers to anything (the set is the whole repository).
    """
    per_chunk = refs.groupBy("chunk_id").agg(
        F.max("size").alias("size"),
        F.max(considered.cast("int")).alias("mine"),
        F.max((~considered).cast("int")).alias("rest"),
        F.sum(considered.cast("int")).alias("n_refs"),
    )
    # A reference without an index row is missing; an index row without one is unreferenced.
    both = index.join(per_chunk, "chunk_id", "full_outer")
    mine = (F.col("mine") == 1) & F.col("obj_size").isNotNull()
    only = mine & (F.col("rest") == 0)
    none = F.col("mine").isNull()
    part = lambda cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint")
    whole = F.coalesce(F.max("rest"), F.lit(0)) == 0
    return both.agg(
        whole.alias("whole_repository"),
        part(mine, "size").alias("source_size"),
        part(mine, "obj_size").alias("stored_size"),
        F.when(~whole, part(only, "size")).alias("exclusive_source"),
        F.when(~whole, part(only, "obj_size")).alias("exclusive_stored"),
        F.count_if(none).alias("unreferenced_chunks"),
        part(none, "obj_size").alias("unreferenced_stored"),
        F.count("obj_size").alias("total_chunks"),
        part(F.col("obj_size").isNull() & (F.col("mine") == 1), "n_refs").alias("missing_references"),
    )


def unreferenced(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows that no reference names."""
    return index.join(refs.select("chunk_id"), "chunk_id", "left_anti")


def hotspots(refs: DataFrame, limit: int | None = 20) -> DataFrame:
    """directory, size: bytes of the symmetric difference of (directory, chunk) sets of time-adjacent archives.

    Snapshots are numbered by time; a (directory, chunk) held by snapshot i is
    noted at boundaries i and i + 1. Inside, a boundary noted once is a change.
    This needs no join of consecutive snapshots.
    """
    times = refs.select("archive_id", "time").distinct()
    # One row per snapshot: numbering them is a small global sort.
    numbered = times.select("archive_id", (F.row_number().over(Window.orderBy("time", "archive_id")) - 1).alias("i"))
    n = numbered.agg(F.max("i").alias("last"))
    held = refs.groupBy("archive_id", "directory", "chunk_id").agg(F.max("size").alias("size")).join(numbered, "archive_id")
    edges = held.select("directory", "chunk_id", "size", F.explode(F.array("i", F.col("i") + 1)).alias("b"))
    inner = edges.join(F.broadcast(n)).where((F.col("b") >= 1) & (F.col("b") <= F.col("last")))
    changed = inner.groupBy("directory", "chunk_id", "b").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n = 1")
    out = changed.groupBy("directory").agg(F.sum("size").cast("bigint").alias("size"))
    return out.orderBy(F.desc("size"), "directory").limit(limit) if limit is not None else out


def compression_factor(stored: Column, source: Column) -> Column:
    """stored / source; null ("n/a") when nothing was stored from a source."""
    return F.when(source != 0, stored / source)


def content_size(chunks: Column) -> Column:
    """Sum of the chunk sizes of an item; 0 for a null or empty list."""
    return F.coalesce(F.aggregate(chunks, F.lit(0).cast("bigint"), lambda a, c: a + c["size"]), F.lit(0).cast("bigint"))


def approximate_dedup(refs: DataFrame) -> DataFrame:
    """name, references, about how many distinct chunks: the estimate that needs no exact set."""
    return refs.groupBy("name").agg(F.count("*").alias("references"), F.approx_count_distinct("chunk_id").alias("chunks"))
