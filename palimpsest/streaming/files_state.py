"""State of the files seen by earlier runs, and what it says about a new run.

A file is unchanged (U) if the compared fields equal the state's, modified (M)
otherwise, added (A) if the state lacks it. The next state keeps what the run
saw with age 0, ages the rest, drops what was not seen for ``ttl`` runs, and
leaves out entries written so late that a later write in the same clock tick
could go unnoticed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL = 2
LATE_NS = 3_000_000_000
#: Fields that a mode compares (fixed values); None: nothing is ever unchanged.
MODES = {"ctime": "ctime_ns", "mtime": "mtime_ns", "size": "size", "inode": "inode"}


def parse_mode(spec: str) -> tuple[str, ...] | None:
    """Compared fields of a mode such as ``ctime,size,inode``; None for rechunk and disabled."""
    words = spec.split(",")
    if words in (["disabled"], ["rechunk"]):
        return None
    unknown = [w for w in words if w not in MODES]
    if unknown or not ("ctime" in words) ^ ("mtime" in words):
        raise ValueError(f"{spec!r} is no files mode")
    return tuple(MODES[w] for w in words)


def path_key(path: Column) -> Column:
    """First 16 bytes of the path's SHA-256, in hex."""
    return F.left(F.sha2(path.cast("binary"), 256), F.lit(32))


def status(now: DataFrame, state: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """now with ``status``: A, M or U."""
    if fields is None:
        return now.withColumn("status", F.lit("A"))
    old = state.select(F.col("path_key").alias("old_key"), *[F.col(f).alias(f"old_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.coalesce(F.col(f) == F.col(f"old_{f}"), F.lit(False))
    letter = F.when(F.col("old_key").isNull(), "A").when(same, "U").otherwise("M")
    return now.join(old, now["path_key"] == F.col("old_key"), "left").withColumn("status", letter).select(*now.columns, "status")


def next_state(now: DataFrame, state: DataFrame, start_ns: int, ttl: int = TTL, late_ns: int = LATE_NS) -> DataFrame:
    """The state to keep after a run that began at start_ns."""
    newest = F.greatest("ctime_ns", "mtime_ns")
    # The guard is the newest time seen, or a few seconds before the run began.
    bound = now.agg(F.least(F.coalesce(F.max(newest), F.lit(start_ns)), F.lit(start_ns - late_ns)).alias("bound"))
    fresh = now.withColumn("age", F.lit(0)).join(F.broadcast(bound)).where(newest < F.col("bound")).drop("bound")
    rest = state.join(now.select("path_key"), "path_key", "left_anti").withColumn("age", F.col("age") + 1).where(F.col("age") < ttl)
    return fresh.select("path_key", "age", "size", "inode", "ctime_ns", "mtime_ns").unionByName(rest.select("path_key", "age", "size", "inode", "ctime_ns", "mtime_ns"))


def newest_paths(now: DataFrame) -> DataFrame:
    """time, paths: the newest change time and the paths that carry it."""
    t = F.greatest("ctime_ns", "mtime_ns")
    top = now.agg(F.max(t).alias("time"))
    return now.join(F.broadcast(top), t == F.col("time")).groupBy("time").agg(F.sort_array(F.collect_set("path_key")).alias("paths"))
