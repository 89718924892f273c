"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 4000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    # Batches of whole documents: the default of 10,000 rows is tens of megabytes, held several times.
    if int(spark.conf.get(_BATCH_ROWS)) > BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    if getattr(sc, "_palimpsest_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest_pkg.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._palimpsest_shipped = True


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the cluster's spark.checkpoint.dir. Only in local mode, where driver
    and executors are one process, an unset value is replaced by a temporary
    folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_palimpsest_shared", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = sc._palimpsest_shared = tempfile.mkdtemp(prefix="palimpsest-shared-")
    return f"{root.rstrip('/')}/palimpsest-{sc.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write a Parquet table; the shuffle files it took are deleted as soon as it is there."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by save() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def utf8(col: str | Column) -> Column:
    """Text as a string, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def parts(spark: SparkSession, floor: int = 1) -> int:
    """Partitions for exchanges that a Python stage reads."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """Bytes of what a plan reads, as Spark estimates them; 1 << 60 or more where it has no estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, most_bytes: int = 16 << 20) -> int:
    """Partitions for a Python stage that holds its partition: as parts(), more where the input's size asks for it."""
    size = input_bytes(df)
    return max(parts(df.sparkSession), min(-(-size // most_bytes), 1 << 20) if size < 1 << 60 else 1)


def within(sizes: Iterable[tuple[int, int]], most_bytes: int) -> list[int]:
    """Keys of (key, bytes), in the given order, whose bytes together stay within a bound; one too large is passed over."""
    kept, held = [], 0
    for key, size in sizes:
        if held + size <= most_bytes:
            held += size
            kept.append(key)
    return kept


def _give_back() -> None:
    """Return freed memory to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_state(kind: str, key: str, make):
    """Per-process object that outlives one task; Python workers are reused.

    One object is held: another kind or key replaces it, so that the steps of a
    pipeline do not add up their caches in a worker.
    """
    store = sys.modules[__name__].__dict__.setdefault("_STATE", {})
    if (kind, key) not in store:
        if store:
            store.clear()
            _give_back()
        store[kind, key] = make()
    return store[kind, key]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_slices(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array as one buffer, and n + 1 offsets into it (null: empty)."""
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type) and not pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_binary())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def with_field(batches: Iterable[pa.RecordBatch], struct: str, field: str, name: str) -> Iterable[pa.RecordBatch]:
    """Batches with a field of a struct column beside it, without a copy."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, column(batch, struct).field(field)], names=[*batch.schema.names, name])


def rows_of(batches: Iterable[pa.RecordBatch], names: Sequence[str], text: str, most_bytes: int = 8 << 20):
    """Re-cut Arrow batches so that one holds about ``most_bytes`` of ``text``."""
    for batch in batches:
        arr = column(batch, text)
        _, off = text_slices(arr)
        at = 0
        while at < len(arr):
            to = int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1
            to = min(len(arr), max(at + 1, to))
            yield tuple(column(batch, n).slice(at, to - at) for n in names)
            at = to
