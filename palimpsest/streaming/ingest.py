"""Incremental ingest: a stream of files, each chunk stored once, state of files kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import chunking
from palimpsest.operators import maintenance


def stream_chunks(files: DataFrame, out: str, checkpoint: str, id_col: str, data_col: str, chunker: str):
    """Start a query that appends the new chunks of every micro-batch to ``out``; the caller awaits it.

    A batch that is replayed after a failure finds its chunks in the table and
    adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        pieces = chunking.chunked(batch.select(id_col, F.col(data_col).cast("binary").alias(data_col)), chunker, id_col, data_col)
        known = _known(spark, out)
        maintenance.new_chunks(pieces.select("chunk_id", "size"), known).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known(spark: SparkSession, out: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = "chunk_id string, size bigint"
    return spark.read.schema(schema).parquet(out) if fs.exists(path) else spark.createDataFrame([], schema)


def deduplicated_stream(chunks: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream of chunk ids, each passed on once while a watermark remembers it."""
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["chunk_id"])
