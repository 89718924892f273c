"""Queries of chunking, compression, ingest and the catalog commands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.functions import chunking, codec
from palimpsest.operators import patterns
from palimpsest.plans.registry import register
from palimpsest.plans.repository import Repository
from palimpsest.plans.views import table
from palimpsest.session import shared_folder

_BLOCKS_SQL = """with b as (select doc_id, source, unnest(range(0, ((len(text) + 255) // 256)::int)) as ordinal, text from documents where text <> ''),
  c as (select doc_id, source, ordinal, ordinal * 256 as "offset", len(substr(text, (ordinal * 256 + 1)::int, 256)) as size, sha256(substr(text, (ordinal * 256 + 1)::int, 256)) as chunk_id from b)"""


def _blocks(spark, d):
    return chunking.fixed_blocks(table(spark, d, "documents"), F.col("text"), 256)


@register("chunk_fixed", _BLOCKS_SQL + ' select doc_id, ordinal, "offset", size, chunk_id from c')
def chunk_fixed(spark, d):
    return _blocks(spark, d).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "offset", "size", "chunk_id")


@register("dedup_blocks_fixed", _BLOCKS_SQL + " select source, count(*) as chunks, sum(size)::bigint as bytes, count(distinct chunk_id) as distinct_chunks from c group by 1")
def dedup_blocks_fixed(spark, d):
    return _blocks(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.count_distinct("chunk_id").alias("distinct_chunks"))


def _bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


@register("chunk_fastcdc")
def chunk_fastcdc(spark, d):
    return chunking.chunked(_bytes(spark, d), "fastcdc,8,12,10,2", "doc_id", "data").drop("data")


@register("chunk_buzhash64")
def chunk_buzhash64(spark, d):
    return chunking.chunked(_bytes(spark, d), "buzhash64,8,12,10,63,1", "doc_id", "data").drop("data")


@register("chunk_buzhash")
def chunk_buzhash(spark, d):
    return chunking.chunked(_bytes(spark, d), "buzhash,8,12,10,255", "doc_id", "data").drop("data")


@register("chunk_totals", "select doc_id, strlen(text)::bigint as bytes from documents where text <> ''")
def chunk_totals(spark, d):
    """Every byte of a content-defined chunking is accounted for."""
    return chunk_fastcdc(spark, d).groupBy("doc_id").agg(F.sum("size").alias("bytes"))


@register("compress_auto")
def compress_auto(spark, d):
    rows = _bytes(spark, d).withColumn("c", codec.compressed(F.col("data"), "auto,zstd,3"))
    return rows.select("doc_id", "c.ctype", "c.size", F.octet_length("c.data").alias("csize"))


@register("compress_round_trip", "select doc_id, sha256(text) as id from documents")
def compress_round_trip(spark, d):
    rows = _bytes(spark, d).withColumn("c", codec.compressed(F.col("data"), "obfuscate,250,zlib,6"))
    return rows.select("doc_id", F.sha2(codec.decompressed(F.col("c.ctype"), F.col("c.size"), F.col("c.data")), 256).alias("id"))


def _repository(spark) -> Repository:
    return Repository(spark, shared_folder(spark, "repo")).create_repository()


def _files(spark, d, keep):
    docs = table(spark, d, "documents")
    return docs.where(keep).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))


@register("create_extract", "select source || '/' || doc_id as path, sha256(text) as id from documents")
def create_extract(spark, d):
    """All documents into an archive and out again."""
    repo = _repository(spark)
    archive = repo.create("docs", _files(spark, d, F.lit(True)), "fastcdc,8,12,10,2", time=datetime(2024, 1, 1))
    return repo.extract(archive).select("path", F.sha2("content", 256).alias("id"))


@register("recreate_rechunk", "select source || '/' || doc_id as path, sha256(text) as id from documents where lang <> 'fr' or source <> 'src1'")
def recreate_rechunk(spark, d):
    """An archive again with other chunks."""
    repo = _repository(spark)
    docs = table(spark, d, "documents").where("lang <> 'fr' or source <> 'src1'")
    files = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    old = repo.create("docs", files, "fixed,512", time=datetime(2024, 1, 1))
    return repo.extract(repo.recreate(old, chunker="buzhash64,8,12,10,63")).select("path", F.sha2("content", 256).alias("id"))


@register("recreate_rechunk_all", "select source || '/' || doc_id as path, sha256(text) as id from documents")
def recreate_rechunk_all(spark, d):
    """An archive of all documents again with other chunks; recreate_rechunk leaves out what its SQL does."""
    repo = _repository(spark)
    old = repo.create("docs", _files(spark, d, F.lit(True)), "fixed,512", time=datetime(2024, 1, 1))
    return repo.extract(repo.recreate(old, chunker="buzhash64,8,12,10,63")).select("path", F.sha2("content", 256).alias("id"))


@register("recompress_in_place", "select source || '/' || doc_id as path, sha256(text) as id from documents")
def recompress_in_place(spark, d):
    """All documents stored plain, every chunk rewritten by zlib where that is smaller, and out again."""
    repo = _repository(spark)
    archive = repo.create("docs", _files(spark, d, F.lit(True)), "fixed,4096", "none", time=datetime(2024, 1, 1))
    repo.recompress_in_place("zlib,6")
    return repo.extract(archive).select("path", F.sha2("content", 256).alias("id"))


@register("transfer_repository", "select source || '/' || doc_id as path, sha256(text) as id from documents")
def transfer_repository(spark, d):
    """Two archives of a repository moved to one that holds half of their chunks, and the second out of there."""
    source, target = _repository(spark), _repository(spark)
    target.create("half", _files(spark, d, F.col("doc_id") % 2 == 0), "fixed,4096", time=datetime(2024, 1, 1))
    source.create("old", _files(spark, d, F.col("doc_id") % 3 == 0), "fixed,4096", time=datetime(2024, 1, 2))
    source.create("docs", _files(spark, d, F.lit(True)), "fixed,4096", time=datetime(2024, 1, 3))
    return target.extract(target.transfer(source)[1]).select("path", F.sha2("content", 256).alias("id"))


@register("compact_repository", "select source || '/' || doc_id as path, sha256(text) as id from documents where doc_id % 2 = 0")
def compact_repository(spark, d):
    """Two archives, the larger one deleted, its chunks compacted away, and the other out again."""
    repo = _repository(spark)
    both = repo.create("docs", _files(spark, d, F.lit(True)), "fixed,4096", time=datetime(2024, 1, 1))
    even = repo.create("even", _files(spark, d, F.col("doc_id") % 2 == 0), "fixed,4096", time=datetime(2024, 1, 2))
    repo.delete(both)
    repo.compact()
    return repo.extract(even).select("path", F.sha2("content", 256).alias("id"))


@register("second_archive_new_chunks", """with b as (select doc_id, unnest(range(0, ((len(text) + 255) // 256)::int)) as k, text from documents where text <> ''),
  c as (select doc_id, sha256(substr(text, (k * 256 + 1)::int, 256)) as id from b)
  select count(distinct id) as new_chunks from c where doc_id % 2 = 1 and id not in (select id from c where doc_id % 2 = 0)""")
def second_archive_new_chunks(spark, d):
    """Blocks of odd documents that the even ones lack: a dedup add against an index."""
    from palimpsest.operators import maintenance

    blocks = _blocks(spark, d)
    even = blocks.where("doc_id % 2 = 0").select("chunk_id").distinct()
    return maintenance.new_chunks(blocks.where("doc_id % 2 = 1"), even).agg(F.count("*").alias("new_chunks"))


@register("stream_ingest", "select count(distinct id) as chunks from (select sha256(substr(text, (k * 512 + 1)::int, 512)) as id from (select text, unnest(range(0, ((len(text) + 511) // 512)::int)) as k from documents where text <> '' and strlen(text) = len(text))) ")
def stream_ingest(spark, d):
    """ASCII documents through a stream: each 512-byte chunk is stored once."""
    return _streamed(spark, d, F.octet_length("text") == F.length("text"))


@register("stream_ingest_all", "select count(distinct id) as chunks from (select substr(hex(encode(text)), (k * 1024 + 1)::int, 1024) as id from (select text, unnest(range(0, ((strlen(text) + 511) // 512)::int)) as k from documents where text <> ''))")
def stream_ingest_all(spark, d):
    """All documents through a stream; stream_ingest keeps those that its SQL can cut by characters."""
    return _streamed(spark, d, F.lit(True))


def _streamed(spark, d, keep):
    from palimpsest.streaming.ingest import stream_chunks

    where = shared_folder(spark, "stream")
    # The table is one Parquet path; a stream lists its folder.
    files = spark.readStream.schema(table(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parque[t]")
    stream_chunks(files.where(keep).select("doc_id", "text"), f"{where}/chunks", f"{where}/checkpoint", "doc_id", "text", "fixed,512").awaitTermination()
    return spark.read.schema("chunk_id string, size bigint").parquet(f"{where}/chunks").agg(F.count("*").alias("chunks"))


@register("recompress_tally", "select 'recompressed' as outcome, count(*) as objects from documents where strlen(text) > 2000")
def recompress_tally(spark, d):
    from palimpsest.operators import maintenance

    rows = _bytes(spark, d).where(F.octet_length("data") > 2000).select(F.col("data"), F.octet_length("data").cast("bigint").alias("csize"), F.lit("none").alias("ctype"), F.lit(0).alias("clevel"))
    again = rows.withColumn("new_csize", F.octet_length(codec.compressed(F.col("data"), "zlib,6")["data"]))
    return maintenance.recompress_tally(again, "zlib", 6).select("outcome", "objects")


@register("recompress_tally_all")
def recompress_tally_all(spark, d):
    """All documents, stored plain; which of them gain depends on the codec, so there is no SQL."""
    from palimpsest.operators import maintenance

    rows = _bytes(spark, d).select(F.col("data"), F.octet_length("data").cast("bigint").alias("csize"), F.lit("none").alias("ctype"), F.lit(0).alias("clevel"))
    again = rows.withColumn("new_csize", F.octet_length(codec.compressed(F.col("data"), "zlib,6")["data"]))
    return maintenance.recompress_tally(again, "zlib", 6)


@register("unmatched_patterns", "select unnest(['nowhere', 'src1/zz']) as pattern")
def unmatched_patterns(spark, d):
    paths = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path"))
    return patterns.unmatched(paths, ["src1", "nowhere", "src1/zz"])
