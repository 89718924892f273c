"""Packs: stored objects one after another, each behind a 49-byte header, and scans of their headers."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER = struct.Struct("<32scIIQ")  # id, type, metadata bytes, data bytes, plain size
MAX_OBJECT = 20 << 20


def pack_object(chunk_id: bytes, kind: bytes, meta: bytes, data: bytes, size: int) -> bytes:
    """One object as it lies in a pack."""
    if len(meta) + len(data) > MAX_OBJECT:
        raise ValueError("object too large")
    return HEADER.pack(chunk_id, kind, len(meta), len(data), size) + meta + data


def headers(pack: bytes):
    """(offset, object size, chunk id in hex, type, plain size) of the objects of a pack; a damaged tail ends the walk."""
    at = 0
    while at + HEADER.size <= len(pack):
        chunk_id, kind, n_meta, n_data, size = HEADER.unpack_from(pack, at)
        length = HEADER.size + n_meta + n_data
        if n_meta + n_data > MAX_OBJECT or at + length > len(pack):
            return
        yield at, length, chunk_id.hex(), kind.decode("latin1"), size
        at += length


def read_object(pack: bytes, offset: int) -> tuple[bytes, bytes]:
    """(metadata, data) of the object at an offset."""
    _, _, n_meta, n_data, _ = HEADER.unpack_from(pack, offset)
    at = offset + HEADER.size
    return pack[at : at + n_meta], pack[at + n_meta : at + n_meta + n_data]


def scan_headers(packs: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """pack_id, chunk_id, type, obj_offset, obj_size, size: the index rebuilt from packs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = list(headers(row[content] or b""))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row[name]] * len(found), pa.string()),
                        *[pa.array([x[k] for x in found], t) for k, t in ((2, pa.string()), (3, pa.string()), (0, pa.int64()), (1, pa.int64()), (4, pa.int64()))],
                    ],
                    names=["pack_id", "chunk_id", "type", "obj_offset", "obj_size", "size"],
                )

    return packs.select(name, content).mapInArrow(run, "pack_id string, chunk_id string, type string, obj_offset bigint, obj_size bigint, size bigint")


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Pack files of a folder, any file system: path and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
