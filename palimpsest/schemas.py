"""Relations of a snapshot catalog as Spark schemas."""

from __future__ import annotations

CHUNK = "struct<id:string,size:bigint>"

ARCHIVES = (
    "archive_id string, name string, time timestamp, host string, user string, tags array<string>, comment string, "
    "size bigint, nfiles bigint, chunker_params array<string>, exists boolean, deleted boolean"
)
ITEMS = (
    "archive_id string, ordinal bigint, path string, target string, mode bigint, uid bigint, gid bigint, user string, "
    "`group` string, size bigint, mtime_ns bigint, ctime_ns bigint, atime_ns bigint, hlid string, flags bigint, "
    f"inode decimal(20,0), xattrs map<string,binary>, chunks array<{CHUNK}>"
)
CHUNK_REFS = "archive_id string, role string, item_ordinal bigint, chunk_ordinal int, chunk_id string, size bigint"
CHUNK_INDEX = "chunk_id string, pack_id string, obj_offset bigint, obj_size bigint"
PACKS = "pack_id string, size bigint"
CHUNKS = "chunk_id string, type string, ctype string, clevel int, size bigint, csize bigint, data binary"
FILES_STATE = "path_key string, age int, size bigint, inode decimal(20,0), ctime_ns bigint, mtime_ns bigint, chunks array<string>"
RULES = "seq int, cmd string, style string, pattern string"
