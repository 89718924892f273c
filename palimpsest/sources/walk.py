"""A directory tree as items: one row per object, children in byte order, excluded subtrees skipped.

``walk`` is a data source that lists the roots' children on the driver and walks
each in a task; it needs a file system that the executors mount. ``listed``
covers any other file system with regular files only.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, mode bigint, uid bigint, gid bigint, size bigint, mtime_ns bigint, ctime_ns bigint, inode bigint, nlink bigint, target string"


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [p for p in options["path"].split(",") if p]
        self.one_fs = options.get("oneFileSystem", "false") == "true"
        self.skip = {x for x in options.get("excludeNames", "").split(",") if x}

    def partitions(self):
        out = []
        for root in self.roots:
            out.append(InputPartition((root, root, False)))
            if os.path.isdir(root) and not os.path.islink(root):
                out += [InputPartition((root, os.path.join(root, name), True)) for name in sorted(os.listdir(root)) if name not in self.skip]
        return out

    def read(self, partition):
        root, top, deep = partition.value
        device = os.lstat(root).st_dev
        todo = [top]
        while todo:
            path = todo.pop()
            st = os.lstat(path)
            link = os.readlink(path) if stat.S_ISLNK(st.st_mode) else None
            yield path.lstrip("/"), st.st_mode, st.st_uid, st.st_gid, st.st_size, st.st_mtime_ns, st.st_ctime_ns, st.st_ino, st.st_nlink, link
            if deep and stat.S_ISDIR(st.st_mode) and not (self.one_fs and st.st_dev != device):
                todo += [os.path.join(path, n) for n in sorted(os.listdir(path), reverse=True) if n not in self.skip]


class WalkDataSource(DataSource):
    @classmethod
    def name(cls):
        return "walk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalkDataSource)


def listed(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path, size, mtime and content of the files under a folder of any file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    cols = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return files.select(*cols, *(["content"] if content else []))


def paths_from(spark: SparkSession, source: str, separator: str = "\n") -> DataFrame:
    """path: a list of paths in a text file, by any separator."""
    return spark.read.text(source, lineSep=separator).where("value <> ''").select(F.col("value").alias("path"))
