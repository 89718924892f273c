"""Locations of repositories: a path or URL taken apart, in Python and as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes that Hadoop file systems serve, by the scheme a user writes (fixed values).
HADOOP = {"file": "file", "": "file", "s3": "s3a", "b2": "s3a", "sftp": "sftp", "hdfs": "hdfs", "http": "http", "https": "https"}
_URL = re.compile(r"^(?P<proto>[A-Za-z][A-Za-z0-9+.-]*)://(?:(?P<user>[^@/:]*)(?::(?P<secret>[^@/]*))?@)?(?P<host>\[[^\]]*\]|[^:/?#]*)(?::(?P<port>[0-9]+))?(?P<path>/[^?#]*)?")


@dataclass(frozen=True)
class Location:
    proto: str
    user: str | None
    host: str | None
    port: int | None
    path: str

    @classmethod
    def parse(cls, text: str) -> Location:
        """A path or URL; an unknown scheme or an empty text is an error."""
        m = _URL.match(text)
        if not m:
            if not text or "://" in text:
                raise ValueError(f"{text!r} is no location")
            return cls("file", None, None, None, text)
        if m["proto"].lower() not in HADOOP:
            raise ValueError(f"no file system serves {m['proto']}://")
        return cls(m["proto"].lower(), m["user"], m["host"].strip("[]") or None, int(m["port"]) if m["port"] else None, m["path"] or "/")

    def hadoop(self) -> str:
        """The path that Spark's readers and writers take."""
        where = (f"{self.user}@" if self.user else "") + (self.host or "") + (f":{self.port}" if self.port else "")
        return f"{HADOOP[self.proto]}://{where}{self.path}" if self.host else self.path


def redact(text: str) -> str:
    """A location without the secret in it."""
    m = _URL.match(text)
    return text if not m or m["secret"] is None else text[: m.start("secret")] + "***" + text[m.end("secret") :]


def parts(url: Column) -> Column:
    """struct(proto, host, port, path) of a URL; missing parts are null."""
    take = lambda pattern, group: F.nullif(F.regexp_extract(url, pattern, group), F.lit(""))
    return F.struct(
        take("^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("proto"),
        take("^[A-Za-z][A-Za-z0-9+.-]*://([^@/]*@)?([^:/?#]+)", 2).alias("host"),
        take("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)", 1).cast("int").alias("port"),
        take("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1).alias("path"),
    )
