"""Listing snapshots and items: selectors, ranges, sorts, heads and tails."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import patterns

#: Sort keys of archives and items (fixed values).
ARCHIVE_KEYS = {"timestamp": "time", "ts": "time", "archive": "name", "name": "name", "id": "archive_id", "host": "host", "user": "user", "tags": "tags"}
ITEM_KEYS = ("path", "type", "mode", "user", "uid", "group", "gid", "size", "mtime", "ctime", "atime")


@dataclass(frozen=True)
class ListOptions:
    match: Sequence[str] = ()
    newer: timedelta | None = None
    older: timedelta | None = None
    newest: timedelta | None = None
    oldest: timedelta | None = None
    now: datetime | None = None
    sort: Sequence[str] = ("timestamp",)
    first: int | None = None
    last: int | None = None
    reverse: bool = False
    columns: Sequence[str] = field(default=("archive_id", "name", "time"))


def selector(text: str) -> Column:
    """One selector: aid:, tags:, user:, host:, name: or a name pattern."""
    kind, _, value = text.partition(":")
    if kind == "aid":
        return F.col("archive_id").startswith(value.lower())
    if kind == "tags":
        wanted = F.array(*[F.lit(t) for t in value.split(",") if t]).cast("array<string>")
        return F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0
    if kind in ("user", "host"):
        return F.col(kind) == value
    if kind == "name":
        return F.col("name") == value
    return F.col("name").rlike(patterns.name_regex(text))


def select_archives(archives: DataFrame, options: ListOptions) -> DataFrame:
    """Archives that pass every selector and time range, without order."""
    if options.newer and options.older or options.newest and options.oldest:
        raise ValueError("a range has one end only")
    out = archives
    for text in options.match:
        out = out.where(selector(text))
    now = F.lit(options.now) if options.now else F.current_timestamp()
    if options.newer:
        out = out.where(F.col("time") >= now - F.lit(options.newer))
    if options.older:
        out = out.where(F.col("time") <= now - F.lit(options.older))
    if options.newest or options.oldest:
        ends = out.agg(F.min("time").alias("low"), F.max("time").alias("high"))  # one row
        out = out.join(F.broadcast(ends))
        out = out.where(F.col("time") >= F.col("high") - F.lit(options.newest)) if options.newest else out.where(F.col("time") <= F.col("low") + F.lit(options.oldest))
        out = out.drop("low", "high")
    return out


def sort_columns(keys: Sequence[str], known: dict[str, str], tie: str) -> list[tuple[str, bool]]:
    """(column, descending) of a sort list; an empty or unknown key is an error."""
    out = []
    for key in keys:
        down = key.startswith(">")
        name = key.removeprefix(">")
        if name not in known:
            raise ValueError(f"unknown sort key {key!r}")
        out.append((known[name], down))
    return [*out, (tie, False)]


def list_archives(archives: DataFrame, options: ListOptions) -> DataFrame:
    """place, then the wanted columns: sorted, first N, then last N of these, then reversed."""
    keys = sort_columns(options.sort, ARCHIVE_KEYS, "archive_id")
    up = [F.desc(c) if down else F.asc(c) for c, down in keys]
    down = [F.asc(c) if down else F.desc(c) for c, down in keys]
    out = select_archives(archives, options)
    # Heads and tails are top-k, not a full sort.
    if options.first is not None:
        out = out.orderBy(*up).limit(options.first)
    if options.last is not None:
        out = out.orderBy(*down).limit(options.last)
    order = Window.orderBy(*(down if options.reverse else up))
    if options.first is None and options.last is None:
        return out.orderBy(*(down if options.reverse else up)).select(*options.columns)
    return out.withColumn("place", F.row_number().over(order)).select("place", *options.columns)


def one_archive(archives: DataFrame, name: str) -> DataFrame:
    """The archive of a name; of several the last by (time, id)."""
    best = F.max_by(F.struct(*archives.columns), F.struct("time", "archive_id"))
    return archives.where(F.col("name") == name).agg(best.alias("a")).where("a is not null").select("a.*")


def latest_by_name(archives: DataFrame) -> DataFrame:
    """The last archive of every name."""
    return archives.groupBy("name").agg(F.max_by(F.struct("archive_id", "time"), F.struct("time", "archive_id")).alias("a")).select("name", "a.archive_id", "a.time")


def item_sort_key(name: str) -> Column:
    """Sort value of an item field: a missing id is -1, a missing or zero time falls back to mtime."""
    if name in ("uid", "gid"):
        return F.coalesce(F.col(name), F.lit(-1))
    if name in ("ctime", "atime"):
        return F.coalesce(F.nullif(F.col(f"{name}_ns"), F.lit(0)), F.col("mtime_ns"))
    if name == "mtime":
        return F.col("mtime_ns")
    if name not in ITEM_KEYS:
        raise ValueError(f"unknown sort key {name!r}")
    return F.col(f"`{name}`")


def list_items(items: DataFrame, rules: Sequence[patterns.Rule] = (), depth: int | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """Items that pass the rules and lie at most ``depth`` levels deep, sorted if asked for."""
    out = items.where(patterns.included(F.col("path"), rules))
    if depth is not None:
        out = out.where(F.length("path") - F.length(F.replace("path", F.lit("/"))) <= depth)
    if not sort:
        return out
    order = [F.desc(item_sort_key(k[1:])) if k.startswith(">") else F.asc(item_sort_key(k)) for k in sort]
    return out.orderBy(*order, "ordinal")


def find(items: DataFrame, archives: DataFrame, rules: Sequence[patterns.Rule]) -> DataFrame:
    """Matching paths of the selected archives, newest archive first."""
    if not rules:
        raise ValueError("find needs a path or a pattern")
    hit = items.where(patterns.included(F.col("path"), [*rules, patterns.Rule("-", "re", "")]))
    return hit.join(archives.select("archive_id", "time"), "archive_id").orderBy(F.desc("time"), "archive_id", "ordinal")


def after(rows: DataFrame, key: str, marker, limit: int) -> DataFrame:
    """Keyset pagination: the next ``limit`` rows after a marker (None: from the start)."""
    return (rows if marker is None else rows.where(F.col(key) > marker)).orderBy(key).limit(limit)


def with_status(rows: DataFrame, letters: str) -> DataFrame:
    """Rows whose one-letter status is among ``letters``."""
    return rows.where(F.col("status").isin(*letters)) if letters else rows


def edit_tags(archives: DataFrame, add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    """Tags as a sorted set, with some added and others removed."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    tags = F.coalesce("tags", array(()))
    return archives.withColumn("tags", F.array_sort(F.array_except(F.array_union(tags, array(add)), array(remove))))


def search_bytes(objects: DataFrame, needle: bytes, context: int = 8, data: str = "data") -> DataFrame:
    """chunk_id, offset (from 0), context in hex, hits: first place of a byte sequence in each object, and how often it is there without overlaps."""
    if not needle:
        raise ValueError("nothing to search for")
    text = F.hex(data)
    wanted = needle.hex().upper()
    # A hit at an odd digit is no byte; look for pairs of digits only.
    pairs = F.regexp_replace(text, "(..)", "$1 ")
    spaced = " ".join(wanted[i : i + 2] for i in range(0, len(wanted), 2))
    at = F.instr(pairs, spaced)
    offset = ((at - 1) / 3).cast("bigint")
    hits = (F.length(pairs) - F.length(F.replace(pairs, F.lit(spaced + " "), F.lit("")))) / (len(spaced) + 1)
    around = F.substring(text, F.greatest(offset * 2 + 1 - 2 * context, F.lit(1)).cast("int"), F.lit(4 * context + len(wanted)))
    return objects.withColumn("at", at).where("at > 0").select("chunk_id", offset.alias("offset"), around.alias("context"), hits.cast("bigint").alias("hits"))


def search_across(objects: DataFrame, needle: bytes, order: Sequence[str], folder: str, context: int = 8, data: str = "data", parts: int | None = None) -> DataFrame:
    """chunk_id, next_id, offset (in the first, from 0), context in hex: where a byte sequence begins in one object and ends in the next by ``order``.

    Only the objects' ends are sorted, dealt by ranges that are kept in
    ``folder``; the end of a range reaches the next as one row. Of several
    places across one boundary the first counts. A null object is empty.
    """
    reach = len(needle) - 1
    if not needle:
        raise ValueError("nothing to search for")
    bytes_of = F.coalesce(F.col(data), F.lit(b""))
    n = F.octet_length(bytes_of)
    kept = reach + context
    keys = [F.col(c).alias(f"key{i}") for i, c in enumerate(order)]
    ends = objects.select(
        *keys, "chunk_id", n.cast("bigint").alias("n"), F.hex(F.substring(bytes_of, F.lit(1), F.lit(kept))).alias("head"),
        F.hex(F.substring(bytes_of, F.greatest(n - kept, F.lit(0)) + 1, F.lit(kept))).alias("tail"),
    )
    by = [f"key{i}" for i in range(len(order))]
    dealt = (ends.repartitionByRange(parts, *by) if parts else ends.repartitionByRange(*by)).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(folder)
    rows = objects.sparkSession.read.schema(dealt.schema).parquet(folder)
    before = F.struct("chunk_id", "n", "tail")
    # One row per range: few rows in one task.
    last = rows.groupBy("part").agg(F.max_by(before, F.struct(*by, "chunk_id")).alias("last"))
    last = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))
    inside = F.lag(before).over(Window.partitionBy("part").orderBy(*by, "chunk_id"))
    pairs = rows.withColumn("before", inside).join(F.broadcast(last), "part").withColumn("before", F.coalesce("before", "last")).where("before is not null")
    tail, head = F.col("before.tail"), F.col("head")
    # Digits of the bytes from where a sequence may begin to where it may end.
    near = F.concat(F.substring(tail, F.greatest(F.length(tail) - 2 * reach, F.lit(0)) + 1, F.lit(2 * reach)), F.substring(head, F.lit(1), F.lit(2 * reach)))
    spaced = " ".join(f"{b:02X}" for b in needle)
    at = ((F.instr(F.regexp_replace(near, "(..)", "$1 "), spaced) - 1) / 3).cast("bigint")
    found = pairs.withColumn("at", at).where(F.instr(F.regexp_replace(near, "(..)", "$1 "), spaced) > 0)
    back = F.least(F.length(tail) / 2, F.lit(reach)).cast("bigint") - F.col("at")
    begin = F.length(tail) - 2 * back
    around = F.substring(F.concat(tail, head), F.greatest(begin - 2 * context, F.lit(0)).cast("int") + 1, (2 * (len(needle) + context) + F.least(begin, F.lit(2 * context))).cast("int"))
    return found.select(F.col("before.chunk_id").alias("chunk_id"), F.col("chunk_id").alias("next_id"), (F.col("before.n") - back).alias("offset"), around.alias("context"))
