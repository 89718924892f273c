"""What changed between two snapshots: a full outer join on path.

An item is (path, ordinal, mode, user, mtime, chunks, ...). Chunk lists compare
in order; added and removed bytes count distinct chunk ids that only one side
has. With different chunker parameters only total sizes can be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators.analyze import content_size


def _sort_values(x: Column, y: Column, names: list[str]) -> Column:
    """What the sort keys read: the second snapshot's item, where a missing item, value or column is empty, -1 or 0."""
    none = F.lit(None)

    def value(side: Column, name: str, default, kind: str) -> Column:
        return F.coalesce(side[name] if name in names else none.cast(kind), F.lit(default)).cast(kind)

    def ns(side: Column, name: str) -> Column:
        if f"{name}_ns" in names:
            return value(side, f"{name}_ns", 0, "bigint")
        micros = F.unix_micros(side[name].cast("timestamp")) if name in names else none.cast("bigint")
        return F.coalesce(micros * 1000, F.lit(0)).cast("bigint")

    content = F.coalesce(content_size(y["chunks"]), value(y, "size", 0, "bigint"))
    target = y["target"] if "target" in names else none.cast("string")
    size = F.when(y["mode"].isNull(), content).otherwise(scalars.item_size(y["mode"], content, target))
    return F.struct(
        size.cast("bigint").alias("size"),
        value(y, "user", "", "string").alias("user"),
        value(y, "group", "", "string").alias("group"),
        value(y, "uid", -1, "bigint").alias("uid"),
        value(y, "gid", -1, "bigint").alias("gid"),
        ns(y, "ctime").alias("ctime"),
        ns(y, "mtime").alias("mtime"),
        (ns(y, "ctime") - ns(x, "ctime")).alias("ctime_diff"),
        (ns(y, "mtime") - ns(x, "mtime")).alias("mtime_diff"),
    )


def _only(here: Column, there: Column) -> Column:
    """Bytes of distinct chunks of one list whose ids the other list lacks: both lists sorted together, then one pass."""
    other, own = F.lit("\x00"), F.lit("\x01")
    mine = F.array_distinct(F.transform(here, lambda c: F.concat(c["id"], own, F.coalesce(c["size"], F.lit(0)).cast("string"))))
    theirs = F.transform(there, lambda c: F.concat(c["id"], other))
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("bytes"))

    def step(seen: Column, x: Column) -> Column:
        # An id of the other list comes right before the same id of this one.
        size = F.substring_index(x, "\x01", -1).cast("bigint")
        known = F.substring_index(x, "\x01", 1) == seen["last"]
        return F.when(x.endswith(other), F.struct(F.rtrim(x, other).alias("last"), seen["bytes"].alias("bytes"))).otherwise(
            F.struct(seen["last"].alias("last"), (seen["bytes"] + F.when(known, 0).otherwise(size)).alias("bytes"))
        )

    return F.aggregate(F.sort_array(F.concat(mine, theirs)), start, step, lambda seen: seen["bytes"])


def compare(a: DataFrame, b: DataFrame, same_chunker: bool = True, content_only: bool = False, sort_values: bool = False) -> DataFrame:
    """path, kind, content, added, removed, mode and owner changes, times changed, and the default order.

    With ``sort_values`` a struct of that name has what the sort keys beside
    path, added and removed need; both sides have the same columns then.

    kind is added, removed or changed; equal items do not appear. order1..order3
    give the order in which a streaming comparison would report the rows:
    matched rows as soon as both sides are seen, then additions, then removals.
    Rows that tie in them, as items of one ordinal do, are ordered by path.
    """
    left = a.select("path", F.struct(*a.columns).alias("x"))
    right = b.select("path", F.struct(*b.columns).alias("y"))
    both = left.join(right, "path", "full_outer")
    x, y = F.col("x"), F.col("y")
    lists = x["chunks"].isNotNull() & y["chunks"].isNotNull()
    if same_chunker:
        modified = lists & (x["chunks"] != y["chunks"])
        added, removed = _only(y["chunks"], x["chunks"]), _only(x["chunks"], y["chunks"])
    else:
        modified = lists & (content_size(x["chunks"]) != content_size(y["chunks"]))
        added, removed = content_size(y["chunks"]), content_size(x["chunks"])
    kind = F.when(x.isNull(), "added").when(y.isNull(), "removed").otherwise("changed")
    whole_a = content_size(x["chunks"])
    whole_b = content_size(y["chunks"])
    mode = x["mode"].isNotNull() & y["mode"].isNotNull() & (x["mode"] != y["mode"])
    owner = F.coalesce(x["user"], F.lit("")) != F.coalesce(y["user"], F.lit(""))
    mtime = x["mtime"].isNotNull() & y["mtime"].isNotNull() & (x["mtime"] != y["mtime"])
    changed = F.col("kind") == "changed"
    rows = both.withColumn("kind", kind).select(
        "path",
        "kind",
        (changed & F.coalesce(modified, F.lit(False))).alias("modified"),
        F.when(x.isNull(), whole_b).when(y.isNull(), F.lit(0)).when(modified, added).otherwise(F.lit(0)).cast("bigint").alias("added"),
        F.when(y.isNull(), whole_a).when(x.isNull(), F.lit(0)).when(modified, removed).otherwise(F.lit(0)).cast("bigint").alias("removed"),
        *(
            ()
            if content_only
            else (
                F.when(changed & mode, F.struct(x["mode"].alias("from"), y["mode"].alias("to"))).alias("mode"),
                F.when(changed & owner, F.struct(x["user"].alias("from"), y["user"].alias("to"))).alias("owner"),
                (changed & F.coalesce(mtime, F.lit(False))).alias("mtime_changed"),
            )
        ),
        F.when(changed, 0).when(x.isNull(), 1).otherwise(2).alias("order1"),
        F.when(x.isNull(), y["ordinal"]).when(y.isNull(), x["ordinal"]).otherwise(F.greatest(x["ordinal"], y["ordinal"])).alias("order2"),
        F.when(changed & (x["ordinal"] < y["ordinal"]), 1).otherwise(0).alias("order3"),
        *((_sort_values(x, y, b.columns).alias("sort_values"),) if sort_values else ()),
    )
    seen = F.col("modified") if content_only else F.col("modified") | F.col("mode").isNotNull() | F.col("owner").isNotNull() | F.col("mtime_changed")
    return rows.where((F.col("kind") != "changed") | seen)


def reported(changes: DataFrame) -> DataFrame:
    """Rows in the default order of a comparison."""
    return changes.orderBy(*_order((), changes))


def placed(changes: DataFrame, folder: str, parts: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with ``place`` (from 1) by sort keys and then in the default order, dealt by ranges that are kept in ``folder``: no task sees all rows."""
    spark = changes.sparkSession
    order = _order(keys, changes)
    dealt = changes.repartitionByRange(parts, *order) if parts else changes.repartitionByRange(*order)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    dealt.write.parquet(folder)
    rows = spark.read.schema(dealt.schema).parquet(folder)
    before, at = [], 0
    for part, n in sorted(rows.groupBy("part").count().collect()):
        before.append((part, at))
        at += n
    starts = spark.createDataFrame(before, "part int, before bigint")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("before") + inside).drop("part", "before")


#: Sort keys of a diff (fixed values).
SORT_KEYS = ("path", "size_added", "size_removed", "size_diff", "size", "user", "group", "uid", "gid", "ctime", "mtime", "ctime_diff", "mtime_diff")


def _order(keys: Sequence[str], changes: DataFrame) -> list[Column]:
    """The sort keys, the default order, and the path: two rows may share all before it."""
    order = []
    for key in keys:
        name = key.removeprefix(">")
        if name not in SORT_KEYS:
            raise ValueError(f"unknown sort key {key!r}")
        if name == "path":
            col = F.col("path")
        elif name == "size_diff":
            col = F.col("added") - F.col("removed")
        else:
            col = F.col(name.removeprefix("size_")) if name.startswith("size_") else F.col("sort_values")[name]
        order.append(col.desc() if key.startswith(">") else col.asc())
    return [*order, *(F.col(c).asc() for c in ("order1", "order2", "order3", "path") if c in changes.columns)]


def sorted_by(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by SORT_KEYS, ``>`` for descending; ties in default order, then by path. Keys after size_diff need compare's ``sort_values``."""
    return changes.orderBy(*_order(keys, changes))


def totals(changes: DataFrame) -> DataFrame:
    """One row: paths added, removed, modified, and the bytes."""
    return changes.agg(
        F.count_if(F.col("kind") == "added").alias("n_added"),
        F.count_if(F.col("kind") == "removed").alias("n_removed"),
        F.count_if("modified").alias("n_modified"),
        F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("added"),
        F.coalesce(F.sum("removed"), F.lit(0)).cast("bigint").alias("removed"),
    )
