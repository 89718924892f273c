"""Catalog relations derived from the driver's tables, in Spark and as DuckDB CTEs.

archives are (market segment, order month); an item is a part in an archive, its
chunks the ordered line items; the chunk index is the part table, packed by
brand. LIVE restricts references to early ship dates, so that unreferenced and
exclusive chunks exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE = "1995-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str, live: str | None = LIVE) -> DataFrame:
    """archive_id, name, time, path, directory, chunk_id, size: one row per chunk reference."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    if live:
        lines = lines.where(F.col("l_shipdate") < F.lit(live).cast("timestamp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("/", "name", F.date_format("o_orderdate", "yyyy-MM")).alias("archive_id"),
            "name",
            F.date_trunc("month", "o_orderdate").alias("time"),
            F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
            F.col("p_brand").alias("directory"),
            F.col("p_partkey").alias("chunk_id"),
            F.col("p_size").cast("bigint").alias("size"),
        )
    )


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, pack_id, obj_offset, obj_size: the part table, packed by brand, 49 bytes of header each."""
    from pyspark.sql import Window

    size = F.col("p_size").cast("bigint") + 49
    before = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("chunk_id"),
        F.col("p_brand").alias("pack_id"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("obj_offset"),
        size.alias("obj_size"),
    )


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_id, size; packs of odd last digit have an unindexed tail of 100 bytes."""
    index = chunk_index(spark, sf_dir)
    tail = F.when(F.right("pack_id", F.lit(1)).cast("int") % 2 == 1, 100).otherwise(0)
    return index.groupBy("pack_id").agg(F.sum("obj_size").alias("used")).select("pack_id", (F.col("used") + tail).cast("bigint").alias("size"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_id (ship month), ordinal, path, mode, user, mtime, chunks (id, size): one row per part shipped in a month."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("archive_id"),
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
        F.struct("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("bigint").alias("size")).alias("c"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
        F.col("l_linenumber").alias("n"),
        F.col("l_returnflag").alias("flag"),
        "l_shipdate",
    )
    return rows.groupBy("archive_id", "path").agg(
        F.min("ordinal").alias("ordinal"),
        F.max(F.when(F.col("n") % 2 == 0, 33188).otherwise(33261)).cast("bigint").alias("mode"),
        F.min("flag").alias("user"),
        F.max("l_shipdate").alias("mtime"),
        F.transform(F.sort_array(F.collect_list("c")), lambda c: F.struct(c["id"].alias("id"), c["size"].alias("size"))).alias("chunks"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_id, name, time, host, user, tags from events: every event is an archive of its type's series."""
    e = table(spark, sf_dir, "events")
    prot = F.when(F.col("event_id") % 97 == 0, F.array(F.lit("@PROT"))).otherwise(F.array().cast("array<string>"))
    tag = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("weekly"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.lpad(F.lower(F.hex("event_id")), 8, "0").alias("archive_id"),
        F.col("event_type").alias("name"),
        F.col("ts").alias("time"),
        F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("host"),
        F.col("user_id").cast("string").alias("user"),
        F.concat(prot, tag).alias("tags"),
    )


# The same relations as DuckDB common table expressions.

REFS_SQL = f"""refs as (
  select c_mktsegment || '/' || strftime(o_orderdate, '%Y-%m') as archive_id, c_mktsegment as name,
    date_trunc('month', o_orderdate) as time, p_brand || '/' || p_partkey as path, p_brand as directory,
    p_partkey as chunk_id, p_size::bigint as size
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey where l_shipdate < timestamp '{LIVE}')"""

INDEX_SQL = """idx as (
  select p_partkey as chunk_id, p_brand as pack_id, p_size::bigint + 49 as obj_size,
    coalesce(sum(p_size::bigint + 49) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as obj_offset
  from part)"""

PACKS_SQL = """packs as (
  select pack_id, (sum(obj_size) + case when right(pack_id, 1)::int % 2 = 1 then 100 else 0 end)::bigint as size
  from idx group by pack_id)"""

ITEMS_SQL = """items as (
  select strftime(l_shipdate, '%Y-%m') as archive_id, p_brand || '/' || p_partkey as path,
    min(l_orderkey * 8 + l_linenumber) as ordinal,
    max(case when l_linenumber % 2 = 0 then 33188 else 33261 end)::bigint as mode,
    min(l_returnflag) as "user", max(l_shipdate) as mtime,
    list({'id': l_suppkey, 'size': l_quantity::bigint} order by l_orderkey, l_linenumber, l_suppkey, l_quantity) as chunks
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""

SNAPSHOTS_SQL = """snaps as (
  select lpad(printf('%x', event_id), 8, '0') as archive_id, event_type as name, ts as time,
    'host' || (user_id % 7) as host, user_id::varchar as "user",
    list_concat(case when event_id % 97 = 0 then ['@PROT'] else []::varchar[] end, case when event_id % 3 = 0 then ['weekly'] else []::varchar[] end) as tags
  from events)"""


def with_sql(*ctes: str) -> str:
    return "with " + ", ".join(ctes) + " "
