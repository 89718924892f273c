"""Compaction plans, reference checks, index upkeep, transfers, hard links, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_chunks(*refs: DataFrame) -> DataFrame:
    """Distinct chunk ids of content, stream, pointer and archive references."""
    out = refs[0].select("chunk_id")
    for more in refs[1:]:
        out = out.unionByName(more.select("chunk_id"))
    return out.distinct()


def compact_plan(index: DataFrame, packs: DataFrame, live: DataFrame, threshold: int = 10) -> DataFrame:
    """pack_id, size, indexed, alive, action (keep, drop or rewrite) and freed bytes, per pack.

    A pack without live bytes is dropped if its index rows cover it whole;
    otherwise the integer percentage of dead bytes decides. Index rows that name
    an unknown pack are ignored.
    """
    alive = live.select("chunk_id", F.lit(1).alias("alive"))
    used = index.join(alive, "chunk_id", "left").groupBy("pack_id").agg(
        F.sum("obj_size").alias("indexed"), F.sum(F.when(F.col("alive") == 1, F.col("obj_size")).otherwise(0)).alias("alive")
    )
    per_pack = packs.join(used, "pack_id", "left").select(
        "pack_id", "size", F.coalesce("indexed", F.lit(0)).cast("bigint").alias("indexed"), F.coalesce("alive", F.lit(0)).cast("bigint").alias("alive")
    )
    dead = F.col("indexed") - F.col("alive")
    share = F.expr("(indexed - alive) * 100 div size")
    action = (
        F.when((dead == 0) | (F.col("size") == 0), "keep")
        .when((F.col("alive") == 0) & (F.col("indexed") == F.col("size")), "drop")
        .when(share >= threshold, "rewrite")
        .otherwise("keep")
    )
    freed = F.when(action == "keep", 0).otherwise(dead)
    return per_pack.select("pack_id", "size", "indexed", "alive", action.alias("action"), freed.cast("bigint").alias("freed"))


def compact_stats(plan: DataFrame) -> DataFrame:
    """One row: packs and bytes before and after a plan."""
    is_ = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(
        F.count("*").alias("packs_before"),
        is_("drop").alias("packs_dropped"),
        is_("rewrite").alias("packs_rewritten"),
        is_("keep").alias("packs_kept"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes_before"),
        F.coalesce(F.sum(F.col("size") - F.col("freed")), F.lit(0)).cast("bigint").alias("bytes_after"),
    )


def refuse_if_missing(refs: DataFrame, index: DataFrame) -> None:
    """Compaction must not run while a live reference is missing from the index."""
    if not missing(refs, index).isEmpty():
        raise ValueError("a live reference is missing from the index")


def missing(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References that no index row resolves."""
    return refs.join(index.select("chunk_id"), "chunk_id", "left_anti")


def missing_report(refs: DataFrame, index: DataFrame, per_archive: int = 10) -> DataFrame:
    """archive_id, chunk_id, path, nth, total: at most ``per_archive`` missing references of each archive, and their count."""
    gone = missing(refs, index)
    order = Window.partitionBy("archive_id").orderBy("path", "chunk_id")
    ranked = gone.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_archive)
    totals = gone.groupBy("archive_id").agg(F.count("*").alias("total"))
    return ranked.join(totals, "archive_id").select("archive_id", "chunk_id", "path", "nth", "total")


def missing_paths(refs: DataFrame, index: DataFrame, paths: int = 10, chunks: int = 1000) -> DataFrame:
    """chunk_id, paths: missing chunks, each with its first paths."""
    ranked = missing(refs, index).select("chunk_id", "path").distinct()
    order = Window.partitionBy("chunk_id").orderBy("path")
    few = ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= paths)
    return few.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths")).orderBy("chunk_id").limit(chunks)


def rehash(objects: DataFrame, data: str, claimed: str) -> DataFrame:
    """Objects whose content does not have the id it is filed under."""
    return objects.where(F.sha2(F.col(data), 256) != F.col(claimed))


def overlapping(index: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, chunk_id, problem: objects that overlap the one before or pass the end of their pack."""
    order = Window.partitionBy("pack_id").orderBy("obj_offset", "chunk_id")
    end = F.col("obj_offset") + F.col("obj_size")
    rows = index.withColumn("before", F.lag(end).over(order)).join(packs.select("pack_id", F.col("size").alias("pack_size")), "pack_id")
    problem = F.when(F.col("before") > F.col("obj_offset"), "overlap").when(end > F.col("pack_size"), "overrun")
    return rows.withColumn("problem", problem).where("problem is not null").select("pack_id", "chunk_id", "problem")


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Union of index fragments (with a ``fragment`` number): the last one wins for each chunk."""
    own = F.struct(*[c for c in fragments.columns if c not in ("chunk_id", "fragment")])
    return fragments.groupBy("chunk_id").agg(F.max_by(own, "fragment").alias("e")).select("chunk_id", "e.*")


def new_chunks(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct incoming chunks that the index lacks: the incremental fragment, and what a dedup add stores."""
    return incoming.dropDuplicates(["chunk_id"]).join(index.select("chunk_id"), "chunk_id", "left_anti")


def get_many(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index rows of wanted ids, side by side by pack."""
    return index.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").sortWithinPartitions("pack_id", "obj_offset")


def transfer_plan(source_refs: DataFrame, target_index: DataFrame) -> DataFrame:
    """present, chunks, bytes: distinct chunks of a source that a target has or needs."""
    have = target_index.select("chunk_id", F.lit(True).alias("present"))
    per_chunk = source_refs.groupBy("chunk_id").agg(F.max("size").alias("size"))
    return (
        per_chunk.join(have, "chunk_id", "left")
        .groupBy(F.coalesce("present", F.lit(False)).alias("present"))
        .agg(F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"))
    )


def to_transfer(source: DataFrame, target: DataFrame) -> DataFrame:
    """Archives that the target does not hold under the same name and id."""
    return source.join(target.select("name", "archive_id"), ["name", "archive_id"], "left_anti")


def lost_archives(index: DataFrame, known: DataFrame) -> DataFrame:
    """Stored archive objects (type A) that no directory entry, live or deleted, names."""
    return index.where(F.col("type") == "A").join(known.select(F.col("archive_id").alias("chunk_id")), "chunk_id", "left_anti")


def hardlinks(items: DataFrame, group: str = "hlid") -> DataFrame:
    """Items with ``owner_path``: the first of their hard-link group, which holds the content."""
    first = F.first("path").over(Window.partitionBy(group).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("owner_path", F.when(F.col(group).isNotNull(), first))


def resolve_owner(items: DataFrame, users: DataFrame) -> DataFrame:
    """uid by name where a user of that name exists, else the stored uid."""
    known = users.select(F.col("name").alias("user"), F.col("uid").alias("known_uid"))
    return items.join(known, "user", "left").withColumn("uid", F.coalesce("known_uid", "uid")).drop("known_uid")


def resume(items: DataFrame, existing: DataFrame, on: tuple[str, ...] = ("path", "mode", "size", "mtime")) -> DataFrame:
    """Items that are not there yet with equal mode, size and time."""
    return items.join(existing.select(*on), list(on), "left_anti")


def soft_delete(archives: DataFrame, gone: DataFrame) -> DataFrame:
    """archives with deleted = true for those named in gone."""
    marked = gone.select("archive_id").distinct().withColumn("now_gone", F.lit(True))
    return archives.join(marked, "archive_id", "left").withColumn("deleted", F.coalesce("now_gone", "deleted", F.lit(False))).drop("now_gone")


def undelete(archives: DataFrame, back: DataFrame) -> DataFrame:
    marked = back.select("archive_id").distinct().withColumn("now_back", F.lit(True))
    return archives.join(marked, "archive_id", "left").withColumn("deleted", F.col("deleted") & F.col("now_back").isNull()).drop("now_back")


def archive_object_id(name: Column, time: Column, comment: Column) -> Column:
    """Id of an archive's metadata: renaming or re-tagging gives a new one."""
    return F.sha2(F.concat_ws("\x00", name, time.cast("string"), comment), 256)


def rename(archives: DataFrame, old: str, new: str) -> DataFrame:
    """A renamed archive, under the id of its new metadata; its items stay."""
    hit = F.col("name") == old
    name = F.when(hit, F.lit(new)).otherwise(F.col("name"))
    comment = F.coalesce("comment", F.lit(""))
    return archives.withColumn("archive_id", F.when(hit, archive_object_id(F.lit(new), F.col("time"), comment)).otherwise(F.col("archive_id"))).withColumn("name", name)


def recompress_tally(objects: DataFrame, wanted: str, level: int) -> DataFrame:
    """outcome, objects, bytes: already wanted, recompressed, or kept because there was no gain."""
    same = (F.col("ctype") == wanted) & (F.col("clevel") == level)
    outcome = F.when(same, "already").when(F.col("new_csize") < F.col("csize"), "recompressed").otherwise("no gain")
    return objects.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("objects"), F.sum("csize").cast("bigint").alias("bytes"))


def reserved_space(objects: DataFrame) -> DataFrame:
    """count and bytes of space-reserve objects."""
    return objects.where(F.col("name").startswith("space-reserve.")).agg(F.count("*").alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
