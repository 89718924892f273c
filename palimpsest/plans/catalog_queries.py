"""Queries over the snapshot catalog, each with the SQL it must agree with."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import analyze, catalog, diff, maintenance, patterns, retention
from palimpsest.plans import views
from palimpsest.plans.registry import register
from palimpsest.plans.views import INDEX_SQL, ITEMS_SQL, PACKS_SQL, REFS_SQL, SNAPSHOTS_SQL, table, with_sql
from palimpsest.session import shared_folder

# Analysis

_BUCKETS = """
per_chunk as (select chunk_id, min(name) as low, max(name) as high, max(size) as size from refs group by 1),
bucketed as (select case when low is null then 'unreferenced' when low = high then low else 'shared' end as name,
  coalesce(size, 0) as size, obj_size from idx left join per_chunk using (chunk_id))"""


@register(
    "analyze_by_name",
    with_sql(REFS_SQL, INDEX_SQL, _BUCKETS)
    + """, sums as (select name, count(*) as chunks, sum(size)::bigint as source_size, sum(obj_size)::bigint as stored_size from bucketed group by 1),
    n as (select name, count(distinct archive_id) as archives from refs group by 1)
    select coalesce(sums.name, n.name) as name, archives, coalesce(chunks, 0)::bigint as chunks, coalesce(source_size, 0)::bigint as source_size,
      coalesce(stored_size, 0)::bigint as stored_size from n full outer join sums on n.name = sums.name""",
)
def analyze_by_name(spark, d):
    return analyze.by_name(views.references(spark, d), views.chunk_index(spark, d))


def _set_sql(mine: str) -> str:
    return with_sql(REFS_SQL, INDEX_SQL) + f""", per_chunk as (select chunk_id, max(size) as size, bool_or({mine}) as mine, bool_or(not ({mine})) as rest,
      count(*) filter ({mine}) as n_refs from refs group by 1),
    b as (select * from idx full outer join per_chunk using (chunk_id)),
    w as (select not coalesce(bool_or(rest), false) as whole from per_chunk)
    select any_value(whole) as whole_repository,
      coalesce(sum(size) filter (mine and obj_size is not null), 0)::bigint as source_size,
      coalesce(sum(obj_size) filter (mine), 0)::bigint as stored_size,
      case when not any_value(whole) then coalesce(sum(size) filter (mine and not rest and obj_size is not null), 0)::bigint end as exclusive_source,
      case when not any_value(whole) then coalesce(sum(obj_size) filter (mine and not rest), 0)::bigint end as exclusive_stored,
      count(*) filter (mine is null) as unreferenced_chunks,
      coalesce(sum(obj_size) filter (mine is null), 0)::bigint as unreferenced_stored,
      count(obj_size) as total_chunks,
      coalesce(sum(n_refs) filter (obj_size is null and mine), 0)::bigint as missing_references
    from b, w"""


@register("analyze_set", _set_sql("name = 'BUILDING'"))
def analyze_set(spark, d):
    return analyze.of_set(views.references(spark, d), views.chunk_index(spark, d), F.col("name") == "BUILDING")


@register("analyze_whole", _set_sql("true"))
def analyze_whole(spark, d):
    return analyze.of_set(views.references(spark, d), views.chunk_index(spark, d), F.lit(True))


@register("unreferenced", with_sql(REFS_SQL, INDEX_SQL) + "select idx.* from idx where chunk_id not in (select chunk_id from refs)")
def unreferenced(spark, d):
    return analyze.unreferenced(views.references(spark, d), views.chunk_index(spark, d))


@register(
    "hotspots_top20",
    with_sql(REFS_SQL)
    + """, num as (select archive_id, row_number() over (order by time, archive_id) - 1 as i from (select distinct archive_id, time from refs)),
    held as (select distinct i, directory, chunk_id, size from refs join num using (archive_id)),
    last as (select max(i) as n from num),
    one as (select a.directory, a.chunk_id, a.size from held a, last where a.i < last.n and not exists (select 1 from held b where b.i = a.i + 1 and b.directory = a.directory and b.chunk_id = a.chunk_id)
      union all select a.directory, a.chunk_id, a.size from held a where a.i > 0 and not exists (select 1 from held b where b.i = a.i - 1 and b.directory = a.directory and b.chunk_id = a.chunk_id))
    select directory, sum(size)::bigint as size from one group by 1 order by 2 desc, 1 limit 20""",
)
def hotspots_top20(spark, d):
    return analyze.hotspots(views.references(spark, d), 20)


@register(
    "compression_factor",
    with_sql(REFS_SQL, INDEX_SQL) + ", x as (select directory, sum(refs.size)::bigint as source, sum(obj_size)::bigint as stored from refs join idx using (chunk_id) group by 1) select directory, source, stored, case when source <> 0 then stored / source end as factor from x",
)
def compression_factor(spark, d):
    both = views.references(spark, d).join(views.chunk_index(spark, d).select("chunk_id", "obj_size"), "chunk_id")
    sums = both.groupBy("directory").agg(F.sum("size").alias("source"), F.sum("obj_size").alias("stored"))
    return sums.select("directory", "source", "stored", analyze.compression_factor(F.col("stored"), F.col("source")).alias("factor"))


@register("content_size", with_sql(ITEMS_SQL) + "select archive_id, path, list_sum(list_transform(chunks, lambda c: c.size))::bigint as size, len(chunks) as num_chunks from items")
def content_size(spark, d):
    return views.items(spark, d).select("archive_id", "path", analyze.content_size(F.col("chunks")).alias("size"), F.size("chunks").cast("bigint").alias("num_chunks"))


@register(
    "dedup_lines_by_source",
    """with l as (select source, unnest(string_split(text, chr(10))) as line from documents),
    c as (select line, min(source) as low, max(source) as high from l group by 1)
    select case when low = high then low else 'shared' end as name, count(*) as chunks, sum(strlen(line))::bigint as bytes from c group by 1""",
)
def dedup_lines_by_source(spark, d):
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    per_line = lines.groupBy("line").agg(F.min("source").alias("low"), F.max("source").alias("high"))
    name = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("shared")
    return per_line.groupBy(name.alias("name")).agg(F.count("*").alias("chunks"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))


# Diff

_A, _B = "1996-01", "1996-02"


def _diff_sql(columns: str) -> str:
    only = lambda here, there: f"coalesce(list_sum(list_transform(list_filter(list_distinct({here}), lambda c: not list_contains(list_transform({there}, lambda z: z.id), c.id)), lambda c: c.size)), 0)"
    size = lambda c: f"coalesce(list_sum(list_transform({c}, lambda z: z.size)), 0)"
    return with_sql(ITEMS_SQL) + f""", x as (select * from items where archive_id = '{_A}'), y as (select * from items where archive_id = '{_B}'),
    j as (select coalesce(x.path, y.path) as path, case when x.path is null then 'added' when y.path is null then 'removed' else 'changed' end as kind,
      x.chunks as xc, y.chunks as yc, x.mode as xm, y.mode as ym, x."user" as xu, y."user" as yu, x.mtime as xt, y.mtime as yt, x.ordinal as xo, y.ordinal as yo
      from x full outer join y on x.path = y.path),
    r as (select path, kind, kind = 'changed' and xc <> yc as modified,
      (case when kind = 'added' then {size("yc")} when kind = 'removed' then 0 when xc <> yc then {only("yc", "xc")} else 0 end)::bigint as added,
      (case when kind = 'removed' then {size("xc")} when kind = 'added' then 0 when xc <> yc then {only("xc", "yc")} else 0 end)::bigint as removed,
      case when kind = 'changed' and xm <> ym then xm end as mode_from, case when kind = 'changed' and xm <> ym then ym end as mode_to,
      case when kind = 'changed' and xu <> yu then xu end as owner_from, case when kind = 'changed' and xu <> yu then yu end as owner_to,
      kind = 'changed' and xt <> yt as mtime_changed,
      case kind when 'changed' then 0 when 'added' then 1 else 2 end as order1, coalesce(greatest(xo, yo), xo, yo) as order2,
      case when kind = 'changed' and xo < yo then 1 else 0 end as order3 from j)
    {columns}"""


_KEEP = "(kind <> 'changed' or modified or mode_from is not null or owner_from is not null or mtime_changed)"


def _months(spark, d):
    rows = views.items(spark, d)
    return rows.where(F.col("archive_id") == _A).drop("archive_id"), rows.where(F.col("archive_id") == _B).drop("archive_id")


def _flat(changes):
    return changes.select(
        "path", "kind", "modified", "added", "removed",
        F.col("mode.from").alias("mode_from"), F.col("mode.to").alias("mode_to"),
        F.col("owner.from").alias("owner_from"), F.col("owner.to").alias("owner_to"),
        "mtime_changed", "order1", "order2", "order3",
    )


@register("diff_months", _diff_sql(f"select * from r where {_KEEP}"))
def diff_months(spark, d):
    return _flat(diff.compare(*_months(spark, d)))


@register("diff_content_only", _diff_sql("select path, kind, modified, added, removed, order1, order2, order3 from r where kind <> 'changed' or modified"))
def diff_content_only(spark, d):
    return diff.compare(*_months(spark, d), content_only=True)


@register(
    "diff_order",
    _diff_sql(f"select path, kind, row_number() over (order by order1, order2, order3) as place from r where {_KEEP} qualify place <= 200"),
)
def diff_order(spark, d):
    from pyspark.sql import Window

    first = diff.reported(diff.compare(*_months(spark, d))).limit(200)
    return first.select("path", "kind", F.row_number().over(Window.orderBy("order1", "order2", "order3", "path")).cast("bigint").alias("place"))


@register("diff_order_all", _diff_sql(f"select path, kind, row_number() over (order by order1, order2, order3) as place from r where {_KEEP}"))
def diff_order_all(spark, d):
    """The whole diff with places; diff_order keeps the 200 rows of its SQL."""
    return diff.placed(diff.compare(*_months(spark, d)), shared_folder(spark, "diff")).select("path", "kind", "place")


@register(
    "diff_sorted",
    _diff_sql(
        "select r.path, row_number() over (order by coalesce(q.yu, ''), coalesce(list_sum(list_transform(q.yc, lambda z: z.size)), 0) desc, "
        "coalesce(epoch_us(q.yt), 0) - coalesce(epoch_us(q.xt), 0), order1, order2, order3) as place "
        f"from r join (select path, yu, yc, xt, yt from j) q on r.path = q.path where {_KEEP}"
    ),
)
def diff_sorted(spark, d):
    changes = diff.compare(*_months(spark, d), sort_values=True)
    return diff.placed(changes, shared_folder(spark, "diff"), keys=("user", ">size", "mtime_diff")).select("path", "place")


@register(
    "diff_largest",
    _diff_sql(f"select path, added, removed from r where {_KEEP} order by added - removed desc, path limit 50"),
)
def diff_largest(spark, d):
    return diff.compare(*_months(spark, d)).orderBy(F.desc(F.col("added") - F.col("removed")), "path").limit(50).select("path", "added", "removed")


@register("diff_totals", _diff_sql(f"select count(*) filter (kind = 'added') as n_added, count(*) filter (kind = 'removed') as n_removed, count(*) filter (modified) as n_modified, sum(added)::bigint as added, sum(removed)::bigint as removed from r where {_KEEP}"))
def diff_totals(spark, d):
    return diff.totals(diff.compare(*_months(spark, d)))


@register(
    "diff_other_chunker",
    with_sql(ITEMS_SQL)
    + f""", s as (select archive_id, path, list_sum(list_transform(chunks, lambda c: c.size))::bigint as size from items)
    select path, y.size as added, x.size as removed from s x join s y using (path) where x.archive_id = '{_A}' and y.archive_id = '{_B}' and x.size <> y.size""",
)
def diff_other_chunker(spark, d):
    rows = diff.compare(*_months(spark, d), same_chunker=False, content_only=True)
    return rows.where("kind = 'changed'").select("path", "added", "removed")


# Retention

_NOW = datetime(2024, 2, 1)
_PERIOD_SQL = {
    "keep": "seq::varchar",
    "secondly": "strftime(time, '%Y-%m-%d %H:%M:%S')",
    "minutely": "strftime(time, '%Y-%m-%d %H:%M')",
    "hourly": "strftime(time, '%Y-%m-%d %H')",
    "daily": "strftime(time, '%Y-%m-%d')",
    "weekly": "strftime(time, '%G-%V')",
    "monthly": "strftime(time, '%Y-%m')",
    "13weekly": "isoyear(time) || '-' || least((week(time) - 1) // 13, 3)",
    "3monthly": "year(time) || '-' || (month(time) - 1) // 3",
    "yearly": "strftime(time, '%Y')",
}


def _prune_sql(policy: dict, series: bool = True, since: datetime | None = None, where: str = "true") -> str:
    part = "name" if series else "''"
    base = since or _NOW
    order = "partition by series, cand order by time desc, archive_id"
    skip = f"time >= timestamp '{since}'" if since else "false"
    out = with_sql(SNAPSHOTS_SQL) + f""", r0 as (select archive_id, {part} as series, time, case when {skip} then 'skip' end as rule,
      case when {skip} then row_number() over (partition by {part} order by time desc, archive_id) - 1 end as idx, not ({skip}) as cand, false as oldest from snaps where not list_contains(tags, '@PROT') and {where}),
    s0 as (select *, row_number() over ({order}) - 1 as seq, count(*) over (partition by series, cand) as n_all from r0)"""
    given = [r for r in retention.RULES if r in policy]
    k = 0
    for rule in given:
        value = policy[rule]
        if value == 0:
            continue
        reach = f"time >= timestamp '{base - value}'" if isinstance(value, timedelta) else "true"
        room = "true" if isinstance(value, timedelta) or value == retention.ALL else f"nth <= {value}"
        free = "true" if isinstance(value, timedelta) or value == retention.ALL else f"mine < {value}"
        last = rule == given[-1]
        out += f""", l{k} as (select *, case when cand and {reach} and rule is null and (lag({_PERIOD_SQL[rule]}) over ({order})) is distinct from {_PERIOD_SQL[rule]} then 1 else 0 end as lead_ from s{k}),
        n{k} as (select *, sum(lead_) over ({order} rows unbounded preceding) as nth from l{k}),
        t{k} as (select *, lead_ = 1 and {room} as takes from n{k}),
        m{k} as (select *, count(*) filter (takes) over (partition by series, cand) as mine from t{k}),
        s{k + 1} as (select archive_id, series, time, cand, seq, n_all,
          {"cand and seq = n_all - 1 and rule is null and not takes and " + reach + " and " + free if last else "false"} as oldest,
          case when takes then '{rule}' when {"cand and seq = n_all - 1 and rule is null and " + reach + " and " + free if last else "false"} then '{rule}' else rule end as rule,
          case when takes then nth - 1 when {"cand and seq = n_all - 1 and rule is null and " + reach + " and " + free if last else "false"} then mine else idx end as idx from m{k})"""
        k += 1
    return out + f" select archive_id, series, time, rule is not null as kept, rule as keep_rule, idx::bigint as keep_index, oldest as kept_oldest from s{k}"


_POLICIES = {
    "prune_daily_7": ({"daily": 7}, True, None),
    "prune_chain": ({"daily": 3, "weekly": 2, "monthly": 12}, True, None),
    "prune_interval": ({"hourly": timedelta(days=3), "daily": timedelta(days=14)}, True, None),
    "prune_13weekly": ({"hourly": 5, "13weekly": 4, "yearly": retention.ALL}, True, None),
    "prune_3monthly": ({"keep": 3, "minutely": 10, "secondly": 4, "3monthly": 2}, True, None),
    "prune_since": ({"daily": 5, "weekly": 0}, True, datetime(2024, 1, 25)),
}


def _prune(policy, series, since):
    def query(spark, d):
        return retention.prune(views.snapshots(spark, d), policy, "name" if series else None, now=_NOW, since=since)

    return query


for _name, (_policy, _series, _since) in _POLICIES.items():
    register(_name, _prune_sql(_policy, _series, _since))(_prune(_policy, _series, _since))


@register(
    "prune_labels",
    f"select name, label, count(*) as n from (select series as name, keep_rule || case when kept_oldest then '[oldest]' else '' end || ' #' || (keep_index + 1) as label from ({_prune_sql({'daily': 3, 'monthly': 2})}) where kept) group by 1, 2",
)
def prune_labels(spark, d):
    kept = retention.prune(views.snapshots(spark, d), {"daily": 3, "monthly": 2}, now=_NOW).where("kept")
    label = retention.label(F.col("keep_rule"), F.col("keep_index"), F.col("kept_oldest"))
    return kept.groupBy(F.col("series").alias("name"), label.alias("label")).agg(F.count("*").alias("n"))


# Listing

_LIST = "select archive_id, name, time from snaps"


@register("list_first_last", with_sql(SNAPSHOTS_SQL) + ", h as (select * from snaps order by name, time desc, archive_id limit 100), t as (select * from (select *, row_number() over (order by name, time desc, archive_id) as p, count(*) over () as n from h) where p > n - 10) select row_number() over (order by name desc, time asc, archive_id desc) as place, archive_id, name, time from t")
def list_first_last(spark, d):
    options = catalog.ListOptions(sort=("name", ">ts"), first=100, last=10, reverse=True)
    return catalog.list_archives(views.snapshots(spark, d), options).withColumn("place", F.col("place").cast("bigint"))


@register("list_sorted", with_sql(SNAPSHOTS_SQL) + _LIST + " where host = 'host3' and list_contains(tags, 'weekly')")
def list_sorted(spark, d):
    return catalog.list_archives(views.snapshots(spark, d), catalog.ListOptions(match=("host:host3", "tags:weekly"), sort=("host", "ts")))


@register("list_newest", with_sql(SNAPSHOTS_SQL) + _LIST + " where time >= (select max(time) from snaps) - interval 2 days")
def list_newest(spark, d):
    return catalog.select_archives(views.snapshots(spark, d), catalog.ListOptions(newest=timedelta(days=2))).select("archive_id", "name", "time")


@register("list_oldest", with_sql(SNAPSHOTS_SQL) + _LIST + " where \"user\" <> '' and name = (select min(name) from snaps) and time <= (select min(time) from snaps where name = (select min(name) from snaps)) + interval 36 hours")
def list_oldest(spark, d):
    snaps = views.snapshots(spark, d)
    first = snaps.agg(F.min("name").alias("name"))
    return catalog.select_archives(snaps.join(F.broadcast(first), "name"), catalog.ListOptions(oldest=timedelta(hours=36))).select("archive_id", "name", "time")


@register("list_range", with_sql(SNAPSHOTS_SQL) + _LIST + f" where time >= timestamp '{_NOW}' - interval 5 days and regexp_full_match(name, '(c|p).*')")
def list_range(spark, d):
    return catalog.select_archives(views.snapshots(spark, d), catalog.ListOptions(match=("re:(c|p).*",), newer=timedelta(days=5), now=_NOW)).select("archive_id", "name", "time")


@register("select_aid", with_sql(SNAPSHOTS_SQL) + _LIST + " where starts_with(archive_id, '0000001')")
def select_aid(spark, d):
    return catalog.select_archives(views.snapshots(spark, d), catalog.ListOptions(match=("aid:0000001",))).select("archive_id", "name", "time")


@register("select_name_pattern", with_sql(SNAPSHOTS_SQL) + _LIST + " where regexp_full_match(name, '[^/]*i[^/]*') and \"user\" = '7'")
def select_name_pattern(spark, d):
    return catalog.select_archives(views.snapshots(spark, d), catalog.ListOptions(match=("sh:*i*", "user:7"))).select("archive_id", "name", "time")


@register("by_name_latest", with_sql(SNAPSHOTS_SQL) + "select name, arg_max(archive_id, (time, archive_id)) as archive_id, max(time) as time from snaps group by 1")
def by_name_latest(spark, d):
    return catalog.latest_by_name(views.snapshots(spark, d))


@register("open_by_name", with_sql(SNAPSHOTS_SQL) + "select archive_id, name, time, host from snaps where name = (select max(name) from snaps) order by time desc, archive_id desc limit 1")
def open_by_name(spark, d):
    snaps = views.snapshots(spark, d)
    last = F.max_by(F.struct("archive_id", "name", "time", "host"), F.struct("name", "time", "archive_id"))
    return snaps.agg(last.alias("a")).select("a.*")


_PATHS_SQL = "paths as (select doc_id, source || '/' || lang || '/' || doc_id || case when doc_id % 3 = 0 then '/text.txt' else '' end as path from documents)"


def _paths(spark, d):
    leaf = F.when(F.col("doc_id") % 3 == 0, "/text.txt").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), leaf).alias("path"))


@register("list_depth", with_sql(_PATHS_SQL) + "select doc_id, path from paths where len(path) - len(replace(path, '/', '')) <= 2")
def list_depth(spark, d):
    items = _paths(spark, d).withColumn("ordinal", F.col("doc_id"))
    return catalog.list_items(items, depth=2).select("doc_id", "path")


def _match(name: str, style: str, pattern: str, regex: str) -> None:
    suffix = " || '/'" if style in ("fm", "sh") else ""
    sql = with_sql(_PATHS_SQL) + f"select doc_id, path from paths where regexp_matches(path{suffix}, '{regex}')"

    @register(name, sql)
    def query(spark, d):
        return _paths(spark, d).where(patterns.matches(F.col("path"), style, pattern))


_match("match_sh", "sh", "src[0-9]/{en,de}/*[37]", r"(?s)\A(?:src[0-9]/(en|de)/[^/]*[37])/([^/]*/)*[^/]*")
_match("match_sh_deep", "sh", "**/*.t?t", r"(?s)\A([^/]*/)*[^/]*\.t[^/]t/([^/]*/)*[^/]*")
_match("match_fm", "fm", "*/[!e]?/*1[0-4]*", r"(?s)\A.*/[^e]./.*1[0-4].*/.*\z")
_match("match_re", "re", r"/(fr|es)/[0-9]*[13579]$", r"/(fr|es)/[0-9]*[13579]$")
_match("match_pp", "pp", "/src3/./en/", r"\Asrc3/en(/|\z)")


@register("match_pf", with_sql(_PATHS_SQL) + "select doc_id, path from paths where path = (select min(path) from paths)")
def match_pf(spark, d):
    paths = _paths(spark, d)
    return paths.join(F.broadcast(paths.agg(F.min("path").alias("path"))), "path").select("doc_id", "path")


@register(
    "match_rules",
    with_sql(_PATHS_SQL)
    + r"""select doc_id, path, case when path = 'src1/en/1' then true when regexp_matches(path || '/', '(?s)\A.*7.*/.*\z') then true when regexp_matches(path, '[02468]$') then false
    when regexp_matches(path || '/', '(?s)\A(?:[^/]*/)*[^/]*3[^/]*/(?:[^/]*/)*[^/]*') then true else false end as included from paths""",
)
def match_rules(spark, d):
    rules = [patterns.Rule.read(x) for x in ("+ fm:*7*", "- re:[02468]$", "+ sh:**/*3*", "- re:", "+ pf:src1/en/1")]
    return _paths(spark, d).select("doc_id", "path", patterns.included(F.col("path"), rules).alias("included"))


@register(
    "exclude_tagged",
    with_sql(_PATHS_SQL) + ", t as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from paths where path like '%/text.txt' and doc_id % 2 = 0) select doc_id, path from paths where not exists (select 1 from t where path = dir or starts_with(path, dir || '/'))",
)
def exclude_tagged(spark, d):
    marked = _paths(spark, d).withColumn("path", F.when((F.col("doc_id") % 2 == 0) & F.col("path").endswith("/text.txt"), F.regexp_replace("path", "text.txt$", "CACHEDIR.TAG")).otherwise(F.col("path")))
    return patterns.excluded_by_tag(marked, ["CACHEDIR.TAG"]).select("doc_id", "path")


@register("find_in_archives", with_sql(ITEMS_SQL) + r"""select archive_id, path from items where regexp_matches(path, '/1?7$') and archive_id >= '2000-01'""")
def find_in_archives(spark, d):
    items = views.items(spark, d).select("archive_id", "path", "ordinal")
    archives = items.select("archive_id").distinct().where("archive_id >= '2000-01'").withColumn("time", F.to_timestamp("archive_id", "yyyy-MM"))
    return catalog.find(items, archives, [patterns.Rule("+", "re", "/1?7$")]).select("archive_id", "path")


@register("page_keyset", with_sql(INDEX_SQL) + "select chunk_id, pack_id, obj_size from idx where chunk_id > 100 order by chunk_id limit 25")
def page_keyset(spark, d):
    return catalog.after(views.chunk_index(spark, d), "chunk_id", 100, 25).select("chunk_id", "pack_id", "obj_size")


@register(
    "search_bytes",
    "with h as (select doc_id, regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g') as h from documents) select doc_id as chunk_id, (instr(h, '41 70 61 63 68 65') - 1) // 3 as \"offset\" from h where instr(h, '41 70 61 63 68 65') > 0",
)
def search_bytes(spark, d):
    objects = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").cast("binary").alias("data"))
    return catalog.search_bytes(objects, b"Apache").select("chunk_id", "offset")


@register("search_hits", "select doc_id as chunk_id, ((len(text) - len(replace(text, 'the', ''))) // 3)::bigint as hits from documents where contains(text, 'the')")
def search_hits(spark, d):
    objects = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").cast("binary").alias("data"))
    return catalog.search_bytes(objects, b"the").select("chunk_id", "hits")


@register(
    "search_across",
    "with o as (select doc_id, hex(encode(coalesce(text, ''))) as h, lead(doc_id) over w as next_id, lead(hex(encode(coalesce(text, '')))) over w as nh from documents window w as (order by doc_id nulls first)) "
    "select doc_id as chunk_id, next_id, (len(h) // 2 - 1)::bigint as \"offset\" from o where right(h, 2) || left(nh, 2) = '2E54'",
)
def search_across(spark, d):
    objects = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").cast("binary").alias("data"))
    return catalog.search_across(objects, b".T", ("chunk_id",), shared_folder(spark, "search")).select("chunk_id", "next_id", "offset")


@register("edit_tags", with_sql(SNAPSHOTS_SQL) + "select archive_id, list_sort(list_distinct(list_filter(list_concat(tags, ['b', 'a']), lambda t: t <> 'weekly'))) as tags from snaps where name = 'view'")
def edit_tags(spark, d):
    return catalog.edit_tags(views.snapshots(spark, d).where("name = 'view'"), add=("b", "a"), remove=("weekly",)).select("archive_id", "tags")


# Maintenance

_PLAN_SQL = with_sql(REFS_SQL, INDEX_SQL, PACKS_SQL) + """, live as (select distinct chunk_id from refs),
  u as (select pack_id, sum(obj_size)::bigint as indexed, coalesce(sum(obj_size) filter (live.chunk_id is not null), 0)::bigint as alive from idx left join live using (chunk_id) group by 1),
  p as (select packs.pack_id, size, coalesce(indexed, 0) as indexed, coalesce(alive, 0) as alive from packs left join u using (pack_id)),
  a as (select *, case when indexed - alive = 0 or size = 0 then 'keep' when alive = 0 and indexed = size then 'drop' when (indexed - alive) * 100 // size >= 10 then 'rewrite' else 'keep' end as action from p)"""


@register("compact_plan", _PLAN_SQL + " select pack_id, size, indexed, alive, action, (case when action = 'keep' then 0 else indexed - alive end)::bigint as freed from a")
def compact_plan(spark, d):
    return maintenance.compact_plan(views.chunk_index(spark, d), views.packs(spark, d), maintenance.live_chunks(views.references(spark, d)))


@register("compact_stats", _PLAN_SQL + " select count(*) as packs_before, count(*) filter (action = 'drop') as packs_dropped, count(*) filter (action = 'rewrite') as packs_rewritten, count(*) filter (action = 'keep') as packs_kept, sum(size)::bigint as bytes_before, sum(size - case when action = 'keep' then 0 else indexed - alive end)::bigint as bytes_after from a")
def compact_stats(spark, d):
    return maintenance.compact_stats(compact_plan(spark, d))


def _holed(spark, d):
    return views.chunk_index(spark, d).where(F.col("chunk_id") % 10 != 3)


@register("check_missing", with_sql(REFS_SQL) + "select archive_id, path, chunk_id, size from refs where chunk_id % 10 = 3")
def check_missing(spark, d):
    return maintenance.missing(views.references(spark, d), _holed(spark, d)).select("archive_id", "path", "chunk_id", "size")


@register("check_missing_capped", with_sql(REFS_SQL) + ", g as (select distinct archive_id, path, chunk_id from refs where chunk_id % 10 = 3) select archive_id, chunk_id, path, row_number() over (partition by archive_id order by path, chunk_id) as nth, count(*) over (partition by archive_id) as total from g qualify nth <= 10")
def check_missing_capped(spark, d):
    refs = views.references(spark, d).select("archive_id", "path", "chunk_id").distinct()
    return maintenance.missing_report(refs, _holed(spark, d)).withColumn("nth", F.col("nth").cast("bigint"))


@register("missing_paths", with_sql(REFS_SQL) + ", g as (select distinct chunk_id, path from refs where chunk_id % 10 = 3), r as (select *, row_number() over (partition by chunk_id order by path) as n from g) select chunk_id, string_agg(path, ',' order by path) as paths from r where n <= 10 group by 1 order by 1 limit 1000")
def missing_paths(spark, d):
    return maintenance.missing_paths(views.references(spark, d), _holed(spark, d))


@register("check_rehash", "select doc_id from documents where sha256(text) <> sha256(case when doc_id % 50 = 0 then text || '!' else text end)")
def check_rehash(spark, d):
    docs = table(spark, d, "documents")
    claimed = F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256)
    return maintenance.rehash(docs.withColumn("id", claimed).withColumn("data", F.col("text").cast("binary")), "data", "id").select("doc_id")


@register("check_packs", with_sql(INDEX_SQL, PACKS_SQL) + ", i as (select pack_id, chunk_id, case when chunk_id % 40 = 0 then obj_offset - 5 else obj_offset end as o, obj_size as s from idx), r as (select i.*, lag(o + s) over (partition by pack_id order by o, chunk_id) as before, packs.size from i join packs using (pack_id)) select pack_id, chunk_id, case when before > o then 'overlap' else 'overrun' end as problem from r where before > o or o + s > size")
def check_packs(spark, d):
    moved = views.chunk_index(spark, d).withColumn("obj_offset", F.when(F.col("chunk_id") % 40 == 0, F.col("obj_offset") - 5).otherwise(F.col("obj_offset")))
    return maintenance.overlapping(moved, views.packs(spark, d))


_FRAGMENTS_SQL = "f as (select l_partkey as chunk_id, year(l_shipdate) as fragment, max(l_suppkey) as pack_id from lineitem group by 1, 2)"


@register("merge_fragments", with_sql(_FRAGMENTS_SQL) + "select chunk_id, arg_max(pack_id, fragment) as pack_id from f group by 1")
def merge_fragments(spark, d):
    lines = table(spark, d, "lineitem")
    fragments = lines.groupBy(F.col("l_partkey").alias("chunk_id"), F.year("l_shipdate").alias("fragment")).agg(F.max("l_suppkey").alias("pack_id"))
    return maintenance.merge_fragments(fragments)


@register("dedup_add", with_sql(REFS_SQL) + "select distinct l_partkey as chunk_id from lineitem where l_shipdate >= timestamp '2000-01-01' and l_partkey not in (select chunk_id from refs)")
def dedup_add(spark, d):
    incoming = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")).select(F.col("l_partkey").alias("chunk_id"))
    return maintenance.new_chunks(incoming, views.references(spark, d).select("chunk_id").distinct())


@register("get_many", with_sql(INDEX_SQL) + "select * from idx where chunk_id in (select l_partkey from lineitem where l_orderkey < 100)")
def get_many(spark, d):
    wanted = table(spark, d, "lineitem").where("l_orderkey < 100").select(F.col("l_partkey").alias("chunk_id"))
    return maintenance.get_many(views.chunk_index(spark, d), wanted)


@register("transfer_plan", with_sql(REFS_SQL) + ", per as (select chunk_id, max(size) as size from refs group by 1) select chunk_id % 3 = 0 as present, count(*) as chunks, sum(size)::bigint as bytes from per group by 1")
def transfer_plan(spark, d):
    return maintenance.transfer_plan(views.references(spark, d), views.chunk_index(spark, d).where(F.col("chunk_id") % 3 == 0))


@register("to_transfer", with_sql(SNAPSHOTS_SQL) + "select name, archive_id from snaps where time >= timestamp '2024-01-20'")
def to_transfer(spark, d):
    snaps = views.snapshots(spark, d).select("name", "archive_id", "time")
    return maintenance.to_transfer(snaps, snaps.where(F.col("time") < F.lit("2024-01-20").cast("timestamp"))).select("name", "archive_id")


@register("hardlink_groups", "select l_orderkey, l_linenumber, l_partkey, first_value(l_partkey) over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey) as owner from lineitem where l_orderkey % 5 = 0")
def hardlink_groups(spark, d):
    lines = table(spark, d, "lineitem").where("l_orderkey % 5 = 0")
    items = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), F.struct("l_orderkey", "l_suppkey").alias("hlid"), F.struct("l_linenumber", "l_partkey").alias("ordinal"))
    return maintenance.hardlinks(items).select("l_orderkey", "l_linenumber", F.col("path").alias("l_partkey"), F.col("owner_path").alias("owner"))


@register("hardlink_groups_all", "select l_orderkey, l_linenumber, l_partkey, first_value(l_partkey) over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey) as owner from lineitem")
def hardlink_groups_all(spark, d):
    """Groups of all line items; hardlink_groups keeps the fifth that its SQL names."""
    lines = table(spark, d, "lineitem")
    items = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), F.struct("l_orderkey", "l_suppkey").alias("hlid"), F.struct("l_linenumber", "l_partkey").alias("ordinal"))
    return maintenance.hardlinks(items).select("l_orderkey", "l_linenumber", F.col("path").alias("l_partkey"), F.col("owner_path").alias("owner"))


@register("resolve_owner", "select c_custkey, c_name as \"user\", case when n_name is null then c_custkey else n_nationkey end as uid from customer left join nation on n_nationkey = c_nationkey and n_name < 'M'")
def resolve_owner(spark, d):
    customers = table(spark, d, "customer")
    nations = table(spark, d, "nation")
    named = customers.join(F.broadcast(nations), customers["c_nationkey"] == nations["n_nationkey"]).select("c_custkey", "c_name", F.col("n_name").alias("user"), F.col("c_custkey").alias("uid"))
    users = nations.where("n_name < 'M'").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("uid"))
    return maintenance.resolve_owner(named, users).select("c_custkey", F.col("c_name").alias("user"), "uid")


@register("soft_delete", with_sql(SNAPSHOTS_SQL) + "select archive_id, time < timestamp '2024-01-05' as deleted from snaps")
def soft_delete(spark, d):
    snaps = views.snapshots(spark, d).withColumn("deleted", F.lit(False))
    return maintenance.soft_delete(snaps, snaps.where(F.col("time") < F.lit("2024-01-05").cast("timestamp"))).select("archive_id", "deleted")


@register("repository_totals", with_sql(INDEX_SQL, PACKS_SQL) + "select (select count(*) from packs) as packs, (select sum(size)::bigint from packs) as bytes, (select count(*) from idx) as objects")
def repository_totals(spark, d):
    packs = views.packs(spark, d).agg(F.count("*").alias("packs"), F.sum("size").alias("bytes"))
    return packs.join(F.broadcast(views.chunk_index(spark, d).agg(F.count("*").alias("objects"))))


@register(
    "files_status",
    """with old as (select user_id, max(event_id) as v, count(*) as size from events where ts < timestamp '2024-01-15' group by 1),
    new as (select user_id, max(event_id) as v, count(*) as size from events where ts < timestamp '2024-01-16' and user_id % 3 = 0 group by 1)
    select new.user_id, case when old.user_id is null then 'A' when old.v = new.v and old.size = new.size then 'U' else 'M' end as status from new left join old using (user_id)""",
)
def files_status(spark, d):
    from palimpsest.streaming import files_state

    events = table(spark, d, "events")
    seen = lambda until, extra: events.where((F.col("ts") < F.lit(until).cast("timestamp")) & extra).groupBy("user_id").agg(F.max("event_id").alias("mtime_ns"), F.count("*").alias("size"))
    old = seen("2024-01-15", F.lit(True)).withColumnRenamed("user_id", "path_key")
    new = seen("2024-01-16", F.col("user_id") % 3 == 0).withColumnRenamed("user_id", "path_key")
    return files_state.status(new, old, ("size", "mtime_ns")).select(F.col("path_key").alias("user_id"), "status")
