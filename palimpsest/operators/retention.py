"""Retention rules: which snapshots of a series a policy keeps.

Rules run from the finest to the coarsest. Each walks from the newest snapshot
back, keeps the newest of every period up to its own count (or back to an
interval), skips periods that a finer rule's snapshot leads, and the last rule
given may keep the oldest snapshot as well. Everything is windows over a series,
so many series are pruned at once; ties in time go by id.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = "@PROT"
#: Rule names from the finest to the coarsest (fixed values).
RULES = ("keep", "secondly", "minutely", "hourly", "daily", "weekly", "monthly", "13weekly", "3monthly", "yearly")
ALL = -1
Value = int | timedelta


def period(rule: str, time: Column, seq: Column) -> Column:
    """Key of the period of a time under a rule, in the session's time zone."""
    week, year = F.extract(F.lit("WEEK"), time), F.extract(F.lit("YEAROFWEEK"), time)
    formats = {
        "secondly": "yyyy-MM-dd HH:mm:ss",
        "minutely": "yyyy-MM-dd HH:mm",
        "hourly": "yyyy-MM-dd HH",
        "daily": "yyyy-MM-dd",
        "monthly": "yyyy-MM",
        "yearly": "yyyy",
    }
    if rule in formats:
        return F.date_format(time, formats[rule])
    if rule == "keep":
        return seq.cast("string")
    if rule == "weekly":
        return F.format_string("%04d-%02d", year, week)
    if rule == "13weekly":
        return F.format_string("%d-%02d", year, F.least(F.greatest(F.floor((week - 1) / 13), F.lit(0)), F.lit(3)))
    if rule == "3monthly":
        return F.format_string("%d-%02d", F.year(time), F.floor((F.month(time) - 1) / 3))
    raise ValueError(f"unknown rule {rule!r}")


def validate(policy: Mapping[str, Value]) -> None:
    """Refuse policies that keep nothing or contradict themselves."""
    unknown = [r for r in policy if r not in RULES]
    if unknown:
        raise ValueError(f"unknown rules {unknown}")
    if not policy:
        raise ValueError("at least one rule is needed")
    if all(v == 0 or v == timedelta(0) for v in policy.values()):
        raise ValueError("all rules are zero: nothing would be kept")
    if "13weekly" in policy and "3monthly" in policy:
        raise ValueError("13weekly and 3monthly exclude each other")


def parse_value(text: str) -> Value:
    """A count, ``all``, or an interval such as 30d (m is 31 days, y 365)."""
    if text == "all":
        return ALL
    if text.lstrip("+").isdigit():
        return int(text)
    days = {"y": 365, "m": 31, "w": 7, "d": 1}
    seconds = {"H": 3600, "M": 60, "S": 1}
    number, unit = text[:-1], text[-1:]
    if not number.isdigit() or int(number) == 0 or unit not in {**days, **seconds}:
        raise ValueError(f"{text!r} is no count, 'all' or interval")
    return timedelta(days=int(number) * days[unit]) if unit in days else timedelta(seconds=int(number) * seconds[unit])


def prune(
    archives: DataFrame,
    policy: Mapping[str, Value],
    series: str | None = "name",
    now: datetime | None = None,
    since: datetime | None = None,
) -> DataFrame:
    """archive_id, series, time, kept, keep_rule, keep_index, kept_oldest; protected archives do not appear.

    series: column whose values are pruned independently (None: all together).
    since: archives at or after it are kept by rule ``skip`` and fill no period.
    """
    validate(policy)
    own = archives.where(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), PROTECTED))
    group = F.col(series) if series else F.lit("")
    none = F.lit(None)
    rows = own.select("archive_id", group.alias("series"), "time", none.cast("string").alias("rule"), none.cast("bigint").alias("index"), F.lit(False).alias("oldest"))
    base = since or now
    if since is not None:
        ahead = F.col("time") >= F.lit(since)
        newest = Window.partitionBy("series").orderBy(F.desc("time"), "archive_id")
        rows = rows.withColumn("index", F.when(ahead, F.row_number().over(newest) - 1)).withColumn("rule", F.when(ahead, "skip"))
    candidate = ~F.coalesce(F.col("rule") == "skip", F.lit(False))
    given = [r for r in RULES if r in policy]
    order = Window.partitionBy("series", "candidate").orderBy(F.desc("time"), "archive_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("series", "candidate")
    rows = rows.withColumn("candidate", candidate).withColumn("seq", F.row_number().over(order) - 1)
    for rule in given:
        value, last = policy[rule], rule == given[-1]
        if value == 0 or value == timedelta(0):
            continue
        if isinstance(value, timedelta):
            if base is None:
                raise ValueError("an interval needs now or since")
            reach = F.col("time") >= F.lit(base - value)
        else:
            reach = F.lit(True)
        p = period(rule, F.col("time"), F.col("seq"))
        leads = F.col("candidate") & reach & F.col("rule").isNull() & ~F.coalesce(F.lag(p).over(order) == p, F.lit(False))
        rows = rows.withColumn("mine", leads.cast("int")).withColumn("nth", F.sum("mine").over(upto))
        room = F.lit(True) if isinstance(value, timedelta) or value == ALL else F.col("nth") <= value
        takes = (F.col("mine") == 1) & room
        rows = rows.withColumn("index", F.when(takes, F.col("nth") - 1).otherwise(F.col("index"))).withColumn("rule", F.when(takes, F.lit(rule)).otherwise(F.col("rule")))
        if last:
            kept = F.sum(F.when(takes, 1).otherwise(0)).over(whole)
            rows = rows.withColumn("kept_here", kept).withColumn("n_all", F.count("*").over(whole))
            free = F.lit(True) if isinstance(value, timedelta) or value == ALL else F.col("kept_here") < value
            end = F.col("candidate") & (F.col("seq") == F.col("n_all") - 1) & F.col("rule").isNull() & reach & free
            rows = (
                rows.withColumn("oldest", end)
                .withColumn("index", F.when(F.col("oldest"), F.col("kept_here")).otherwise(F.col("index")))
                .withColumn("rule", F.when(F.col("oldest"), F.lit(rule)).otherwise(F.col("rule")))
            )
    return rows.select(
        "archive_id", "series", "time", F.col("rule").isNotNull().alias("kept"), F.col("rule").alias("keep_rule"), F.col("index").cast("bigint").alias("keep_index"), F.col("oldest").alias("kept_oldest")
    )


def label(rule: Column, index: Column, oldest: Column) -> Column:
    """``daily #1`` or ``yearly[oldest] #4``; null for archives that go."""
    return F.when(rule.isNotNull(), F.concat(rule, F.when(oldest, "[oldest]").otherwise(""), F.lit(" #"), (index + 1).cast("string")))
