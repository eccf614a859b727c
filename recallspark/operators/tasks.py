"""Tasks: search order, risk, duplicates, counts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.functions.text import todo_title
from recallspark.sources.scratch import saved

OPEN = ("todo", "doing")


def priority_rank(c: Column | str) -> Column:
    p = F.col(c) if isinstance(c, str) else c
    return F.when(p == "high", 1).when(p == "medium", 2).otherwise(3)


def search(tasks: DataFrame, statuses: tuple[str, ...] = OPEN, word: str = "", limit: int | None = None, priority: str = "", space: Column | None = None, offset: int = 0) -> DataFrame:
    """Tasks by priority, then due time (none first), then newest; of some statuses, with a word in the title, of a priority and a space, where these are given."""
    out = tasks.where(F.col("status").isin(*statuses))
    if word:
        out = out.where(F.lower("title").contains(word.lower()))
    if priority:
        out = out.where(F.col("priority") == priority)
    if space is not None:
        out = out.where(F.col("space_id") == space)
    out = out.orderBy(priority_rank("priority"), F.asc_nulls_first("due"), F.desc("created_at"), "id").offset(offset)
    return out.limit(limit) if limit else out


def risk(tasks: DataFrame, as_of: Column) -> DataFrame:
    """id, risk, level of open tasks: overdue, urgent, due soon, or idle for long."""
    days = (F.unix_micros("due") - F.unix_micros(as_of)) / 86_400_000_000
    idle = F.floor((F.unix_micros(as_of) - F.unix_micros("created_at")) / 86_400_000_000)
    high = F.col("priority") == "high"
    kind = F.when(days < 0, "overdue").when((days <= 1) & high, "urgent").when(days <= 3, "due_soon").when(high & (idle >= 3), "idle_high").when(idle >= 7, "idle")
    level = F.when(kind.isin("overdue", "urgent"), "critical").when(kind == "idle", "info").otherwise("warning")
    return tasks.where(F.col("status").isin(*OPEN)).select("id", "priority", kind.alias("risk"), level.alias("level")).where("risk is not null")


def risk_summary(found: DataFrame, tasks: DataFrame, n: int = 5) -> DataFrame:
    """One row: how many tasks are urgent, overdue and to be warned of (found by risk), and the ids of the first n warnings by due time."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kind = F.col("risk")
    totals = found.agg(count(kind == "urgent").alias("urgent"), count(kind == "overdue").alias("overdue"), count(~kind.isin("urgent", "overdue")).alias("warnings"))
    first = found.where(~kind.isin("urgent", "overdue")).join(tasks.select("id", "due"), "id").orderBy(F.asc_nulls_last("due"), "id").limit(n)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(F.col("due").isNull().alias("a"), "due", "id"))).alias("x")).select(F.transform("x", lambda x: x["id"]).alias("warned"))
    return totals.join(F.broadcast(listed))  # one row each


def stats(tasks: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    active = F.col("status").isin(*OPEN)
    return tasks.agg(count(active).alias("active"), count(active & (F.col("priority") == "high")).alias("high"), count(F.col("status") == "done").alias("done"))


def due_counts(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Open tasks that are due on the day of as_of, and within the next 24 hours."""
    hours = (F.unix_micros("due") - F.unix_micros(as_of)) / 3_600_000_000
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return tasks.where(F.col("status").isin(*OPEN)).agg(count(F.to_date("due") == F.to_date(as_of)).alias("due_today"), count((hours >= 0) & (hours <= 24)).alias("due_24h"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def duplicates(tasks: DataFrame, least: float = 0.92) -> DataFrame:
    """id, duplicate_of, similarity: for each open task the newest earlier one of the same space, priority and due time with a like title.

    Equal titles count 1; a title inside another of at most 1 / 0.72 of its length counts 0.94; else the matching ratio decides, which is only worked
    out where lengths and shared letters let it reach `least`.  Titles are compared once for each pair of different ones in a
    block, and then the newest earlier task is taken from all tasks of the like titles.
    """
    own = tasks.where(F.col("status").isin(*OPEN)).withColumn("_t", todo_title("title")).where("_t <> ''").withColumn("_b", F.xxhash64("space_id", "priority", "due"))
    own = saved(own.select("id", "_t", "_b", F.struct("created_at", "id").alias("_at")), "titles")
    titles = own.select("_b", "_t").distinct()
    a, b = titles.withColumnRenamed("_t", "ta"), titles.withColumnRenamed("_t", "tb")
    short, long = F.least(F.length("ta"), F.length("tb")), F.greatest(F.length("ta"), F.length("tb"))
    inside = (F.contains("ta", "tb") | F.contains("tb", "ta")) & (short >= 0.72 * long)
    letters = lambda c: F.array_distinct(F.split(c, ""))
    apart = F.size(F.array_except(letters(F.col("ta")), letters(F.col("tb")))) + F.size(F.array_except(letters(F.col("tb")), letters(F.col("ta"))))
    possible = (2 * short >= least * (short + long)) & (F.length("ta") + F.length("tb") - apart >= least * (F.length("ta") + F.length("tb")))
    pairs = a.join(b, "_b").where("ta < tb").withColumn("inside", inside).where(F.col("inside") | possible)
    like = pairs.where("inside").select("_b", "ta", "tb", F.lit(0.94).alias("similarity"))
    like = like.union(pairs.where("not inside").select("_b", "ta", "tb", F.pandas_udf(_ratio, "double")("ta", "tb").alias("similarity"))).where(F.col("similarity") >= least)
    both = saved(like.union(like.select("_b", "tb", "ta", "similarity")), "like")
    order = W.Window.partitionBy("_b", "_t").orderBy("_at")
    equal = own.select("id", F.lag("_at").over(order).alias("_d"), F.lit(1.0).alias("similarity"))
    # One pass in time order over each block and title: the tasks of the title itself, and those of titles like it.
    told = both.join(own.select("_b", F.col("_t").alias("tb"), "_at"), ["_b", "tb"]).select("_b", F.col("ta").alias("_t"), "_at", F.lit(None).cast(own.schema["id"].dataType).alias("id"), "similarity")
    mixed = own.join(both.select("_b", F.col("ta").alias("_t")).distinct(), ["_b", "_t"], "left_semi").select("_b", "_t", "_at", "id", F.lit(None).cast("double").alias("similarity")).union(told)
    last = F.last(F.when(F.col("id").isNull(), F.struct("_at", "similarity")), ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    near = mixed.withColumn("_l", last).where("id is not null").select("id", "_l._at", "_l.similarity")
    found = equal.unionByName(near.withColumnRenamed("_at", "_d")).where("_d is not null")
    best = found.groupBy("id").agg(F.max_by(F.struct(F.col("_d.id").alias("d"), "similarity"), "_d").alias("x"))
    return best.select("id", F.col("x.d").alias("duplicate_of"), F.col("x.similarity").alias("similarity"))
