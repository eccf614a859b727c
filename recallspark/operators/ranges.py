"""Numbering rows within keys of which one may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.sources.scratch import saved


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], carry: str) -> DataFrame:
    """rows with k, their number in the order of their key, and before, `carry` of the row before.

    Rows are dealt by ranges of key and order, so that a hot key spreads; each range numbers its own rows, and what the
    ranges before hold of a key is added from one row for each range and key.
    """
    own = saved(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inner, outer = W.Window.partitionBy("_range", *keys).orderBy(*order), W.Window.partitionBy(*keys).orderBy("_range")
    own = own.withColumns({"_k": F.row_number().over(inner), "before": F.lag(carry).over(inner), "_next": F.lead(F.lit(1)).over(inner)})
    parts = own.groupBy("_range", *keys).agg(F.max("_k").alias("_n"), F.max(F.when(F.col("_next").isNull(), F.struct(carry))).alias("_last"))
    parts = parts.select("_range", *keys, F.coalesce(F.sum("_n").over(outer.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.lag(f"_last.{carry}").over(outer).alias("_carried"))
    out = own.join(parts, ["_range", *keys])
    return out.withColumn("before", F.when(F.col("_k") == 1, F.col("_carried")).otherwise(F.col("before"))).withColumn("k", F.col("_k") + F.col("_start")).drop("_range", "_k", "_next", "_start", "_carried")


def running(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of value over the rows of their key up to them; keys are not null, and order leaves no ties that matter.

    Dealt as in `numbered`: each range sums its own rows, and one row for each range and key carries the sums of the ranges before.
    """
    own = saved(rows.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inner, outer = W.Window.partitionBy("_range", *keys).orderBy(*order), W.Window.partitionBy(*keys).orderBy("_range")
    own = own.withColumn("_s", F.sum("_v").over(inner.rowsBetween(W.Window.unboundedPreceding, 0)))
    parts = own.groupBy("_range", *keys).agg(F.sum("_v").alias("_n"))
    parts = parts.select("_range", *keys, F.coalesce(F.sum("_n").over(outer.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return own.join(parts, ["_range", *keys]).withColumn(name, F.coalesce("_s", F.lit(0)) + F.col("_start")).drop("_range", "_v", "_s", "_start")
