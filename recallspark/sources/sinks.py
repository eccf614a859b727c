"""Keyed writes as DataFrames: upserts that never lose contents, inserts that keep what is there, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.sources.scratch import saved


#: What becomes of a column when a key comes again: a value fills what is there unless it is null or blank, replaces it in any case, stays once there is one, or the
#: larger or the smaller of both stays.
RULES = ("fill", "replace", "keep", "max", "min")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """target after updates: of several updates of a key the last by `order` holds, then each column follows its rule (see RULES), "fill" where none is given.

    Columns that only one side has are kept.  The result is a new version; write it beside the old one, or use `upsert_table`.
    """
    rules = rules or {}
    if bad := {c: r for c, r in rules.items() if r not in RULES or c in keys}:
        raise ValueError(f"rules {bad}; a rule is one of {RULES}, and keys have none")
    rest = [*(order or []), *[c for c in updates.columns if c not in keys and c not in (order or [])]]
    new = updates.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else updates.select(*keys).distinct()
    names = [*target.columns, *[c for c in updates.columns if c not in target.columns]]
    a, b = target.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")

    def value(c: str):
        if c not in new.columns:
            return F.col(f"a.{c}")
        fresh, rule = F.col(f"b.{c}"), rules.get(c, "fill")
        some = F.when(F.trim(fresh) != "", fresh) if dict(new.dtypes)[c] == "string" else fresh
        if c not in target.columns:
            return fresh if rule == "replace" else some
        old = F.col(f"a.{c}")
        there = F.when(F.trim(old) != "", old) if dict(target.dtypes)[c] == "string" else old
        if rule == "replace":
            return F.when(F.col("_new"), fresh).otherwise(old)
        if rule == "keep":
            return F.coalesce(there, some, old, fresh)
        if rule in ("max", "min"):
            return (F.greatest if rule == "max" else F.least)(old, fresh)
        return F.coalesce(some, old, fresh)

    return joined.select(*[(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keys else value(c)).alias(c) for c in names])


def upsert_table(path: str, updates: DataFrame, keys: list[str], order: list[str] | None = None, rules: dict[str, str] | None = None, buckets: int = 64) -> None:
    """Upsert into a table of files at a path, which is made if it is not there: only buckets of keys that updates touch are read and written anew.

    Rows are dealt into buckets by a hash of their keys, a folder each.  What a bucket becomes is written aside first, then takes the
    place of its files when the whole write is done; other buckets keep theirs.  The number of buckets is that of the first call.
    """
    spark = updates.sparkSession
    try:
        table = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = None
    if table is not None:
        buckets = table.select("_buckets").first()[0]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    if table is None:
        merged = upsert(updates.limit(0), updates, keys, order, rules)
    else:
        touched = [r[0] for r in updates.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return
        merged = upsert(table.where(F.col("_bucket").isin(touched)).drop("_bucket", "_buckets"), updates, keys, order, rules)
    merged = saved(merged.withColumns({"_buckets": F.lit(buckets), "_bucket": bucket}), "merged")
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that upsert_table keeps; columns that came later are null in older rows."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("_bucket", "_buckets")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of new whose key it lacks; of several new rows of a key one is taken, the smallest."""
    first = W.Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    fresh = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def write_bridge(conversations: DataFrame, path: str) -> None:
    """Conversations (exported_at, agent, conversation, metadata) as JSON lines, a folder for each agent."""
    conversations.write.mode("append").partitionBy("agent").json(path)
