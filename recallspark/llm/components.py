"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.llm._common import saved

#: At most so many hubs are dealt apart; rows of a key up to LEAST stay together.
HUBS, LEAST = 1000, 64


def dealt_join(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """left join right on key, where right has a row for each key and left, of `rows` rows, may have very many for some.

    Keys with more than rows / HUBS rows, fewer than HUBS in all, are hubs: their rows are dealt into parts by a hash, and
    their row of right is repeated for each part.  So no task gets much more than that share.
    """
    limit = max(LEAST, rows // HUBS)
    hubs = F.broadcast(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    b = right.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [key, "_part"], how).drop("_part")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node that can be reached) of every node of a link.

    Each step hangs neighbours under smaller nodes, so the table of links never grows, and the number of steps grows with the
    logarithm of the longest path; it ends when all links form stars.  Minima are pre-aggregated, and the links of hubs are
    dealt into parts, so that no task holds a hub.  Every step is written to the shared folder, so a lost executor costs one
    step at most.  Links of a node with itself and nulls are dropped; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    n = None
    while True:
        edges = saved(edges, "links")
        n = n or edges.count()
        # Large star: a link to v becomes one to the smallest neighbour of v, if v has a smaller one.
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = dealt_join(edges, least, "v", n, "left").groupBy("u", F.coalesce("m", "v").alias("v")).agg(F.max(F.col("m").isNotNull()).alias("moved"))
        large = saved(large, "links")
        # Small star: of the links of u to smaller nodes one stays, to the smallest, and the others hang under that.
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("moved"), F.count("*").alias("n")), "least")
        heads, moved, n = least.agg(F.count("*"), F.max("moved"), F.sum("n")).first()
        if not moved and heads == (n or 0):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        small = dealt_join(large.select("u", "v"), least.select("u", "m"), "u", n)
        edges = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v"), F.col("m"))).distinct()
