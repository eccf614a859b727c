"""For each vector the most similar others above a similarity: exactly, or among those that share a bucket of random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.operators.retrieval import SCORES, _kept, _matrices, _near, _top, _vectors, similar_topk
from recallspark.sources.scratch import saved

#: Vectors that share a bucket by chance, rows of a bucket that are compared as one block, rows of a task, and tables at most.
STRANGERS, BLOCK, BUNDLE, TABLES = 4096, 16_384, 32_768, 200


def fitted(rows: int, least: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket and tables: a pair at the threshold agrees in a bit with 1 - angle / pi, and is found in one of the tables with the probability `recall`."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    bits = max(1, math.ceil(math.log2(max(2, rows / STRANGERS))))
    while bits > 1 and math.log(1 - recall) / math.log(1 - agree**bits) > TABLES:
        bits -= 1
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - min(agree**bits, 1 - 1e-12)))))


def bucketed_topk(items: DataFrame, least: float, k: int = 10, recall: float = 0.995, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """qid, id, score, rank: for each unit vector (id, vec) the k most similar others above `least` that share a bucket with it in one of some tables.

    A bucket is the signs of random projections; their number follows from the rows, the number of tables from the threshold and `recall`.  Whatever shares a bucket is compared exactly: a
    bucket of any size is cut into blocks, all of which meet, and each block returns its k best of each vector, which are merged.
    """
    own = saved(_vectors(items, "id"), "vectors")
    bits, tables = fitted(own.count(), least, recall)
    bits = min(bits, 60)
    entry = T.StructType([T.StructField("bucket", T.LongType()), own.schema["key"], own.schema["vec"]])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(at, 2048)])
                for dim, (rows, x) in _matrices(part).items():
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                    signs = (x @ planes[dim] >= 0).reshape(len(rows), tables, bits)
                    code = (signs * weights).sum(2) * tables + np.arange(tables)
                    for t in range(tables):
                        took = part.take(pa.array(rows))
                        yield from pa.table({"bucket": pa.array(code[:, t] * 31 + dim), "key": took["key"], "vec": took["vec"]}).to_batches()

    each = own.mapInArrow(dealt, entry)  # made twice, as its vectors are many times the input
    sizes = saved(own.select("key", "vec").mapInArrow(dealt, entry).groupBy("bucket").agg(F.count("*").alias("n")), "sizes")
    parts = F.ceil(F.col("n") / block).cast("int")
    hot = F.broadcast(sizes.where(F.col("n") > block).select("bucket", parts.alias("_parts")))  # buckets of over `block` rows: few by their size
    wide = each.join(hot, "bucket", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    wide = wide.withColumn("_s", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
    one = F.transform(F.sequence(F.col("_s"), F.col("_parts") - 1), lambda j: F.struct(F.col("_s").alias("i"), j.alias("j")))
    two = F.filter(F.transform(F.sequence(F.lit(0), F.col("_s")), lambda i: F.struct(i.alias("i"), F.col("_s").alias("j"))), lambda x: x["i"] < F.col("_s"))
    rows = wide.select("bucket", "key", "vec", F.inline(F.concat(one, two)), F.col("_s"))
    total = sizes.agg(F.coalesce(F.sum(F.col("n") * parts), F.lit(0))).first()[0]
    bundles = max(1, -(-total // BUNDLE))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(bundles)).cast("int"))
    kind = own.schema["key"].dataType
    out = T.StructType([T.StructField("qid", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def met(part: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        part = part.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
        group = np.stack([part[c].to_numpy() for c in ("bucket", "i", "j")], axis=1)
        starts = np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))), len(group))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            own = part.slice(a, b - a)
            side = own["_s"].to_numpy()
            for rows, x in _matrices(own, False).values():
                keys = own["key"].combine_chunks().take(pa.array(rows))
                apart = own["i"][0].as_py() != own["j"][0].as_py()
                best: list[tuple[np.ndarray, ...]] = []
                for i, j, score in _near(x, x, least):
                    good = i != j
                    if apart:
                        good &= side[rows[i]] != side[rows[j]]  # the same side meets in a block of its own
                    best.append((i[good], j[good], score[good]))
                    if sum(len(f[0]) for f in best[1:]) > SCORES:
                        best = [_kept(best, k)]
                if best:
                    i, j, score = _kept(best, k)
                    found.append(pa.table({"qid": keys.take(pa.array(i)), "id": keys.take(pa.array(j)), "score": score}))
        return pa.concat_tables(found).cast(arrow) if found else arrow.empty_table()

    near = rows.groupBy("bundle").applyInArrow(met, out).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return _top(near, ["qid"], [F.desc("score"), F.asc("id")], k)


def top_similar(items: DataFrame, least: float, k: int = 10, approximate: bool = False) -> DataFrame:
    """qid, id, score, rank: for each vector (id, vec) the k most similar other ones, by the dot product, above `least`; ties go to the smaller id.

    Equal vectors are one class, so copies are compared once: a class finds its k nearest classes (exactly by blocks, or among those that share
    a bucket), and of each the smallest ids stand for it; a member's list is that of its class without itself.
    """
    own = _vectors(items, "id")
    first = saved(own.groupBy("vec").agg(F.min("key").alias("id"), F.count("*").alias("n")), "classes")
    members = saved(own.join(first.select("vec", F.col("id").alias("class_id")), "vec").select(F.col("key").alias("id"), "class_id"), "members")
    classes = first.select("id", "vec")
    if approximate:
        near = bucketed_topk(classes, least, k)
    else:
        near = similar_topk(classes, k, least)
    self = F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x), 9)
    copies = first.where("n > 1").select(F.col("id").alias("qid"), "id", self.alias("score")).where(F.col("score") > least)
    near = saved(near.select("qid", "id", "score").unionByName(copies).repartition("qid"), "near")
    heads = _top(members, ["class_id"], [F.asc("id")], k + 1).select(F.col("class_id").alias("_c"), F.col("id").alias("other"))
    wanted = near.select(F.col("id").alias("_c")).distinct()
    best = _top(near.withColumnRenamed("id", "_c").join(heads.join(wanted, "_c", "left_semi"), "_c"), ["qid"], [F.desc("score"), F.asc("other")], k + 1)
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("_l")).withColumnRenamed("qid", "class_id")  # k + 1 rows at most
    mine = members.join(lists, "class_id").select(F.col("id").alias("qid"), F.slice(F.filter("_l", lambda x: x["other"] != F.col("id")), 1, k).alias("_l"))
    return mine.select("qid", F.posexplode("_l").alias("_p", "_x")).select("qid", F.col("_x.other").alias("id"), F.col("_x.score").alias("score"), (F.col("_p") + 1).alias("rank"))


def duplicates(memories: DataFrame, least: float = 0.92, k: int = 10, approximate: bool = False) -> DataFrame:
    """For each live memory (id, vec, is_superseded) those of its k most similar ones that say the same."""
    return top_similar(memories.where(~F.col("is_superseded")).select("id", "vec"), least, k, approximate)


def conflict_pairs(memories: DataFrame, least: float = 0.75, k: int = 10, approximate: bool = False) -> DataFrame:
    """a < b, score: pairs of live memories of which one is among the k most similar ones of the other, each pair once."""
    found = duplicates(memories, least, k, approximate)
    return found.select(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
