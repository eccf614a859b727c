"""Searches of a query set against all rows, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


#: Components of a row up to which only rows count for the size of a block.
WIDE = 1024


def usable(vec: str) -> F.Column:
    """A vector that is there, and holds no null and nothing infinite or undefined; one without components is usable."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x > float("-inf")))
    return F.col(vec).isNotNull() & F.coalesce(good, F.lit(False))


def blocked_search(
    queries: DataFrame,
    items: DataFrame,
    local: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    k: int,
    order: list[F.Column],
    query_rows: int,
    item_rows: int,
) -> DataFrame:
    """The k best items of each query.

    Both sides have a column id and a vector v; rows are dealt by a hash of the id into blocks of about query_rows and item_rows rows, and
    of no more than WIDE components a row on average, so that repeated and long vectors spread.  Each block of queries meets each block of items in a task of bounded size, which
    returns only its k best of each query (`local`, with the columns query_id and vec_id); these are merged by `order`.
    """
    blocks = []
    for side, rows in ((queries, query_rows), (items, item_rows)):
        n, components = side.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
        blocks.append(max(1, -(-n // rows), -(-components // (rows * WIDE))))
    own = lambda side, n: side.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own(queries, blocks[0]).select(F.col("_own").alias("_q"), every(blocks[1]).alias("_i"), *queries.columns)
    right = own(items, blocks[1]).select(every(blocks[0]).alias("_q"), F.col("_own").alias("_i"), *items.columns)
    tasks = min(2 * blocks[0] * blocks[1], 100_000)
    left, right = (x.repartition(tasks, "_q", "_i") for x in (left, right))
    found = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(local, schema)
    best = W.Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rows_of(lists: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """A list column as one array for each row."""
    out = []
    for chunk in lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out
