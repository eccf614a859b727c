"""Greedy choice in time order: a row is kept if the last kept row of its key is further away than a window.

Which rows are kept is a chain from the first row of a key: behind each kept row comes the first row beyond its window.  Rows are dealt by ranges of key and
time, so a key of any size spreads.  Each range follows the chain inside it from every row at which it may be entered; where a
chain goes on in another range is one step from border to border, and all borders that are reached are found by doubling these steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.sources.scratch import saved


def _runs(keys: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    codes = keys.combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    return list(zip(cuts.tolist(), np.append(cuts[1:], len(codes)).tolist(), strict=True))


def _sorted(part: pa.Table) -> pa.Table:
    return part.sort_by([("_key", "ascending"), ("_t", "ascending"), ("_id", "ascending")])


def _walk(times: np.ndarray, at: int, window: int) -> list[int]:
    """Places of the rows that are kept from the one at `at` on."""
    out = []
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + window, "right"))
    return out


def kept(rows: DataFrame, window: int) -> DataFrame:
    """The _id of the rows that are kept, of rows (_key, _t, _id) without nulls, in the order of _t, then _id; `window` in the unit of _t."""
    ranged = rows.select("_key", "_t", "_id").repartitionByRange("_key", "_t", "_id")
    own = saved(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    bounds = own.groupBy("_key", "_range").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    order = W.Window.partitionBy("_key").orderBy("_range")
    bounds = bounds.withColumns({"_before": F.lag("_to").over(order), "_n": F.count("*").over(W.Window.partitionBy("_key"))}).where("_n > 1")
    bounds = saved(bounds, "bounds")  # a row for each range at most, but for one each at its ends: keys that reach over a border
    key, kind = rows.schema["_key"], rows.schema["_id"]
    entry = T.StructType([key, T.StructField("_range", T.IntegerType()), T.StructField("_place", T.LongType())])
    if bounds.head(1):
        entries = _entries(own, bounds, entry, window)
    else:
        entries = rows.sparkSession.createDataFrame([], entry)
    out = T.StructType([kind])
    arrow = to_arrow_schema(out)
    # Of a key that reaches over a border a range that has no entry keeps nothing.
    entries = bounds.select("_key", "_range").join(entries, ["_key", "_range"], "left")

    def follow(part: pa.Table, known: pa.Table) -> pa.Table:
        part = _sorted(part)
        times = part["_t"].to_numpy()
        starts = dict(zip(known["_key"].to_pylist(), known["_place"].to_pylist(), strict=True))
        found: list[int] = []
        for a, b in _runs(part["_key"]):
            start = starts.get(part["_key"][a].as_py(), 0)
            if start is not None:
                found += [a + k for k in _walk(times[a:b], start, window)]
        return pa.Table.from_arrays([part["_id"].take(pa.array(found, pa.int64())).cast(arrow.field(0).type)], schema=arrow)

    return own.groupBy("_range").cogroup(entries.groupBy("_range")).applyInArrow(follow, out)


def _entries(own: DataFrame, bounds: DataFrame, entry: T.StructType, window: int) -> DataFrame:
    """For each range and key that reaches over a border: the place at which the chain enters the range, if it does."""
    wide = F.broadcast(bounds.drop("_n"))  # about two rows for each range
    step = T.StructType([*entry.fields, T.StructField("_last", T.LongType())])
    arrow = to_arrow_schema(step)

    def local(part: pa.Table, known: pa.Table) -> pa.Table:
        """Rows at which a range may be entered, and the last row that its chain then keeps there.

        What comes from ranges before reaches at most `window` beyond their last row, so a range is entered there, or at the first row behind.
        """
        if not part.num_rows or not known.num_rows:
            return arrow.empty_table()
        part = _sorted(part)
        times, number = part["_t"].to_numpy(), part["_range"][0].as_py()
        before = dict(zip(known["_key"].to_pylist(), known["_before"].to_pylist(), strict=True))
        columns: list[list] = [[], [], [], []]
        for a, b in _runs(part["_key"]):
            name = part["_key"][a].as_py()
            if name not in before:
                continue
            own = times[a:b]
            some = 1 if before[name] is None else min(b - a, int(np.searchsorted(own, before[name] + window, "right")) + 1)
            after = np.searchsorted(own, own + window, "right")
            last = np.arange(b - a)
            for k in range(b - a - 1, -1, -1):
                if after[k] < b - a:
                    last[k] = last[after[k]]
            columns[0] += [name] * some
            columns[1] += [number] * some
            columns[2] += range(some)
            columns[3] += own[last[:some]].tolist()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    borders = own.join(F.broadcast(bounds.select("_key", "_range")), ["_key", "_range"], "left_semi")
    places = saved(borders.groupBy("_range").cogroup(wide.groupBy("_range")).applyInArrow(local, step), "places")
    # The next range of a chain is the first whose last row lies beyond the window.
    ends = F.broadcast(bounds.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_range", "_to"))).alias("_ends")))
    asks = places.join(ends, "_key").withColumn("_next", F.try_element_at(F.filter("_ends", lambda e: (e["_range"] > F.col("_range")) & (e["_to"] > F.col("_last") + window)), F.lit(1))["_range"])
    asks = asks.where("_next is not null").select("_key", "_range", "_place", (F.col("_last") + window).alias("_until"), "_next")
    link = T.StructType([*entry.fields, T.StructField("_range2", T.IntegerType()), T.StructField("_place2", T.LongType())])
    linked = to_arrow_schema(link)

    def enter(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not part.num_rows or not asked.num_rows:
            return linked.empty_table()
        part, asked = _sorted(part), asked.sort_by("_key")
        times, runs = part["_t"].to_numpy(), {part["_key"][a].as_py(): (a, b) for a, b in _runs(part["_key"])}
        place = np.zeros(asked.num_rows, np.int64)
        for a, b in _runs(asked["_key"]):
            low, high = runs[asked["_key"][a].as_py()]
            place[a:b] = np.searchsorted(times[low:high], asked["_until"].to_numpy()[a:b], "right")
        return pa.Table.from_arrays([asked["_key"].combine_chunks(), asked["_range"].combine_chunks(), asked["_place"].combine_chunks(), asked["_next"].combine_chunks(), pa.array(place)], schema=linked)

    links = borders.groupBy("_range").cogroup(asks.groupBy("_next")).applyInArrow(enter, link)
    node = lambda r, p: F.struct(F.col(r).alias("r"), F.col(p).alias("p"))
    jumps = [saved(links.select("_key", node("_range", "_place").alias("a"), node("_range2", "_place2").alias("b")), "jumps")]
    most = bounds.agg(F.max("_n")).first()[0]
    while 2 ** len(jumps) < most:
        half = jumps[-1]
        jumps.append(saved(half.join(half.select("_key", F.col("a").alias("b"), F.col("b").alias("c")), ["_key", "b"]).select("_key", "a", F.col("c").alias("b")), "jumps"))
    first = bounds.where("_before is null").select("_key", F.struct("_range", F.lit(0).cast("long").alias("p")).cast("struct<r:int,p:bigint>").alias("a"))
    reached = first
    for jump in reversed(jumps):
        reached = saved(reached.unionByName(reached.join(jump, ["_key", "a"]).select("_key", F.col("b").alias("a"))), "reached")
    return reached.select("_key", F.col("a.r").alias("_range"), F.col("a.p").alias("_place")).distinct()
