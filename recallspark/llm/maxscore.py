"""Exact top-k inner-product search by MaxScore over per-dimension postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.llm.blocks import blocked_search, rows_of, usable
from recallspark.llm._common import require, table

#: Rows of a shard, and queries that visit it together.
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: Rows at the head of each posting list that give the first threshold; postings that are probed between two prunings.
HEAD, PROBE = 32, 4
_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


class Shard:
    """The postings of one shard: for each term (dimension) the weights of all rows, its score bounds and its heads."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        self.terms = max(1, *(len(r) for r in rows))
        self.weights = np.zeros((self.terms, self.n), np.int64)
        for at, k in enumerate(order):
            self.weights[: len(rows[k]), at] = rows[k]
        self.low, self.high = self.weights.min(1), self.weights.max(1)
        head = min(HEAD, self.n)
        self.tops = [np.argpartition(w, self.n - head)[self.n - head :] for w in self.weights]
        self.bottoms = [np.argpartition(w, head - 1)[:head] for w in self.weights]
        self.largest = max(-int(self.low.min()), int(self.high.max()), 1)

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows; ties go to the smaller id.

        A term's bound is the most that it can add in this shard.  The terms with the largest bounds are essential:
        the rest together stay below the threshold, so a row needs something from them.  Their postings are
        traversed for all rows; the other terms are probed only for rows that can still reach the threshold.
        """
        q = np.zeros(self.terms, np.int64)
        q[: min(len(query), self.terms)] = query[: self.terms]
        reach = float(np.abs(q.astype(np.float64)).sum()) * self.largest
        if reach >= 2**62:
            return self.search_wide(own_id, q, k)
        exact = reach < 2**52
        weights = self.floats() if exact else self.weights
        q = q.astype(weights.dtype)
        bound = np.maximum(q * self.low, q * self.high)
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what the terms from here on can add
        mine = self.ids == own_id
        probes = np.unique(np.concatenate([(self.tops if q[t] > 0 else self.bottoms)[t] for t in terms[:4]]))
        probes = probes[~mine[probes]]
        threshold = -np.inf
        if len(probes) >= k:
            threshold = np.partition(q @ weights[:, probes], len(probes) - k)[len(probes) - k]
        essential = int(np.searchsorted(-rest, -threshold, "right")) if threshold > -np.inf else len(terms)
        score = np.zeros(self.n, weights.dtype)
        for t in terms[:essential]:
            if q[t]:
                score += q[t] * weights[t]
        rows = np.flatnonzero((score + rest[min(essential, len(terms))] >= threshold) & ~mine)
        at, part = min(essential, len(terms)), score[rows]
        while at < len(terms):
            for t in terms[at : at + PROBE]:
                part += q[t] * weights[t, rows]
            at = min(at + PROBE, len(terms))
            if len(rows) > k:
                low = np.minimum(q * self.low, q * self.high)[terms[at:]].sum()  # the least that the rest adds
                threshold = max(threshold, np.partition(part, len(part) - k)[len(part) - k] + low)
                alive = part + rest[at] >= threshold
                rows, part = rows[alive], part[alive]
        order = np.lexsort((self.ids[rows], -part))[:k]
        return rows[order], part[order].astype(np.int64)

    def search_wide(self, own_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As `search` where a sum may leave 64 bits: integers of any size over all postings; a score beyond a long is given as the end of its range."""
        rows = np.flatnonzero(self.ids != own_id)
        sums = np.zeros(len(rows), object)
        for t in np.flatnonzero(q):
            sums += self.weights[t, rows].astype(object) * int(q[t])
        score = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)
        order = np.lexsort((self.ids[rows], ~score))[:k]
        return rows[order], score[order]

    def floats(self) -> np.ndarray:
        """The same integers as doubles, where all sums are exact in these."""
        if not hasattr(self, "_floats"):
            self._floats = self.weights.astype(np.float64)
        return self._floats


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "vector", query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k items of the highest inner product with each query, exactly; vectors are arrays of integers.

    Returns query_id, rank (from 1), vec_id, score; a query is not compared with items of its own id, equal scores go by
    the smaller id, and there are fewer rows where there are fewer items.  A missing component counts as 0, so a
    vector without components scores 0; rows that are null or hold nulls take no part; a query id that comes twice is asked once; repeated items each count.
    Components are longs (`quantised` gives the end of that range for what is beyond it); sums are exact, and a score beyond a long is given as the end of its range, so such
    scores are ties.
    Items are dealt into shards by a hash of the id; in a shard, rows of like lengths share posting lists, so one long vector costs
    its own length only.  Each shard returns k rows for each query, and the shards are merged.  Other columns are left out.
    """
    require(queries, id_col, vec_col)
    require(items, id_col, vec_col)
    own = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<bigint>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    arrow = to_arrow_schema(_SCHEMA)

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, own_rows = right["id"].to_numpy(), rows_of(right["v"])
            bands = np.array([len(r).bit_length() for r in own_rows])  # rows of like lengths share postings, so few are padded
            for band in np.unique(bands):
                at = np.flatnonzero(bands == band)
                shard = Shard(ids[at], [own_rows[a] for a in at])
                for query, vec in zip(left["id"].to_pylist(), rows_of(left["v"]), strict=True):
                    rows, score = shard.search(query, vec, k)
                    out.append((np.full(len(rows), query), shard.ids[rows], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    best = blocked_search(own(queries).dropDuplicates(["id"]), own(items), local, _SCHEMA, k, [F.desc("score"), F.asc("vec_id")], query_rows, shard_rows)
    return best.select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and vector: floor(scale * x) of each component x as a double; unusable vectors are left out."""
    ok = df.select("vec_id", F.col(vec_col).cast("array<double>").alias("_v")).where(usable("_v"))
    return ok.select("vec_id", F.transform("_v", lambda x: F.floor(x * float(scale)).cast("long")).alias("vector"))


def op7_maxscore(spark, sf_dir: str) -> DataFrame:
    items = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(items.where(F.col("vec_id") % 50 == 0), items, k=5)


QUERIES = {"op7_maxscore": op7_maxscore}
ORACLES = {
    "op7_maxscore": """
        WITH items AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
        pairs AS (
            SELECT q.vec_id AS query_id, i.vec_id AS vec_id, CAST(list_dot_product(q.v, i.v) AS BIGINT) AS score
            FROM items q JOIN items i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        WHERE rank <= 5"""
}
