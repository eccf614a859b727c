"""The k best rows for each query by sums of products over what both share, block by block: pairs never leave a task, only the k best of each block do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.sources.scratch import saved

#: Weights of queries in a block, rows of memories in a block, cells of a matrix in a task, and sets of terms in a block.
WEIGHTS, ROWS, CELLS, SETS = 500_000, 100_000, 4 << 20, 50_000


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both columns as whole numbers, equal values alike; nulls are -1."""
    both = pa.chunked_array([*left.chunks, *right.cast(left.type).chunks], left.type).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[: len(left)], codes[len(left) :]


def _firsts(group: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group, where groups stand together."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) < k


class _Held:
    """The k best (score, place) of each of n queries; ties go to the smaller place."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.found, self.size = n, k, [], 0
        self.floor = np.full(n, -np.inf)

    def add(self, q: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        self.found.append((q, place, score))
        self.size += len(q)
        if self.size > max(1 << 16, 4 * self.n * self.k):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, place, score = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((place, -score, q))
        order = order[_firsts(q[order], self.k)]
        q, place, score = q[order], place[order], score[order]
        counts = np.bincount(q, minlength=self.n)
        full = np.flatnonzero(counts == self.k)
        self.floor[full] = score[np.cumsum(counts)[full] - 1]
        self.found, self.size = [(q, place, score)], len(q)
        return q, place, score


def landing(active: DataFrame, mentions: DataFrame, memories: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """qid, id, score of the memories on which the activation of each query lands best: the k best of each query and block of memories, and so among them the k best of all.

    active: qid, tag, activation; mentions: memory_id, tag, relevance; memories: id, session_id, space_id; queries: qid, session_id, space_id.  A memory scores the sum of activation times relevance,
    1.2 of it in the query's session and 1.35 in its space, rounded to nine digits.  Memories of the same mentions, space and session score the
    same for every query, so the k smallest ids of each such class stand for it; sessions count only if a query has them.  Then blocks of
    about WEIGHTS activations meet blocks of about ROWS memories in tasks that multiply matrices of at most CELLS cells.
    """
    asked = queries.select(F.col("session_id").alias("_s")).where("_s is not null").distinct().withColumn("_asked", F.lit(True))
    worth = mentions.where("tag is not null and relevance is not null").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("tag", "relevance"))).alias("_m"))  # a memory's own tags
    own = worth.join(memories.select(F.col("id").alias("memory_id"), "session_id", "space_id"), "memory_id").join(asked, F.col("session_id") == F.col("_s"), "left")
    own = own.select(F.col("memory_id").alias("id"), "_m", F.col("_s").alias("session_id"), "space_id")
    alike = W.Window.partitionBy("_m", "session_id", "space_id").orderBy("id")
    own = saved(own.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k).select("id", F.col("_m.tag").alias("tags"), F.col("_m.relevance").cast("array<double>").alias("worth"), "session_id", "space_id"), "landed")
    lit = active.where("tag is not null and activation is not null").select("qid", "tag", F.col("activation").cast("double").alias("activation"))
    lit = saved(lit.join(queries.select("qid", F.col("session_id").alias("qs"), F.col("space_id").alias("qp")), "qid"), "lit")
    n_q, n_i = max(1, -(-lit.count() // WEIGHTS)), max(1, -(-own.count() // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = lit.withColumns({"_q": place("qid", n_q), "_i": every(n_i)})
    b = own.withColumns({"_q": every(n_q), "_i": place("id", n_i)})
    out = T.StructType([T.StructField("qid", lit.schema["qid"].dataType), T.StructField("id", own.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.sort_by("id")
        lists = right["tags"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.diff(lists.offsets.to_numpy())
        flat = pa.chunked_array([lists.flatten()])
        worth = right["worth"].combine_chunks()
        worth = (worth.chunk(0) if isinstance(worth, pa.ChunkedArray) else worth).flatten().to_numpy(zero_copy_only=False)
        tag_q, tag_i = _codes(left["tag"], flat)
        session_q, session_i = _codes(left["qs"], right["session_id"])
        space_q, space_i = _codes(left["qp"], right["space_id"])
        names = left["qid"].combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        row, known = names.indices.to_numpy(zero_copy_only=False), len(names.dictionary)
        first = np.zeros(known, int)
        first[row[::-1]] = np.arange(len(row))[::-1]
        session_q, space_q, act = session_q[first], space_q[first], left["activation"].to_numpy()
        own_space = np.where(np.isin(space_i, space_q) & (space_i >= 0), space_i, -1)
        kind = (own_space.astype(np.int64) + 1) * (session_i.max() + 2) + session_i + 1
        order = np.argsort(kind, kind="stable")  # memories of a kind have the same factor for a query
        starts = np.concatenate([[0], np.cumsum(size)])
        positive = bool((act > 0).all() and (worth > 0).all())  # then whatever shares no tag scores 0
        tags, at = np.unique(tag_q, return_inverse=True)
        by_query = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[by_query], np.arange(known + 1))
        found = []
        step = max(1, min(2048, CELLS // max(1, len(tags))))
        for low in range(0, known, step):
            high = min(known, low + step)
            some = by_query[cuts[low] : cuts[high]]
            weights, there = np.zeros((high - low, len(tags))), np.zeros((0, 0))
            np.add.at(weights, (row[some] - low, at[some]), act[some])
            if not positive:
                there = np.zeros((high - low, len(tags)))
                there[row[some] - low, at[some]] = 1.0
            held = _Held(high - low, k)
            wide = max(1, min(CELLS // (high - low), 2048 if len(tags) > 256 else ROWS))
            for begin, end in _kinds(kind[order], wide):
                mine = order[begin:end]
                cells = np.concatenate([np.arange(starts[m], starts[m + 1]) for m in mine]) if len(mine) < 64 else _spans(starts[mine], size[mine])
                owner = np.repeat(np.arange(len(mine)), size[mine])
                place = np.searchsorted(tags, tag_i[cells])
                place[place == len(tags)] = 0
                good = tags[place] == tag_i[cells]
                used, code = np.unique(place[good], return_inverse=True)
                if not len(used):
                    continue
                matrix = np.zeros((len(used), len(mine)))
                np.add.at(matrix, (code, owner[good]), worth[cells[good]])
                scores = weights[:, used] @ matrix
                if positive:
                    scores[scores <= 0] = -np.inf
                else:
                    matrix[:] = 0
                    matrix[code, owner[good]] = 1.0
                    scores[there[:, used] @ matrix == 0] = -np.inf
                s, p = session_i[mine[0]], own_space[mine[0]]
                boost = np.where((session_q[low:high] == s) & (s >= 0), 1.2, 1.0) * np.where((space_q[low:high] == p) & (p >= 0), 1.35, 1.0)
                bar = (held.floor - 6e-10) / boost
                if len(mine) > k and np.isinf(bar).any():
                    bar = np.maximum(bar, np.partition(scores, len(mine) - k, axis=1)[:, len(mine) - k] - 6e-10)
                q, m = np.nonzero(scores > bar[:, None])
                score = np.round(scores[q, m] * boost[q], 9)
                top = score >= held.floor[q]
                held.add(q[top], mine[m[top]], score[top])
            q, m, score = held.settle()
            found.append((q + low, m, score))
        q, m, score = (np.concatenate(c) for c in zip(*found, strict=True))
        columns = [names.dictionary.take(pa.array(q)), right["id"].combine_chunks().take(pa.array(m)), pa.array(score)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["qid", "id", "score"]).cast(arrow)

    return a.groupBy("_q", "_i").cogroup(b.groupBy("_q", "_i")).applyInArrow(meet, out)


def _spans(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans of these starts and sizes, one span behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - size), size)


def _kinds(kind: np.ndarray, wide: int) -> list[tuple[int, int]]:
    """Begin and end of runs of one kind, none longer than `wide`."""
    cuts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])).tolist()
    return [(n, min(n + wide, b)) for a, b in zip(cuts, [*cuts[1:], len(kind)], strict=True) for n in range(a, b, wide)]


def conjunctions(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: the k best documents that hold all terms of a query, by the sum of their parts, rounded to six digits; ties go to the smaller id.

    terms: qid, term; postings: term, id, part.  Queries of the same terms are asked once.  Blocks of postings by documents meet blocks of about SETS sets of terms in tasks that intersect sorted lists and return k
    documents of each set.
    """
    asked = saved(terms.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("set")), "asked")  # a query's own words
    sets, rows = saved(asked.select("set").distinct(), "sets"), saved(postings.select("term", "id", F.col("part").cast("double").alias("part")), "postings")
    n_q, n_i = max(1, -(-sets.count() // SETS)), max(1, -(-rows.count() // (10 * ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = sets.withColumns({"_q": place("set", n_q), "_i": every(n_i)})
    b = rows.withColumns({"_q": every(n_q), "_i": place("id", n_i)})
    out = T.StructType([sets.schema["set"], rows.schema["id"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.sort_by([("term", "ascending"), ("id", "ascending")])
        words = right["term"].combine_chunks().dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        code, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        order = pc.rank(right["id"], tiebreaker="dense").to_numpy().astype(np.int64)  # documents as numbers in the order of their ids
        first = np.zeros(int(order.max()) + 1, np.int64)
        first[order] = np.arange(len(order))
        part, cuts = right["part"].to_numpy(), np.searchsorted(code, np.arange(len(names) + 1))
        lists = {name: (order[cuts[n] : cuts[n + 1]], part[cuts[n] : cuts[n + 1]]) for n, name in enumerate(names)}
        found: list[list] = [[], [], []]
        for n, wanted in enumerate(left["set"].to_pylist()):
            own = sorted((lists[w] for w in wanted if w in lists), key=lambda x: len(x[0]))
            if len(own) < len(wanted):
                continue
            docs, score = own[0]
            for other, more in own[1:]:
                spot = np.searchsorted(other, docs)
                spot[spot == len(other)] = 0
                both = other[spot] == docs
                docs, score = docs[both], score[both] + more[spot[both]]
            score = np.round(score, 6)
            if len(docs) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                over = np.flatnonzero(score > least)
                ties = np.flatnonzero(score == least)[: k - len(over)]
                chosen = np.concatenate([over, ties])
                docs, score = docs[chosen], score[chosen]
            found[0].append(np.full(len(docs), n))
            found[1].append(first[docs])
            found[2].append(score)
        if not found[0]:
            return arrow.empty_table()
        which, at, score = (np.concatenate(c) for c in found)
        columns = [left["set"].combine_chunks().take(pa.array(which)), right["id"].combine_chunks().take(pa.array(at)), pa.array(score)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["set", "id", "score"]).cast(arrow)

    met = a.groupBy("_q", "_i").cogroup(b.groupBy("_q", "_i")).applyInArrow(meet, out)
    best = met.withColumn("rank", F.row_number().over(W.Window.partitionBy("set").orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= k)
    return asked.join(best, "set").select("qid", "id", "score", "rank")
