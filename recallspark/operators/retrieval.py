"""Batch recall: vector top-k, BM25, spreading activation, fusion and governed re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from recallspark.operators import products
from recallspark.sources.scratch import saved

# How much of an activation each kind of relation carries.
RELATION_FACTORS = {"CO_OCCUR": 1.0, "DERIVED": 0.8, "CAUSAL": 2.0, "TEMPORAL": 1.2, "CONTRADICT": -1.0, "REFINES": 0.6, "SUPERSEDES": 0.0}
SIGNAL_FACTORS = {0: 0.7, 1: 1.0, 2: 1.5}


def _top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def usable(vec: str | Column) -> Column:
    """A vector that has components, none of them null, infinite or undefined."""
    v = F.col(vec) if isinstance(vec, str) else vec
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & good, F.lit(False))


def _vectors(df: DataFrame, key: str) -> DataFrame:
    kind = "array<float>" if dict(df.dtypes)["vec"] == "array<float>" else "array<double>"  # floats travel as they are; all products are of doubles
    own = df.select(F.col(key).alias("key"), F.col("vec").cast(kind).alias("vec"), *[c for c in df.columns if c == "_g"])
    return own.where(F.col("key").isNotNull() & usable("vec"))


#: Blocks of small inputs and the rows of one, and those of pairs without k, whose tasks take longest.
FEW, PAIRED = (4, 8192), (8, 2048)


def _blocked(df: DataFrame, rows: int | None, few: tuple[int, int] = FEW) -> tuple[DataFrame, int]:
    """df with _b, the block of its key, and the number of blocks (of each _g, if there is one) of about so many rows, or by default of CELLS components, but for some blocks (`few` of so many rows) of small inputs."""
    df = df if "_g" in df.columns else df.withColumn("_g", F.lit(0))
    n, most = df.groupBy("_g").agg(F.count("*").alias("n"), F.sum(F.size("vec")).alias("c")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    n = max(1, -(-n // rows)) if rows else max(1, -(-most // CELLS), min(few[0], -(-n // few[1])))
    return df.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")), n


def _matrices(part: pa.Table, double: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension: the rows of a block that have it, in the order of their keys, and their vectors as a matrix, of doubles or as they are."""
    order = pc.sort_indices(part["key"])
    column = part["vec"].combine_chunks().take(order)
    lists = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes, rows = np.diff(offsets), order.to_numpy()
    kind, dims = np.float64 if double else values.dtype, np.unique(sizes)
    if len(dims) == 1:  # as they lie, without a place for each component
        return {int(dims[0]): (rows, values[offsets[0] : offsets[-1]].reshape(len(rows), int(dims[0])).astype(kind, copy=False))}
    return {int(d): (rows[sizes == d], values[np.add.outer(offsets[:-1][sizes == d], np.arange(d))].astype(kind, copy=False)) for d in dims}


def _gathered(left: pa.Table, right: pa.Table, names: tuple[str, str], found: list[tuple[np.ndarray, ...]]) -> pa.Table:
    a, b, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({names[0]: left["key"].take(pa.array(a)), names[1]: right["key"].take(pa.array(b)), "score": pa.array(score)})


def _kept(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each first row; ties go to the second row that comes first, and rows of a block are in the order of their keys."""
    a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, -score, a))
    order = order[np.arange(len(order)) - np.searchsorted(a[order], a[order]) < k]
    return a[order], b[order], score[order]


def _pair_schema(names: tuple[str, str], left: DataFrame, right: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(names[0], left.schema["key"].dataType), T.StructField(names[1], right.schema["key"].dataType), T.StructField("score", T.DoubleType())])


#: Components of the vectors of a block, pairs that a task holds back before it keeps the best of them, and rows and columns of a tile of scores, which stays in the processor's cache.
CELLS, SCORES, TILE = 16 << 20, 4 << 20, (512, 2048)


def _near(x: np.ndarray, y: np.ndarray, least: float | None, k: int | None = None, spare: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x and of y and their scores above `least`, part by part; with k, at least the k + spare best of each row of x that are.

    Tiles of products of floats, where that is enough, tell what is surely below `least`, or below the best of the first tile; the rest is scored by products of doubles.
    """
    size = max(np.abs(x).max(initial=0.0), 1e-30) * max(np.abs(y).max(initial=0.0), 1e-30) * x.shape[1]
    light = 1e-20 < size < 1e20
    slack = 1e-9 + (2.5e-7 * (x.shape[1] + 2) * size if light else 0.0)
    kind, (high, wide) = np.float32 if light else np.float64, TILE
    least = -np.inf if least is None else least
    right = [np.ascontiguousarray(y[at : at + wide].T, dtype=kind) for at in range(0, len(y), wide)]
    for n in range(0, len(x), high):
        part = x[n : n + high].astype(kind, copy=False)
        bar = np.full((len(part), 1), least - slack)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for t, tile in enumerate(right):
            scores = part @ tile
            if not t and k is not None and len(tile[0]) > k + spare:
                bar = np.maximum(bar, np.partition(scores, len(tile[0]) - k - spare, axis=1)[:, len(tile[0]) - k - spare, None] - 2 * slack)
            if k is None and not scores.max(initial=-np.inf) > bar[0, 0]:
                continue
            i, j = np.divmod(np.flatnonzero((scores > bar).ravel()), len(tile[0]))
            found.append((n + i, t * wide + j))
            if sum(len(i) for i, _ in found) > SCORES // 4 or t == len(right) - 1:
                i, j = (np.concatenate(c) for c in zip(*found, strict=True))
                score, found = _exact(x, y, i, j), []
                yield i[score > least], j[score > least], score[score > least]
        if found:
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            score = _exact(x, y, i, j)
            yield i[score > least], j[score > least], score[score > least]


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", x[i[n : n + 2048]].astype(np.float64), y[j[n : n + 2048]].astype(np.float64)) for n in range(0, len(i), 2048)]
    return np.round(np.concatenate(parts), 9) if parts else np.zeros(0)


#: Bytes of a query matrix up to which it is broadcast, and rows that a task then holds back before it keeps the best of them.
BROADCAST, HELD = 16 << 20, 1 << 20


def _best(rows: pa.Table, k: int | None) -> pa.Table:
    """The k best rows of each query (its place _q, key, score); ties go to the smaller key."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_q", "ascending"), ("score", "descending"), ("key", "ascending")]))
    at = rows["_q"].to_numpy()
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return rows if k is None else rows.filter(pa.array(place < k))


def _topk_by_broadcast(queries: DataFrame, items: DataFrame, k: int | None, least: float | None) -> DataFrame:
    """qid, id, score: the query matrix goes to every task, which reads its items batch by batch and returns its own k best of each query; items are not shuffled."""
    asked = queries.toArrow()
    sent = items.sparkSession.sparkContext.broadcast((asked["key"].combine_chunks(), _matrices(asked), pd.factorize(asked["key"].to_numpy())[0]))
    same = queries.schema["key"].dataType == items.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrices, codes = sent.value
        held: list[pa.Table] = []
        out = lambda t: pa.table({"qid": names.take(t["_q"]), "id": t["key"], "score": t["score"]}).to_batches()
        for batch in batches:
            part = pa.Table.from_batches([batch])
            keys = part["key"].combine_chunks()
            own = pc.fill_null(pc.index_in(keys, value_set=names), -1).to_numpy(zero_copy_only=False) if same else np.full(len(keys), -1)
            own = np.where(own >= 0, np.append(codes, -1)[own], -1)
            for dim, (at, y) in _matrices(part).items():
                if dim not in matrices:
                    continue
                rows, x = matrices[dim]
                for n in range(0, len(rows), 256):
                    scores = np.round(x[n : n + 256] @ y.T, 9)
                    scores[codes[rows[n : n + 256], None] == own[None, at]] = -np.inf
                    good = scores > (-np.inf if least is None else least)
                    if k is not None and scores.shape[1] > k:
                        good &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
                    i, j = np.nonzero(good)
                    held.append(pa.table({"_q": rows[n + i], "key": keys.take(pa.array(at[j])), "score": scores[i, j]}))
            if k is None or sum(t.num_rows for t in held) > HELD:
                held = [_best(pa.concat_tables(held), k)] if held else []
                if k is None:
                    yield from (b for t in held for b in out(t))
                    held = []
        if held:
            yield from out(_best(pa.concat_tables(held), k))

    return items.mapInArrow(run, _pair_schema(("qid", "id"), queries, items))


def vector_topk(queries: DataFrame, items: DataFrame, k: int | None = 20, least: float | None = None, query_rows: int | None = None, item_rows: int | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """qid, id, score, rank: the k items of the largest dot product with each query, among all items but its own id; without k, all above `least`.

    queries: qid, vec; items: id, vec.  Queries whose vectors (and, with k, k rows for each) stay under `broadcast` bytes by count are sent to the tasks that read the items, which
    multiply matrices and return k rows for each query, so items are not shuffled.  Beyond that, blocks of about query_rows
    queries meet blocks of about item_rows items (by default of CELLS components) in tasks of bounded size.  Vectors that are null, empty
    or hold anything null or not finite take no part, and vectors of different lengths do not meet; ties go to the smaller id.
    """
    own = _vectors(queries, "qid")
    n, components = own.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    if 8 * components + 32 * n * (k or 1) <= broadcast:
        found = _topk_by_broadcast(own, _vectors(items, "id"), k, least)
    else:
        found = _topk_by_blocks(own, _vectors(items, "id"), k, least, query_rows, item_rows)
    return found.withColumn("rank", F.lit(None).cast("int")) if k is None else _top(found, ["qid"], [F.desc("score"), F.asc("id")], k)


def group_topk(queries: DataFrame, items: DataFrame, k: int | None = 20, least: float | None = None, query_rows: int | None = None, item_rows: int | None = None) -> DataFrame:
    """As vector_topk, but a query (qid, vec, group) only meets items (id, vec, group) of its groups; it has a row for each of them, and an item one for each of its own.

    Blocks meet within groups, so the pairs are never written out.
    """
    asked, known = _vectors(queries.withColumn("_g", F.col("group")), "qid"), _vectors(items.withColumn("_g", F.col("group")), "id")
    shared = saved(asked.select("_g").distinct().join(known.select("_g").distinct(), "_g"), "groups")
    asked, known = (df.join(shared, "_g", "left_semi") for df in (asked, known))
    found = _topk_by_blocks(asked, known, k, least, query_rows, item_rows).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.lit(None).cast("int")) if k is None else _top(found, ["qid"], [F.desc("score"), F.asc("id")], k)


def _topk_by_blocks(asked: DataFrame, known: DataFrame, k: int | None, least: float | None, query_rows: int | None, item_rows: int | None) -> DataFrame:
    (q, n_q), (i, n_i) = _blocked(asked, query_rows), _blocked(known, item_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a, b = q.select("key", "vec", "_g", F.col("_b").alias("_q"), every(n_i).alias("_i")), i.select("key", "vec", "_g", every(n_q).alias("_q"), F.col("_b").alias("_i"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            codes = pd.factorize(np.concatenate([left["key"].to_numpy(), right["key"].to_numpy()]))[0]
            asked, known = _matrices(left, False), _matrices(right, False)
            for dim in asked.keys() & known.keys():
                (rows, x), (own, y) = asked[dim], known[dim]
                mine, theirs = codes[rows], codes[left.num_rows + own]
                spare = int(np.bincount(theirs).max())  # rows of one id, which may be the query's own
                best: list[tuple[np.ndarray, ...]] = []
                for r, c, score in _near(x, y, least, k, spare):
                    other = mine[r] != theirs[c]
                    best.append((r[other], c[other], score[other]))
                    if k is not None and sum(len(f[0]) for f in best[1:]) > SCORES:
                        best = [_kept(best, k)]
                best = [_kept(best, k)] if best and k is not None else best
                found += [(rows[r], own[c], score) for r, c, score in best]
        return _gathered(left, right, ("qid", "id"), found)

    return a.groupBy("_g", "_q", "_i").cogroup(b.groupBy("_g", "_q", "_i")).applyInArrow(meet, _pair_schema(("qid", "id"), q, i))


def candidate_topk(queries: DataFrame, items: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k best of the given candidates (qid, id); built-in expressions only."""
    dot = F.round(F.aggregate(F.zip_with(F.col("qv").cast("array<double>"), F.col("vec").cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9)
    joined = candidates.join(queries.select("qid", F.col("vec").alias("qv")), "qid").join(items.select("id", "vec"), "id")
    return _top(joined.select("qid", "id", dot.alias("score")), ["qid"], [F.desc("score"), F.asc("id")], k)


def vector_classes(items: DataFrame) -> DataFrame:
    """id, class_id: items with equal vectors are one class, named by its smallest id; unusable vectors are left out."""
    own = _vectors(items, "id")
    first = own.groupBy("vec").agg(F.min("key").alias("class_id"))
    return own.join(first, "vec").select(F.col("key").alias("id"), "class_id")


def similar_pairs(items: DataFrame, least: float, rows: int | None = None) -> DataFrame:
    """a < b, score: all pairs of different vectors whose dot product is above `least`, each once and none left out.

    Equal vectors stand as one, their smallest id (vector_classes gives the members).  Blocks of about `rows` vectors (by default of CELLS components) meet each
    other once in tasks that multiply matrices, so the work grows with the square of the number of different vectors;
    near_pairs_by_lsh finds most of the pairs of a high similarity for less.
    """
    first = _vectors(items, "id").groupBy("vec").agg(F.min("key").alias("key"))
    pairs = _each_pair(first, least, None, rows)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def similar_topk(items: DataFrame, k: int, least: float, rows: int | None = None) -> DataFrame:
    """As vector_topk of items (id, vec) among themselves above `least`, for ids that come once: blocks meet once and tell both sides."""
    return _top(_each_pair(_vectors(items, "id"), least, k, rows).select(F.col("x").alias("qid"), F.col("y").alias("id"), "score"), ["qid"], [F.desc("score"), F.asc("id")], k)


def _each_pair(own: DataFrame, least: float, k: int | None, rows: int | None) -> DataFrame:
    """x, y, score: the pairs of vectors (key, vec) above `least` once, or with k, both ways, the k best of each of them in each block it meets.

    Pairs without k leave a task part by part as they are found, so it holds two blocks of vectors, however many pairs they make.
    """
    x, n = _blocked(saved(own.select("key", "vec"), "vectors"), rows, PAIRED if k is None else FEW)
    x = x.select("key", "vec", "_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o"))
    dealt = x.select("key", "vec", F.least("_b", "_o").alias("_q"), F.greatest("_b", "_o").alias("_i"), (F.col("_b") > F.col("_o")).alias("_right"))

    def meet(blocks: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = blocks[0] == blocks[1]
        (one, keys), (two, others) = _sides(batches)
        (two, others) = (one, keys) if same else (two, others)
        codes = pd.factorize(keys.to_numpy(zero_copy_only=False), sort=True)[0]
        for dim in one.keys() & two.keys():
            (mine, p), (theirs, q) = one[dim], two[dim]
            there: list[tuple[np.ndarray, ...]] = []
            back: list[tuple[np.ndarray, ...]] = []
            for i, j, score in _near(p, q, least):
                if same:
                    good = codes[mine[i]] < codes[mine[j]] if k is None else codes[mine[i]] != codes[mine[j]]
                    i, j, score = i[good], j[good], score[good]
                if k is None:
                    yield from _told(keys, others, mine[i], theirs[j], score)
                    continue
                there.append((i, j, score))
                if not same:
                    back.append((j, i, score))
                if sum(len(f[0]) for f in there[1:]) > SCORES:
                    there, back = ([_kept(f, k)] if f else [] for f in (there, back))
            for found, (a, at), (b, to) in ((there, (keys, mine), (others, theirs)), (back, (others, theirs), (keys, mine))):
                if found:
                    i, j, score = _kept(found, k)
                    yield from _told(a, b, at[i], to[j], score)

    return dealt.groupBy("_q", "_i").applyInArrow(meet, _pair_schema(("x", "y"), own, own))


def _sides(batches: Iterator[pa.RecordBatch]) -> list[tuple[dict[int, tuple[np.ndarray, np.ndarray]], pa.Array]]:
    """The matrices and the keys of the two blocks of vectors that meet, told by _right; the second is empty where a block meets itself."""
    sides: tuple[list[pa.RecordBatch], ...] = ([], [])
    for batch in batches:
        for side, taken in zip(sides, (pc.invert(batch["_right"]), batch["_right"]), strict=True):
            side.append(batch.select(["key", "vec"]).filter(taken))
    out = []
    for side in sides:
        block = pa.Table.from_batches(side)
        side.clear()
        out.append((_matrices(block, False), block["key"].combine_chunks()))
    return out


def _told(keys: pa.Array, others: pa.Array, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(i), 131_072):
        a, b = (own.take(pa.array(rows[at : at + 131_072])) for own, rows in ((keys, i), (others, j)))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(score[at : at + 131_072])], ["x", "y", "score"])


def near_pairs_by_lsh(items: DataFrame, least: float = 0.92, tables: int = 16, width: float = 1.0, seed: int = 7) -> DataFrame:
    """As similar_pairs for unit vectors of one length, but only pairs that share a bucket of a random projection are compared.

    What is returned is checked exactly; a pair at the threshold is missed if all `tables` projections part it.  More tables and a larger
    `width` (of a bucket, in distances at the threshold) find more and compare more.
    """
    first = _vectors(items, "id").groupBy("vec").agg(F.min("key").alias("key"))
    own = first.select("key", F.col("vec").cast("array<double>").alias("vec"), array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    distance = float(np.sqrt(max(1e-12, 2 - 2 * least)))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width * distance, numHashTables=tables, seed=seed).fit(own)
    near = model.approxSimilarityJoin(own, own, distance * 1.000001 + 1e-6).where("datasetA.key < datasetB.key")
    dot = F.round(F.aggregate(F.zip_with("datasetA.vec", "datasetB.vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9)
    return near.select(F.col("datasetA.key").alias("a"), F.col("datasetB.key").alias("b"), dot.alias("score")).where(F.col("score") > least)


def near_duplicates(memories: DataFrame, least: float = 0.92) -> DataFrame:
    """Pairs of different live vectors (id, vec, is_superseded) so near that they say the same."""
    return similar_pairs(memories.where(~F.col("is_superseded")), least)


def conflict_candidates(memories: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs of different live vectors (id, vec, is_superseded) near enough to contradict each other."""
    return similar_pairs(memories.where(~F.col("is_superseded")), least)


def conflicts_of(new: DataFrame, memories: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """For single memories (id, vec): the k nearest live ones above a similarity, as a list to look at."""
    return vector_topk(new.select(F.col("id").alias("qid"), "vec"), memories.where(~F.col("is_superseded")).select("id", "vec"), k, least)


def tokens(c: str | Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def bm25_search(queries: DataFrame, docs: DataFrame, id_col: str = "id", text: str | list[str] = "text", k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, score, rank: documents that hold all terms of a query (qid, text), by BM25 over one text column or some together.

    Only postings of query terms are kept before anything is shuffled or scored; document counts and the mean length cover all, and
    words are only counted for these.
    """
    body = F.concat_ws("\n", *([text] if isinstance(text, str) else text))
    terms = queries.select("qid", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    stats = docs.agg(F.count("*").alias("docs"), F.avg(F.regexp_count(F.lower(body), F.lit(r"[\p{L}\p{N}]+"))).alias("mean"))
    own = docs.select(F.col(id_col).alias("id"), tokens(body).alias("t"))
    wanted = saved(terms.select("term").distinct(), "wanted")  # by its files' size Spark sends it to the texts
    postings = own.select("id", F.size("t").alias("size"), F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "size").agg(F.count("*").alias("tf"))
    postings = saved(postings, "counts")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return products.conjunctions(terms, postings.join(saved(df, "df"), "term").join(F.broadcast(stats)).select("term", "id", part.alias("part")), k)  # stats: one row


def _united(parts: list[DataFrame], *keys: str) -> DataFrame:
    """The union of parts, dealt by keys.

    Parts that are partitioned alike would keep that partitioning in their union, while adaptive execution may read the partitions of each part
    differently; rows of one key could then stand in two partitions.
    """
    return reduce(DataFrame.union, parts).repartition(*keys)


def seed_tags(found: DataFrame, least: float = 0.4, n: int = 3) -> DataFrame:
    """Of the nearest vectors of each query (kind memory or tag), the tags above a score: qid, tag, activation."""
    own = found.where((F.col("kind") == "tag") & (F.col("score") > least))
    return _top(own, ["qid"], [F.desc("score"), F.asc("id")], n).select("qid", F.col("id").alias("tag"), F.col("score").alias("activation"))


def space_priors(space_memories: DataFrame, mentions: DataFrame, tags: DataFrame, n: int = 20) -> DataFrame:
    """space_id, tag, prior: how much each awake tag stands for a space, the largest being 1."""
    awake = tags.where(~F.col("is_dormant")).select(F.col("name").alias("tag"))
    own = space_memories.join(mentions, "memory_id").join(awake, "tag").groupBy("space_id", "tag").agg(F.sum("relevance").alias("s"), F.count("*").alias("c"))
    best = _top(own, ["space_id"], [F.desc(F.round("s", 9)), F.desc("c"), F.asc("tag")], n)
    return best.select("space_id", "tag", (F.col("s") / F.max("s").over(W.Window.partitionBy("space_id"))).alias("prior"))


def with_priors(seeds: DataFrame, queries: DataFrame, priors: DataFrame) -> DataFrame:
    """Seeds joined with the priors of the query's space, at 0.35 of their value and 0.85 at most."""
    more = queries.where(F.col("space_id").isNotNull()).join(priors, "space_id").select("qid", "tag", F.least(F.col("prior") * 0.35, F.lit(0.85)).alias("activation"))
    return _united([seeds.select("qid", "tag", "activation"), more], "qid", "tag").groupBy("qid", "tag").agg(F.max("activation").alias("activation"))


def spread(seeds: DataFrame, neighbors: DataFrame, hops: int = 3, decay: float = 0.5) -> DataFrame:
    """qid, tag, activation: activation that spreads over weighted edges for some hops, the largest being 1.

    All that flows in a hop comes from the activations at its start.  A tag that is reached anew takes the largest
    inflow; one that is active already gains 0.3 of the sum of its positive inflows, and never loses.  neighbors: tag, neighbor, relation_type,
    hebbian_weight.
    """
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in RELATION_FACTORS.items() for x in kv])[F.col("relation_type")], F.lit(1.0))
    edges = saved(neighbors.select("tag", "neighbor", (F.col("hebbian_weight") * decay * factor).alias("carry")).where("carry > 0").repartition("tag").sortWithinPartitions("tag"), "carries")
    state = seeds.select("qid", "tag", "activation")
    for hop in range(hops):
        state = saved(state, "frontier") if hop else state  # cuts the plan, which would hold each hop twice
        flow = state.join(edges, "tag").select("qid", F.col("neighbor").alias("tag"), (F.col("activation") * F.col("carry")).alias("p"))
        flow = flow.groupBy("qid", "tag").agg(F.max("p").alias("most"), F.sum("p").alias("sum"))
        state = state.join(flow, ["qid", "tag"], "full").select("qid", "tag", F.when(F.col("activation").isNull(), F.col("most")).otherwise(F.col("activation") + 0.3 * F.coalesce("sum", F.lit(0.0))).alias("activation"))
    top = F.max("activation").over(W.Window.partitionBy("qid"))
    return state.select("qid", "tag", (F.col("activation") / top).alias("activation"))


def landing(active: DataFrame, mentions: DataFrame, memories: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """qid, id, score, rank: memories that active tags land on; 1.2 of it in the query's session, 1.35 in its space."""
    found = products.landing(active, mentions, memories, queries, k)
    return _top(found, ["qid"], [F.desc("score"), F.asc("id")], k)


def rrf(channels: list[DataFrame], k: int = 20, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of channels (qid, id, rank): the sum of 1 / (constant + rank)."""
    fused = _united([c.select("qid", "id", "rank") for c in channels], "qid", "id").groupBy("qid", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.count("*").alias("channels"))
    return _top(fused, ["qid"], [F.desc("score"), F.asc("id")], k)


def quality_factor(policy: Column, quality: Column) -> Column:
    """Null where a review keeps a memory out of recall; else the factor of its score."""
    review = F.least(F.greatest(0.5 + F.coalesce(quality, F.lit(0.5)), F.lit(0.25)), F.lit(1.2))
    return F.when(policy.isNull(), 1.0).when(policy.isin("exclude", "exclude_default"), None).when(policy == "downrank", 0.45 * review).otherwise(review)


def rerank(fused: DataFrame, memories: DataFrame, reviews: DataFrame, queries: DataFrame, as_of: Column, k: int = 5, mode: str = "boost", pool: int | None = None) -> DataFrame:
    """The k best of a fused pool under governance, with the reasons of each.

    Superseded, wrong, muted and deleted memories and those that a review excludes are dropped.  Scores are multiplied by signal,
    user weight, expiry, pin, space and quality; mode within keeps only the query's space.
    """
    own = fused.where(F.col("rank") <= pool) if pool else fused
    own = own.select("qid", "id", "score").join(memories, "id").join(reviews.select(F.col("memory_id").alias("id"), "recall_policy", "quality_score"), "id", "left")
    own = own.join(queries.select("qid", F.col("space_id").alias("qp"), *[F.col(c).alias("qs") for c in queries.columns if c == "session_id"]), "qid")
    own = own.where(~F.col("is_superseded") & ~F.col("status").isin("wrong", "muted", "deleted")).withColumn("q", quality_factor(F.col("recall_policy"), F.col("quality_score"))).where("q is not null")
    inside = F.coalesce(F.col("space_id") == F.col("qp"), F.lit(False))
    if mode == "within":
        own = own.where(inside)
    expired = F.coalesce(F.col("valid_until") <= as_of, F.lit(False))
    signal = F.coalesce(F.create_map(*[F.lit(x) for kv in SIGNAL_FACTORS.items() for x in kv])[F.col("signal_level")], F.lit(1.0))
    space = F.when(inside & (mode == "boost"), 1.25 * F.when(F.col("memory_type") == "DECISION", 1.08).otherwise(1.0)).otherwise(1.0)
    score = F.col("score") * signal * F.col("user_weight") * F.when(expired, 0.25).otherwise(1.0) * F.when(F.col("pinned"), 1.25).otherwise(1.0) * space * F.col("q")
    here = F.coalesce(F.col("session_id") == F.col("qs"), F.lit(False)) if "session_id" in memories.columns and "session_id" in queries.columns else F.lit(False)
    why = F.array_compact(F.array(F.when(F.col("pinned"), "pinned"), F.when(expired, "expired"), F.when(inside, "space"), F.when(here, "session"), F.when(F.col("signal_level") == 2, "strong signal"), F.when(F.col("user_weight") > 1, "raised").when(F.col("user_weight") < 1, "lowered"), F.when(F.col("recall_policy") == "downrank", "downranked")))
    return _top(own.select("qid", "id", F.round(score, 9).alias("score"), why.alias("reasons")), ["qid"], [F.desc("score"), F.asc("id")], k)


def recall(
    queries: DataFrame,
    memories: DataFrame,
    mentions: DataFrame,
    tags: DataFrame,
    neighbors: DataFrame,
    space_memories: DataFrame,
    reviews: DataFrame,
    as_of: Column,
    k: int = 5,
    depth: int = 20,
    mode: str = "boost",
    pool: int | None = None,
    text: str | list[str] = "text",
    n_tags: int = 5,
    index: str | None = None,
) -> DataFrame:
    """End-to-end batch recall: qid, id, score, rank, raw_score, channels, tags and reasons of the k best memories of each query.

    queries: qid, text, vec, session_id, space_id; memories: id, vec, the text columns, session_id and what rerank looks at; mentions: memory_id,
    tag, relevance; tags: name, vec, is_dormant; neighbors as spread takes them; space_memories: space_id, memory_id; reviews: memory_id,
    recall_policy, quality_score.  Three channels of `depth` memories each, by vectors, by words and by activation that spreads from seed tags and the
    priors of the query's space, are fused by reciprocal ranks and re-ranked under governance.  Queries in a space have a pool of max(5 k, 30), or
    `pool`; others have k, so what governance drops makes their answers shorter.  channels names those that found a memory.  With `index`, the path of
    a full-text index of the memories (see bm25), words are looked up there instead of in their texts.  What is looked at more than once is written once.
    """
    queries = saved(queries, "queries")
    from recallspark.operators import bm25  # which uses tokens of this module

    q = queries.select("qid", "vec")
    by_vector = saved(vector_topk(q, memories.select("id", "vec"), max(depth, 5)), "nearest")
    by_words = saved(bm25.search(queries.select("qid", "text"), index, depth) if index else bm25_search(queries.select("qid", "text"), memories, "id", text, depth), "words")
    named = vector_topk(q, tags.where(~F.col("is_dormant")).select(F.col("name").alias("id"), "vec"), 5)
    # The five nearest of memories and tags together are among the five nearest of each, so memories are searched once.
    both = _united([by_vector.where("rank <= 5").select("qid", F.col("id").cast("string").alias("id"), "score", "rank", F.lit("memory").alias("kind")), named.select("qid", "id", "score", "rank", F.lit("tag"))], "qid")
    near = _top(both.withColumnRenamed("rank", "_r"), ["qid"], [F.desc("score"), F.asc("kind"), F.asc("_r")], 5).drop("_r")
    seeds = with_priors(seed_tags(near), queries, space_priors(space_memories, mentions, tags))
    by_graph = saved(landing(spread(saved(seeds, "seeds"), neighbors), mentions, memories, queries, depth), "graph")
    channels = {"vector": by_vector.where(F.col("rank") <= depth), "words": by_words, "graph": by_graph}
    ranked = _united([c.select("qid", "id", "rank", F.lit(name).alias("channel")) for name, c in channels.items()], "qid", "id")
    fused = ranked.groupBy("qid", "id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("raw_score"), F.sort_array(F.collect_set("channel")).alias("channels"))
    wide = F.when(F.col("space_id").isNull(), k).otherwise(pool or max(5 * k, 30))
    fused = fused.withColumn("rank", F.row_number().over(W.Window.partitionBy("qid").orderBy(F.desc("raw_score"), "id")))
    fused = saved(fused.join(queries.select("qid", wide.alias("_wide")), "qid").where(F.col("rank") <= F.col("_wide")).drop("_wide"), "fused")
    best = saved(rerank(fused.withColumn("score", F.col("raw_score")), memories, reviews, queries, as_of, k, mode), "best")
    first = W.Window.partitionBy("memory_id").orderBy(F.desc("relevance"), "tag")
    wanted = best.select(F.col("id").alias("memory_id")).distinct()
    words = mentions.join(wanted, "memory_id", "left_semi").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n_tags)
    words = words.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("_r", "tag"))).alias("_t")).select(F.col("memory_id").alias("id"), F.transform("_t", lambda x: x["tag"]).alias("tags"))
    out = best.join(fused.select("qid", "id", "raw_score", "channels"), ["qid", "id"]).join(words, "id", "left")
    return out.select("qid", "id", "score", "rank", "raw_score", "channels", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "reasons")
