"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds, reranked on the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.llm.blocks import blocked_search, rows_of, usable
from recallspark.llm._common import map_batches, require, table

#: Rows of a block, and queries that visit it together.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Width of the error bound in standard deviations of an estimate; bits of a rotated query's components.
WIDTH, QUERY_BITS, SEED = 1.9, 6, 20_240
_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
#: Components up to which the rotation is a matrix.
DENSE = 2048
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
        _rotations[dim, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, seed]


def turn(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Randomly rotated rows.  Up to DENSE components by a matrix; longer ones are padded to a power of two, and three rounds of random signs and a
    Hadamard transform turn them in memory of their own size."""
    n, dim = vectors.shape
    if dim <= DENSE:
        return vectors @ rotation(dim, seed)
    wide = 1 << (dim - 1).bit_length()
    out = np.zeros((n, wide))
    out[:, :dim] = vectors
    signs = np.random.default_rng([seed, dim])
    for _ in range(3):
        out *= signs.choice(np.array([-1.0, 1.0]), wide)
        half = 1
        while half < wide:
            pairs = out.reshape(n, wide // (2 * half), 2, half)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, wide)
            half *= 2
        out /= np.sqrt(wide)
    return out


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit residuals, the residuals' norms, and the inner products of code and residual."""
    rest = vectors - centre
    norm = np.linalg.norm(rest, axis=1)
    turned = turn(rest / np.where(norm > 0, norm, 1)[:, None], seed)
    return np.packbits(turned >= 0, axis=1), norm, np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


class Codes:
    """One block of coded vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, width: float):
        self.ids, self.vectors, self.norm, self.dim = ids, vectors, norm, vectors.shape[1] if vectors.shape[1] <= DENSE else 1 << (vectors.shape[1] - 1).bit_length()
        wide = -(-codes.shape[1] // 8) * 8
        self.codes = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, wide - codes.shape[1])))).view(np.uint64)
        self.ones = np.bitwise_count(self.codes).sum(1).astype(float)
        self.fit = np.where(fit > 0, fit, 1.0)
        self.error = width * np.sqrt(np.maximum(0, 1 - fit * fit)) / self.fit / np.sqrt(max(1, self.dim - 1))

    def bounds(self, query: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, from the packed bits and the stored scalars alone."""
        rest = query - centre
        length = np.linalg.norm(rest)
        turned = turn((rest / length if length else rest)[None], seed)[0]
        low = turned.min()
        step = (turned.max() - low) / ((1 << QUERY_BITS) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.int64)
        summed = low * self.ones
        for bit in range(QUERY_BITS):
            plane = np.packbits(((levels >> bit) & 1).astype(bool))
            plane = np.pad(plane, (0, self.codes.shape[1] * 8 - len(plane))).view(np.uint64)
            summed += step * (1 << bit) * np.bitwise_count(self.codes & plane).sum(1)
        kept = low + step * levels
        root = np.sqrt(self.dim)
        estimate = (2 * summed - kept.sum()) / root / self.fit
        error = self.error + np.abs(turned - kept).sum() / root / self.fit  # the second part is exact: the query's rounding
        scale = 2 * self.norm * length
        base = self.norm**2 + length**2
        return base - scale * np.minimum(1, estimate + error), base - scale * np.maximum(-1, estimate - error)

    def search(self, own_id: int, query: np.ndarray, centre: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest found: the bounds choose the rows whose vectors are compared."""
        lower, upper = self.bounds(query, centre, seed)
        rows = np.flatnonzero(self.ids != own_id)
        if len(rows) > k:
            limit = np.partition(upper[rows], k - 1)[k - 1]
            rows = rows[lower[rows] <= limit]
            rows = rows[np.argsort(lower[rows], kind="stable")]
        distance = np.zeros(0)
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            if len(distance) >= k and lower[part[0]] > np.partition(distance, k - 1)[k - 1]:
                rows = rows[:at]  # no further row can be among the k nearest
                break
            rest = self.vectors[part] - query
            distance = np.append(distance, (rest * rest).sum(1))
        order = np.lexsort((self.ids[rows], np.sqrt(distance)))[:k]
        return rows[order], np.sqrt(distance[order])


def centres(items: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension that at least a hundredth of all items has; others are coded from the origin.

    At most a hundred dimensions count, and one row for each of their components comes to the driver.
    """
    sizes = items.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    counts = sizes.orderBy(F.desc("n"), "dim").limit(100).collect()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    out = {r.dim: np.zeros(r.dim) for r in counts if 100 * r.n >= total}
    if out:
        parts = items.where(F.size("v").isin(*out)).select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("x"))
        for dim, at, x in parts.collect():
            out[dim][at] = x
    return out


def centre_of(means: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return means[dim] if dim in means else np.zeros(dim)


def index(items: DataFrame, means: dict[int, np.ndarray], seed: int = SEED) -> DataFrame:
    """The index table: id, v, code (packed bits), norm and fit of every item."""
    schema = T.StructType([*items.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("fit", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = rows_of(batch.column(1))
        code: list[bytes] = [b""] * len(rows)
        norm, fit = np.zeros(len(rows)), np.zeros(len(rows))
        for dim in {len(r) for r in rows}:
            at = [k for k, r in enumerate(rows) if len(r) == dim]
            bits, norm[at], fit[at] = encode(np.array([rows[k] for k in at], float), centre_of(means, dim), seed)
            for k, b in zip(at, bits, strict=True):
                code[k] = b.tobytes()
        yield {"id": batch.column(0), "v": batch.column(1), "code": code, "norm": norm, "fit": fit}

    return map_batches(items, run, schema)


def nearest(queries: DataFrame, items: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", width: float = WIDTH, seed: int = SEED, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k items nearest to each query by Euclidean distance, as found by one-bit codes.

    Every item is coded: one bit for each component of its randomly rotated residual from the mean, its norm, and how
    well the code fits.  For each query, packed bits and scalars give an estimate with an error bound of `width`
    standard deviations; rows whose lower bound is not above the k-th smallest upper bound are reranked by
    their vectors in double precision.  A wider bound finds more and compares more.

    Returns query_id, rank (from 1), vec_id, score (the distance); ties go by the smaller id, and there are fewer rows
    where there are fewer items.  A query is not compared with items of its own id, nor with vectors of another
    length.  Vectors that are null, zero or hold anything null or not finite take no part; a query id that comes twice is
    asked once; repeated items each count.  Other columns are left out.
    """
    require(queries, id_col, vec_col)
    require(items, id_col, vec_col)
    kind = "array<float>" if all(x.schema[vec_col].dataType.simpleString() == "array<float>" for x in (queries, items)) else "array<double>"
    own = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable("v")).where(F.exists("v", lambda x: x != 0))
    clean = own(items)
    means = centres(clean)
    arrow = to_arrow_schema(_SCHEMA)

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, rows, asked = right["id"].to_numpy(), rows_of(right["v"]), rows_of(left["v"])
            lengths, query_ids = np.array([len(r) for r in rows]), left["id"].to_numpy()
            for dim in sorted({len(q) for q in asked} & set(lengths.tolist())):
                at = np.flatnonzero(lengths == dim)
                code = right["code"].to_pylist()
                bits = np.frombuffer(b"".join(code[a] for a in at), np.uint8).reshape(len(at), -1)
                block = Codes(ids[at], np.array([rows[a] for a in at], float), bits, right["norm"].to_numpy()[at], right["fit"].to_numpy()[at], width)
                for query, vec in zip(query_ids, asked, strict=True):
                    if len(vec) == dim:
                        found, score = block.search(query, vec.astype(float), centre_of(means, dim), k, seed)
                        out.append((np.full(len(found), query), block.ids[found], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    best = blocked_search(own(queries).dropDuplicates(["id"]), index(clean, means, seed), local, _SCHEMA, k, [F.asc("score"), F.asc("vec_id")], query_rows, block_rows)
    return best.select("query_id", "rank", "vec_id", "score")


def op2_one_bit_codes(spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return nearest(items.where(F.col("vec_id") % 100 == 0), items, k=10)


QUERIES = {"op2_one_bit_codes": op2_one_bit_codes}
ORACLES: dict[str, str] = {}
