"""Whitening of embeddings by principal components, on distributed block matrices.

Rows are indexed, centred and put into a BlockMatrix; its transpose times itself is the scatter matrix, whose eigenvectors are found on the driver
(it has one row and one column for each component); the BlockMatrix times the whitening matrix projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from recallspark.llm._common import map_batches, require, saved, table
from recallspark.llm.blocks import rows_of, usable

#: Rows of a block at least, blocks at most (but for blocks of more than BLOCK_BYTES), blocks of rows that one task multiplies, and components up to which the
#: scatter matrix is solved on the driver.
BLOCK_ROWS, BLOCKS, BLOCK_BYTES, TASK_BLOCKS, WIDEST = 1024, 50_000, 1 << 26, 8, 8192
#: Components kept; a component with less than this share of the largest variance has none.
KEPT, NONE = 8, 1e-12
#: Whole numbers that the fit is made of: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this size have no such whole number that doubles hold, and count as not finite.
LARGEST = 2.0**42


def block_rows(n: int, dim: int) -> int:
    return min(max(BLOCK_ROWS, -(-n // BLOCKS)), max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))


def _indexed(rows: DataFrame, n: int, dim: int) -> IndexedRowMatrix:
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector"), n, dim)


def scatter(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Sum of the outer products of rows (index, values), which are to be centred: the transposed BlockMatrix times itself.

    All blocks meet in one entry of the result, so the dimension that they share is cut into ranges of TASK_BLOCKS blocks, whose
    products are made in tasks of their own and added up.
    """
    height = block_rows(n, dim)
    blocks = _indexed(rows, n, dim).toBlockMatrix(height, dim)
    splits = max(1, -(-n // (height * TASK_BLOCKS)))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, dim, dim).toLocalMatrix().toArray()


def projected(rows: DataFrame, n: int, matrix: np.ndarray) -> DataFrame:
    """index and values of rows (index, values) times a matrix, by a product of BlockMatrices."""
    dim, kept = matrix.shape
    right = rows.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "index long, values array<double>")
    product = _indexed(rows, n, dim).toBlockMatrix(block_rows(n, dim), dim).multiply(_indexed(right, dim, kept).toBlockMatrix(dim, kept))
    found = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("values"))


def _sums(rows: DataFrame, dim: int) -> list[int]:
    """Exact sums of the whole numbers x of each component; tasks sum their batches."""
    schema = T.StructType([T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        total = np.zeros(dim, np.int64)
        for x in rows_of(batch.column(0)):
            total[: len(x)] += x
            total[len(x) :] += SHIFT
        yield {"sums": [total]}

    parts = map_batches(rows.select("x"), run, schema).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    found = dict(parts.collect())
    return [found[k] for k in range(dim)]


def whiten(items: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", kept: int = KEPT) -> DataFrame:
    """One row for each usable row of items and component: id, component (from 1, by falling variance), n, deviation, whitened, explained and identity_error.

    Each entry c of a vector becomes the whole number x = floor(1024 c) + 100000.  The fit is made of all n usable rows; deviation is the exact sum of (n x - S)**2, S being
    the sums of x, as a decimal; whitened is the centred row along a unit eigenvector of the covariance over the root of its eigenvalue; explained is the
    eigenvalue's share of the trace, and identity_error the largest entry of the covariance of whitened less the identity.

    Vectors that are null or hold anything null, not finite or beyond 2**42 are left out.  A vector that is shorter than the longest ends in zeros; repeated rows and ids
    are rows of their own, a null id comes along.  Components without variance (all of them, where all rows are equal) are left out, and a table without usable
    rows gives no rows.  More than WIDEST components raise an error.  Other columns are left out.
    """
    require(items, id_col, vec_col)
    own = items.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v") & F.forall("v", lambda c: F.abs(c) <= LARGEST))
    own = own.select("id", F.transform("v", lambda c: F.floor(c * float(SCALE)).cast("long") + SHIFT).alias("x"))
    own = saved(own.select("id", "x", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "rows")
    schema = f"{id_col} {own.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, dim = own.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not dim:
        return items.sparkSession.createDataFrame([], schema)
    if dim > WIDEST:
        raise ValueError(f"vectors of {dim} components; the scatter matrix of at most {WIDEST} is solved")
    sums = items.sparkSession.createDataFrame([(_sums(own, dim),)], "s array<bigint>")
    # A row's index is its place in its partition behind the rows of the partitions before; there is one row for each partition.
    parts = own.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size("x")))
    rows = own.join(parts, "_part").crossJoin(F.broadcast(sums))  # sums: one row
    rows = rows.select("id", (F.col("_at") - F.col("_first") + F.col("_before")).alias("index"), F.zip_with(whole, F.col("s"), lambda x, s: x * F.lit(n).cast("long") - s).alias("d"))
    square = lambda d: (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")
    deviation = F.aggregate("d", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)"))
    rows = saved(rows.select("id", "index", deviation.alias("deviation"), F.transform("d", lambda d: d.cast("double") / float(n)).alias("values")), "centred")
    spread = scatter(rows, n, dim) / n
    value, vector = np.linalg.eigh((spread + spread.T) / 2)
    value, vector = value[::-1][:kept], vector[:, ::-1][:, :kept]
    good = value > max(value[0], 0) * NONE
    value, vector = value[good], vector[:, good]
    if not len(value):
        return items.sparkSession.createDataFrame([], schema)
    flat = saved(projected(rows, n, vector / np.sqrt(value)), "whitened")
    component = [F.col("values")[k] for k in range(len(value))]
    mean = flat.agg(*[F.avg(c) for c in component]).first()
    pairs = [(i, j) for i in range(len(value)) for j in range(i + 1)]
    products = flat.agg(*[F.avg((component[i] - mean[i]) * (component[j] - mean[j])) for i, j in pairs]).first()
    error = max(abs(p - (i == j)) for (i, j), p in zip(pairs, products, strict=True))
    share = F.array(*[F.lit(float(v / np.trace(spread))) for v in value])
    out = rows.select("id", "index", "deviation").join(flat, "index").select("id", "deviation", F.posexplode("values").alias("_k", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("_k")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """deviation is null where it is beyond a long."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
