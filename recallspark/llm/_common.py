"""Helpers that the operators share: reading tables, Arrow batch mapping, scratch tables, crc folds."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    """Raise a clear error where an operator's input column is missing."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the input has {df.columns}")


def fresh(taken: list[str], name: str) -> str:
    """name, or the first longer one that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow where fn turns one record batch into dicts of columns in the order of schema."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small runs of a batch, so that what is made of one run stays small as well."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def trim() -> None:
    """Give what is free back to the system: a worker lives on, and its next tasks are of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fold(col: str, mod: int) -> F.Column:
    """crc32 of the id as text, modulo mod: the split into learning and held-out rows."""
    return (F.crc32(F.col(col).cast("string").cast("binary")) % mod).cast("int")


def row_key(id_col: str, text_col: str) -> F.Column:
    """256-bit key of a row's id and text, nulls included; rows of the same key are repeated rows."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(F.col(id_col).cast("string")), part(F.col(text_col).cast("string"))).cast("binary"), 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; the session's own setting is kept where there is one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or (context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else None)
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="recallspark-")
        context.setCheckpointDir(base)
    return os.path.join(str(base), f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and nothing is computed twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
