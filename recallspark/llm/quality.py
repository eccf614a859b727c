"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and a calibrated score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.llm._common import fold, fresh, map_batches, require, slices, table

#: At most so many labelled documents of each class, and so many pieces of them, make the dictionaries; and so many more documents calibrate the score.
DICTIONARY_ROWS, DICTIONARY_PIECES, CALIBRATION_ROWS = 1500, 12_000, 8000
#: Bytes of a dictionary, and of the pieces that a text is compressed in (a long text must not learn from itself).
DICTIONARY_BYTES, PIECE = 112_640, 512
LEVEL = 3
_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


@dataclass(frozen=True)
class Model:
    """good and bad: dictionaries; mean, scale, weights: the calibration of the difference; constant: the score where no model was learnt."""

    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float = 0.5


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on pieces of text, or their own bytes where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Built once in each Python worker."""
    key = hashlib.sha256(content).digest()
    if key not in _compressors:
        own = zstandard.ZstdCompressionDict(content) if content else None
        if own:
            own.precompute_compress(level=LEVEL)
        _compressors[key] = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _compressors[key]


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """How many bytes fewer a text takes with the dictionary of good text than with that of bad text, for each byte of it: the one input of a score."""
    data = (text or "").encode()
    with_good, with_bad = compressor(good), compressor(bad)
    g = b = 0
    for k in range(0, max(1, len(data)), PIECE):
        piece = data[k : k + PIECE]
        g += len(with_good.compress(piece))
        b += len(with_bad.compress(piece))
    return (b - g) / (len(data) + 8)


def expand(x: np.ndarray, mean, scale) -> np.ndarray:
    z = np.clip((x - np.asarray(mean)) / np.asarray(scale), -6, 6)
    return np.hstack([np.ones((len(z), 1)), z])


#: Weight of the squared weights against the summed log loss.
RIDGE = 0.1


def balance(y: np.ndarray) -> np.ndarray:
    """Weights of the rows, so that both classes weigh the same: a score does not say how many documents of a sample were good."""
    good = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    return len(y) / 2 / np.where(y == 1, good[0], good[1])


def loss(w: np.ndarray, a: np.ndarray, y: np.ndarray) -> float:
    """Summed log loss of the labels, both classes weighing the same, and the ridge."""
    z = a @ w
    return float((balance(y) * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * RIDGE * (w * w).sum())


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[tuple, tuple, tuple]:
    """Logistic regression of the labels on the difference, by Newton's method with steps that are halved until the loss falls.

    The loss is convex, so this ends at its only minimum, also where the classes can be parted without an error.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = expand(x, mean, scale)
    w = np.zeros(a.shape[1])
    now, even = loss(w, a, y), balance(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (even * p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w)), a.T @ (even * (p - y)) + RIDGE * w)
        size = 1.0
        while (new := loss(w - size * step, a, y)) > now and size > 1e-10:
            size /= 2
        w, gain, now = w - size * step, now - new, min(now, new)
        if gain < 1e-9:
            break
    return tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w))


def _pieces(batch: pa.RecordBatch) -> Iterator[dict]:
    """Pieces of whole texts, each with a hash of its document and place."""
    for y, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        data = (text or "").encode()
        own = [data[k : k + PIECE] for k in range(0, max(1, len(data)), PIECE)]
        yield {"y": [y] * len(own), "h": [int.from_bytes(hashlib.blake2b(f"{h}:{k}".encode(), digest_size=7).digest(), "big") for k in range(len(own))], "piece": own}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learn from a bounded sample of labelled rows: the first by a hash of their id, other rows for each purpose.

    The dictionaries are trained on pieces of PIECE bytes, as texts are compressed in, from anywhere in the whole texts of their rows, at most DICTIONARY_PIECES
    of a class, the first by a hash of id and place; so what comes to the driver is bounded however long texts are.

    Labels other than 0 and 1 and ids with contradicting labels are left out.  Where a class is missing, the model
    gives the other class's value for every text, and 0.5 where there are no labels at all.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    own = own.select("_id", "_y", F.xxhash64(F.lit(17), "_id").alias("_h"))
    half = F.col("_h").bitwiseAND(F.lit(1))
    one = lambda y: own.where((half == 0) & (F.col("_y") == y)).orderBy("_h", "_id").limit(dictionary_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = texts.join(F.broadcast(one(1).unionByName(one(0))), "_id").select("_y", "_h", "_text")  # at most 2 x dictionary_rows
    pieces = map_batches(chosen, _pieces, T.StructType([T.StructField("y", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("piece", T.BinaryType())]))
    by = {y: [bytes(r.piece) for r in pieces.where(F.col("y") == y).orderBy("h", "piece").limit(DICTIONARY_PIECES).collect()] for y in (0, 1)}
    if not all(by.values()):
        return Model(constant=1.0 if by[1] else 0.0 if by[0] else 0.5)
    good, bad = dictionary(by[1]), dictionary(by[0])
    sample = texts.join(F.broadcast(own.where(half == 1).orderBy("_h", "_id").limit(calibration_rows)), "_id").select("_text", "_y")
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"y": batch.column(1), "x": [difference(x, good, bad) for x in batch.column(0).to_pylist()]}

    got = np.array(map_batches(sample, run, schema).collect(), dtype=float).reshape(-1, 2)  # at most calibration_rows
    if not len(got):
        got = np.array([(y, difference(t.decode("utf-8", "ignore"), good, bad)) for y in (0, 1) for t in by[y]])
    order = np.lexsort(got.T)  # the sums do not depend on the order of arrival
    return Model(good, bad, *calibrate(got[order, 1:], got[order, 0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: id_col, the columns of `keep`, score (0 to 1; higher: good likelier) and predicted (1 from 0.5).

    A map over the rows.  A null text counts as empty; both get the score that the calibration gives to no bytes.
    Equal texts get equal scores.  Other columns are left out, so a clash of names is no matter.
    """
    require(docs, id_col, text_col, *keep)
    kept = [c for c in dict.fromkeys((id_col, *keep)) if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, 512):
            texts = part.column(len(kept)).to_pylist()
            if model.weights:
                x = np.array([difference(t, model.good, model.bad) for t in texts]).reshape(-1, 1)
                p = 1 / (1 + np.exp(-np.clip(expand(x, model.mean, model.scale) @ np.array(model.weights), -30, 30)))
            else:
                p = np.full(len(texts), model.constant)
            yield {c: part.column(k) for k, c in enumerate(kept)} | {"score": p, "predicted": (p >= 0.5).astype("int32")}

    return map_batches(docs.select(*kept, F.col(text_col).cast("string").alias(fresh(kept, "_text"))), run, schema)


def op5_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op5_compression_quality": op5_compression_quality}
ORACLES: dict[str, str] = {}
