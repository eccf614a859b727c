"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from recallspark.llm._common import fold, fresh, map_batches, require, slices, table

#: Hashed n-grams of 1 to ORDER characters.
BITS, ORDER = 15, 3
SIZE = 1 << BITS
#: At most so many learning rows of each language fit the model; the last fifth of them sets the temperature.
SAMPLE_ROWS = 600
#: The follow-the-regularised-leader step sizes and the elastic net.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
UNKNOWN = "und"
_SPREAD = 1 << 30
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...] = ()
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None  # SIZE + 1 rows (the last is the bias), a column for each language
    temperature: float = 1.0


def letters() -> np.ndarray:
    """Which code points are letters; built once in each Python worker."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a whole text and their counts; None if it has no letter.  All but letters counts as one blank."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
    codes = np.concatenate([np.array([32], np.uint64), codes, np.array([32], np.uint64)]) if is_letter[-1] else np.concatenate([np.array([32], np.uint64), codes])
    counts = np.zeros(SIZE, np.int64)
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        if len(codes) <= n:
            break
        rolling = (rolling[: len(codes) - n] + codes[n:]) * _SALT[n]
        counts += np.bincount((rolling >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    index = np.flatnonzero(counts)
    return index, counts[index]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """TF-IDF of a text, of length 1."""
    found = grams(text)
    if found is None:
        return None
    index, counts = found
    value = (1 + np.log(counts)) * idf[index]
    norm = np.sqrt((value * value).sum())
    return (index, value / norm) if norm else (index, value)


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each hashed n-gram stands, over all of docs, and how many documents have a letter."""
    schema = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE + 1, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 512)):
            for text in batch.column(0).to_pylist():
                if (found := grams(text)) is not None:
                    seen[found[0]] += 1
                    seen[SIZE] += 1
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(seen[index], pa.int64())], names=["gram", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for gram, n in docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("gram").agg(F.sum("n")).collect():  # at most SIZE + 1 rows
        out[gram] = n
    return out[:SIZE], int(out[SIZE])


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, k: int) -> np.ndarray:
    """Weights by FTRL-proximal with an elastic net: one row at a time, a rate for each weight, exact zeros."""
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))

    def weights(index: np.ndarray) -> np.ndarray:
        own = z[index]
        return -np.sign(own) * np.maximum(np.abs(own) - L1, 0) / ((BETA + np.sqrt(n[index])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            index, value = np.append(rows[r][0], SIZE), np.append(rows[r][1], 1.0)
            w = weights(index)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[r]] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(np.arange(SIZE + 1))


def calibrate(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(target):
        return 1.0

    def loss(t: float) -> float:
        own = logits / np.exp(t)
        own = own - own.max(1, keepdims=True)
        return float((np.log(np.exp(own).sum(1)) - own[np.arange(len(target)), target]).mean())

    low, high, ratio = np.log(0.05), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Document frequencies from all of docs; weights from a bounded sample, the first rows of each language by a hash of the id.

    Rows without a language or without a letter teach nothing.  Without any learning row the model knows no language,
    and all predictions are "und".
    """
    require(docs, id_col, text_col, lang_col)
    own = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(_SPREAD)).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    seen, n = document_counts(own, "_text")
    idf = np.log((1 + n) / (1 + seen)) + 1
    counts = {r._lang: r.n for r in own.groupBy("_lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model()
    # Only rows whose hash is among the smallest of their language travel: about 4 * sample_rows of each, whatever its share.
    reach = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(_SPREAD, 4 * sample_rows * _SPREAD // n))])
    first = W.Window.partitionBy("_lang").orderBy("_h", F.xxhash64("_text"))
    sample = own.where((F.col("_h") < reach[F.col("_lang")]) & F.col("_text").rlike(r"\p{L}")).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample_rows)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("index", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            got = [(lang, rank, vector(text, idf)) for lang, rank, text in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            got = [(lang, rank, v) for lang, rank, v in got if v is not None]
            yield {"lang": [x[0] for x in got], "rank": [x[1] for x in got], "index": [x[2][0].astype("<u2").tobytes() for x in got], "value": [x[2][1].astype("<f4").tobytes() for x in got]}

    rows = sorted(map_batches(sample.select("_lang", "_rank", "_text"), run, schema).collect(), key=lambda r: (r.rank, r.lang))  # at most sample_rows of each language
    languages = tuple(sorted({r.lang for r in rows}))
    if not languages:
        return Model()
    vectors = [(np.frombuffer(r["index"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in rows]
    target = np.array([languages.index(r.lang) for r in rows])
    cut = len(rows) - len(rows) // 5
    weights = follow_the_leader(vectors[:cut], target[:cut], len(languages))
    logits = np.array([v @ weights[i] + weights[SIZE] for i, v in vectors[cut:]]).reshape(-1, len(languages))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), calibrate(logits, target[cut:]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of `keep`, lang_pred and score (the calibrated probability of lang_pred) of every whole text.

    A map over the rows.  A null or empty text, and one without any letter, is "und" with score 0.  Ties go to the
    language that sorts first.  Other columns are left out, so a clash of names is no matter.
    """
    require(docs, id_col, text_col, *keep)
    kept = [c for c in dict.fromkeys((id_col, *keep)) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def one(text: str | None) -> tuple[str, float]:
        found = vector(text, model.idf) if model.languages else None
        if found is None:
            return UNKNOWN, 0.0
        logits = (found[1] @ model.weights[found[0]] + model.weights[SIZE]) / model.temperature
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        return model.languages[k], float(min(1.0, p[k] / p.sum()))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, 512):
            got = [one(x) for x in part.column(len(kept)).to_pylist()]
            yield {c: part.column(k) for k, c in enumerate(kept)} | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    return map_batches(docs.select(*kept, F.col(text_col).cast("string").alias(fresh(kept, "_text"))), run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
