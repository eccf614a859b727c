"""From raw documents to packed training sequences: five stages, each of which works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import language, packing, pii, quality
from recallspark.llm._common import fold, saved, table
from recallspark.llm.ngram_join import first_rows

#: A document stays if its quality score and the probability of its language are at least so high.  Quality weighs good and bad the same; as most documents are good, only
#: those go that are bad six times as likely.
QUALITY, LANGUAGE = 0.15, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier scores as bad; it learns from the labels outside the held-out fold."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    scored = quality.score(docs.withColumn("_text", F.col("text")), model, text_col="_text", keep=tuple(docs.columns))
    return scored.where(F.col("score") >= QUALITY).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or no language that is likely enough."""
    model = language.train(docs.where(fold("doc_id", 4) != 2))
    found = language.predict(docs.withColumn("_text", F.col("text")), model, text_col="_text", keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents and repeated rows, keep one row: the one with the smallest id, null ids last."""
    return first_rows(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and terms that disclose it; n_chars follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", remove_personal_data),
    ("packing", pack_sequences),
]
#: Classifiers, near copies and tokens are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
