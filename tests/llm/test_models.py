"""Quality and language: held-out accuracy and edge cases."""

import math
from collections import defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from recallspark.llm import language, quality

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "12 34 !!", "the", "the", "x" * 200_000, "\U0001f600" * 50]


def odd(spark):
    return spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(ODD)], "doc_id long, text string, score double")


def test_quality_on_held_out_rows(spark):
    rows = quality.op5_compression_quality(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count()
    held = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_quality_edge_cases(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.unionByName(labels.select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic").where("doc_id % 50 = 0")), dictionary_rows=100, calibration_rows=200)
    got = {r.doc_id: r.score for r in quality.score(odd(spark), model).collect()}
    assert got[0] == got[1] and got[4] == got[5] and all(0 <= s <= 1 for s in got.values())
    for some, want in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        assert {r.score for r in quality.score(odd(spark), quality.train(docs, some)).collect()} == {want}
    few = quality.train(docs, labels.where("doc_id < 80"))
    assert quality.score(odd(spark), few).count() == len(ODD)
    assert quality.score(odd(spark).limit(0), few).collect() == []


def plain_difference(text, good, bad):
    """The normalised difference as it is defined, with compressors of its own."""
    def size(data, dictionary):
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    data = (text or "").encode()
    pieces = [data[k : k + quality.PIECE] for k in range(0, max(1, len(data)), quality.PIECE)]
    return (sum(size(x, bad) for x in pieces) - sum(size(x, good) for x in pieces)) / (len(data) + 8)


def test_scores_equal_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, dictionary_rows=100, calibration_rows=200)
    some = docs.where("doc_id < 60").unionByName(odd(spark).select("doc_id", "text"), allowMissingColumns=True)
    texts = [r.text for r in some.select("doc_id", "text").collect()]
    got = sorted(r.score for r in quality.score(some, model).collect())
    want = []
    for t in texts:
        z = max(-6, min(6, (plain_difference(t, model.good, model.bad) - model.mean[0]) / model.scale[0]))
        want.append(1 / (1 + math.exp(-max(-30, min(30, model.weights[0] + model.weights[1] * z)))))
    assert np.allclose(got, sorted(want), atol=1e-6)


def test_calibration_ends_at_the_minimum():
    r = np.random.default_rng(4)
    for parted in (False, True):
        x = r.standard_normal((900, 5))
        y = (x[:, 0] > 0).astype(float) if parted else (x[:, 0] + r.standard_normal(900) > 0).astype(float)
        mean, scale, w = quality.calibrate(x, y)
        a = quality.expand(x, mean, scale)
        best = quality.loss(np.array(w), a, y)
        for k in range(len(w)):
            for step in (-0.05, 0.05):
                other = np.array(w)
                other[k] += step
                assert quality.loss(other, a, y) > best
        p = 1 / (1 + np.exp(-a @ np.array(w)))
        assert ((p > 0.5) == y).mean() > (0.97 if parted else 0.7) and np.abs(w).max() < 100


def test_quality_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op5_compression_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for label in (0, 1):
        own = [r.predicted == label for r in rows if r.quality == label]
        assert sum(own) >= 0.95 * len(own)


def plain_weights(rows, target, k):
    """FTRL on dicts, weight by weight."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= language.L1:
            return 0.0
        return -math.copysign(abs(z[i, c]) - language.L1, z[i, c]) / ((language.BETA + math.sqrt(n[i, c])) / language.ALPHA + language.L2)

    order = np.random.default_rng(7)
    for _ in range(language.EPOCHS):
        for r in order.permutation(len(rows)):
            own = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)), language.SIZE: 1.0}
            w = {(i, c): weight(i, c) for i in own for c in range(k)}
            logits = [sum(v * w[i, c] for i, v in own.items()) for c in range(k)]
            e = [math.exp(x - max(logits)) for x in logits]
            for c in range(k):
                p = e[c] / sum(e) - (c == target[r])
                for i, v in own.items():
                    g = v * p
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / language.ALPHA
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    return {x: weight(*x) for x in z}


def test_ftrl_equals_a_plain_version():
    texts = ["the cat and the dog", "der hund und die katze", "the house", "das haus und der garten", "a dog", "ein hund"]
    idf = np.ones(language.SIZE)
    rows = [language.vector(t, idf) for t in texts]
    target = np.array([0, 1, 0, 1, 0, 1])
    got = language.follow_the_leader(rows, target, 2)
    want = plain_weights(rows, target.tolist(), 2)
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values()) > 0
    for (i, c), w in want.items():
        assert abs(got[i, c] - w) < 1e-9


def test_language_ties_and_repeated_rows(spark):
    model = language.Model(("aa", "bb"), np.ones(language.SIZE, np.float32), np.zeros((language.SIZE + 1, 2), np.float32), 1.0)
    df = spark.createDataFrame([(1, "some text", "x"), (1, "some text", "x"), (None, "some text", "y")], "doc_id long, text string, lang_pred string")
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.predict(df, model).collect()) == [("1", "aa", 0.5), ("1", "aa", 0.5), ("None", "aa", 0.5)]
    kept = language.predict(df.withColumn("_text", F.lit("clash")), model, keep=("_text",)).collect()
    assert {r["_text"] for r in kept} == {"clash"} and {r.lang_pred for r in kept} == {"aa"}


def test_language_on_held_out_rows(spark):
    rows = language.op8_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count()
    held = rows.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("lang")))
    model = language.train(docs, sample_rows=50)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd(spark), model).collect()}
    assert got[0] == got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[4] == got[5] and got[4][0] in model.languages and 0 <= got[6][1] <= 1
    nothing = language.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language.predict(odd(spark), nothing).collect()} == {"und"}
    assert language.predict(odd(spark).limit(0), model).collect() == []
