"""Whitening against numpy over all rows at once."""

import math

import numpy as np
import pytest

from recallspark.llm import whitening

SF = "/root/testdata/sf0.01"


def plain(rows, kept=8):
    """{row: (deviation, whitened)}, the explained shares and the dimension, of rows (id, vector)."""
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in good)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dim - len(v)) for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    kept = min(kept, int((value > value[0] * 1e-12).sum()))
    return [k for k, _ in good], deviation, centred @ vector[:, :kept] / np.sqrt(value[:kept]), value[:kept] / value.sum()


def check(got, rows):
    ids, deviation, white, share = plain(rows)
    assert len(got) == white.size and {r.n for r in got} == {len(ids)}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error <= 1e-9
    for c in range(white.shape[1]):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, deviation[k]))
        assert [(r.vec_id, int(r.deviation)) for r in own] == [(ids[k], deviation[k]) for k in order]
        assert all(math.isclose(r.explained, share[c], rel_tol=1e-9) for r in own)
        a, b = np.array([r.whitened for r in own]), white[order, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0.5) for k, v in rows], "vec_id long, embedding array<double>, whitened double").repartition(3)


def test_whole_table_equals_numpy(spark):
    got = whitening.op13_whitening(spark, SF).collect()
    check(got, [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    assert whitening.op13_whitening(spark, SF).schema["deviation"].dataType.simpleString() == "bigint"


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)  # many blocks and many ranges of them
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    r = np.random.default_rng(4)
    rows = [(k, (r.standard_normal(12) * np.arange(1, 13)).tolist()) for k in range(500)] + [(3, [1.0] * 12)] * 5
    bad = [(900, None), (901, [1.0, None]), (902, [math.nan] * 12), (903, [math.inf] * 12)]
    rows += [(904, [0.5] * 5), (905, []), (906, [0.0] * 12), (None, [2.0] * 12), (None, [3.0] * 12)]
    check(whitening.whiten(frame(spark, rows + bad)).collect(), rows)


def test_few_components_and_rows(spark):
    two = [(k, [float(k), float(k * k % 7)]) for k in range(20)]
    check(whitening.whiten(frame(spark, two)).collect(), two)
    flat = [(k, [float(k), 2.0, 3.0]) for k in range(20)]
    assert {r.component for r in whitening.whiten(frame(spark, flat)).collect()} == {1}
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    with pytest.raises(ValueError, match="components"):
        whitening.whiten(frame(spark, [(1, [0.0] * 9000)]))
