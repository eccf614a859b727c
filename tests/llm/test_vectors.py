"""The two searches against brute force."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from recallspark.llm import ann, maxscore

SF = "/root/testdata/sf0.01"


def odd_rows(dim=16, n=300, seed=1):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1) for _ in range(dim)]) for k in range(n)]
    rows += [(1000 + k, list(rows[0][1])) for k in range(40)]  # copies of one vector
    rows += [(2000, None), (2001, [0.0] * dim), (2002, [1.0] * (dim - 1) + [None]), (2003, [float("nan")] * dim), (2004, [math.inf] + [0.0] * (dim - 1)), (2005, []), (2006, [1.0, 2.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0.1) for k, v in rows], "vec_id long, embedding array<double>, score double")


def good(v, zero=False):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_one_bit_codes_recall(spark):
    rows = ann.op2_one_bit_codes(spark, SF).collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    assert set(found) == {k for k in v if k % 100 == 0}
    for q, own in found.items():
        best = sorted((float(np.sqrt(((v[k] - v[q]) ** 2).sum())), k) for k in v if k != q)[:10]
        assert sorted(own) == list(range(1, 11))
        assert all(abs(s - float(np.sqrt(((v[k] - v[q]) ** 2).sum()))) < 1e-12 for k, s in own.values())
        assert [own[i] for i in sorted(own)] == sorted(own.values(), key=lambda x: (x[1], x[0]))
        hit += len({k for _, k in best} & {k for k, _ in own.values()})
    assert hit >= 0.9 * 10 * len(found)


def test_one_bit_codes_edge_cases(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    got = {}
    for r in ann.nearest(df.where("vec_id % 10 = 0"), df, k=12, width=6.0, block_rows=50, query_rows=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = {k: np.array(x) for k, x in rows if good(x)}
    for q in [k for k in v if k % 10 == 0 and k < 2000]:
        best = sorted((float(np.sqrt(((v[k] - v[q]) ** 2).sum())), k) for k in v if k != q and len(v[k]) == 16)[:12]
        assert [(k, round(s, 9)) for _, k, s in sorted(got[q])] == [(k, round(d, 9)) for d, k in best]
    assert not {2000, 2001, 2002, 2003, 2004, 2005} & set(got)
    few = frame(spark, rows[:3])
    assert ann.nearest(few, few, k=10).count() == 6
    assert ann.nearest(df.limit(0), df, k=3).count() == ann.nearest(df, df.limit(0), k=3).count() == 0


def test_maxscore_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = maxscore.op7_maxscore(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(maxscore.ORACLES["op7_maxscore"]).fetchall())


def test_maxscore_edge_cases(spark):
    rows = odd_rows()
    items = maxscore.quantised(frame(spark, rows))
    got = {}
    for r in maxscore.top_k(items.where("vec_id % 7 = 0"), items, k=9, shard_rows=40, query_rows=11).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = {k: [math.floor(256 * x) for x in x] for k, x in rows if good(x, zero=True)}
    for q in [k for k in v if k % 7 == 0]:
        best = sorted((-sum(a * b for a, b in zip(v[q], v[k])), k) for k in v if k != q)[:9]  # a missing component counts as 0
        assert [(k, -s) for s, k in best] == [(k, s) for _, k, s in sorted(got[q])]
    assert 2002 not in got and 2003 not in got
    big = spark.createDataFrame([(k, [10**8 * (k + 1), -(10**8)]) for k in range(20)], "vec_id long, vector array<bigint>")
    top = maxscore.top_k(big.where("vec_id = 3"), big, k=2, shard_rows=8).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in top) == [(1, 19, 81 * 10**16), (2, 18, 77 * 10**16)]
    assert maxscore.top_k(items.limit(0), items).count() == maxscore.top_k(items, items.limit(0)).count() == 0
    assert items.where(F.col("vec_id") == 2001).count() == 1


def test_scores_beyond_a_long(spark):
    rows = [(1, [1e12, 3e8]), (2, [3e8, 1e12]), (3, [1e30, -1.0]), (4, [-1e30, 5.0]), (5, [2.0, 1.0]), (6, [2.0, 1.0])]
    items = maxscore.quantised(frame(spark, rows))
    low, high = -(2**63), 2**63 - 1
    v = {k: [min(max(math.floor(256 * x), low), high) for x in own] for k, own in rows}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(items, items, k=5, shard_rows=2).collect()}
    for q in v:
        best = sorted((-min(max(sum(a * b for a, b in zip(v[q], v[k])), low), high), k) for k in v if k != q)
        assert [got[q, i + 1] for i in range(5)] == [(k, -s) for s, k in best]


def test_one_very_long_vector_and_many_lengths(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(1 + k % 40)]) for k in range(200)] + [(999, [1.0] * 1_000_000)]
    df = frame(spark, rows)
    near = ann.nearest(df.where("vec_id % 50 = 0"), df, k=3, width=6.0)
    got = {(x.query_id, x.rank): (x.vec_id, round(x.score, 9)) for x in near.collect()}
    for q in (0, 50, 100, 150):
        v = np.array(rows[q][1])
        best = sorted((round(float(np.sqrt(((np.array(x) - v) ** 2).sum())), 9), k) for k, x in rows[:200] if k != q and len(x) == len(v))[:3]
        assert [got[q, i + 1] for i in range(len(best))] == [(k, d) for d, k in best]
    items = maxscore.quantised(df)
    top = {(x.query_id, x.rank): (x.vec_id, x.score) for x in maxscore.top_k(items.where("vec_id % 50 = 0"), items, k=4).collect()}
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[k])), k) for k in whole if k != q)[:4]
        assert [top[q, i + 1] for i in range(4)] == [(k, -s) for s, k in best]


def test_repeated_ids_are_asked_once_and_found_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, -1.0])]
    df = frame(spark, rows)
    near = ann.nearest(df.where("vec_id = 3"), df, k=10)
    assert sorted((x.rank, x.vec_id) for x in near.collect()) == [(1, 1), (2, 2), (3, 2), (4, 1)]
    items = maxscore.quantised(df)
    assert [x.vec_id for x in maxscore.top_k(items.where("vec_id = 3"), items, k=10).orderBy("rank").collect()] == [1, 2, 2, 1]
