"""The index in files against plain BM25, as it grows and shrinks."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallspark.operators import bm25


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def plain(queries, docs, k):
    """docs: rows (id, text); the scores of all documents that hold all words."""
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    mean, df = sum(s for *_, s in own) / len(own), Counter(w for _, c, _ in own for w in c)
    out = {}
    for q, text in queries:
        need = set(words(text))
        hits = []
        for i, c, s in own:
            if need and all(w in c for w in need):
                hits.append((round(sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * s / mean)) for w in need), 5), i))
        out[q] = [i for _, i in sorted(hits, key=lambda x: (-x[0], x[1]))[:k]], [s for s, _ in sorted(hits, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def found(spark, queries, path, k):
    out = {q: ([], []) for q, _ in queries}
    for r in sorted(bm25.search(spark.createDataFrame(queries, "qid int, text string"), path, k).collect(), key=lambda r: (r.qid, r.rank)):
        out[r.qid][0].append(r.id)
        out[r.qid][1].append(r.score)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert got[q][1] == pytest.approx(want[q][1], abs=2e-5), q
        sure = [k for k, s in enumerate(want[q][1]) if all(abs(s - o) > 1e-4 for j, o in enumerate(want[q][1]) if j != k)][:-1]
        assert [got[q][0][k] for k in sure] == [want[q][0][k] for k in sure], q


def corpus(n=1200, seed=2):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["common"]
    return [(k, " ".join([*(["Common"] * r.randrange(1, 4)), *r.choices(vocabulary, weights=[1 / (j + 1) for j in range(61)], k=r.randrange(3, 40))])) for k in range(n)]


QUERIES = [(1, "common"), (2, "common w0"), (3, "w3 W7 common"), (4, "w50 w1"), (5, "absent w1"), (6, ""), (7, None), (8, "w20 w20"), (9, "w59 w58 w57")]


def test_grows_and_shrinks(spark, tmp_path):
    path, docs = str(tmp_path / "index"), corpus()
    docs += [(5000, ""), (5001, None), (5002, "w1, w1; w1!")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    bm25.build(frame(docs[:700]), path, buckets=8)
    same(found(spark, QUERIES, path, 10), plain(QUERIES, docs[:700], 10))
    bm25.append(frame(docs[700:]), path)
    same(found(spark, QUERIES, path, 10), plain(QUERIES, docs, 10))
    assert {r.term: (r.df, r.max_tf) for r in bm25.terms(spark, path).collect()} == {w: (sum(w in words(t) for _, t in docs), max(Counter(words(t))[w] for _, t in docs)) for w in {x for _, t in docs for x in words(t)}}
    bm25.remove(frame([(k, "") for k in range(0, 1200, 3)] + [(99_999, "")]), path)
    left = [x for x in docs if not (x[0] < 1200 and x[0] % 3 == 0)]
    same(found(spark, QUERIES, path, 10), plain(QUERIES, left, 10))
    bm25.upsert(frame([(1, "w59 w58 w57"), (0, "again common")]), path)
    left = [x for x in left if x[0] != 1] + [(1, "w59 w58 w57"), (0, "again common")]
    same(found(spark, QUERIES, path, 10), plain(QUERIES, left, 10))
    assert {r.term: r.df for r in bm25.terms(spark, path).where("term = 'again' or term = 'w59'").collect()} == {"again": 1, "w59": sum("w59" in words(t) for _, t in left)}


def test_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    path = bm25.build(spark.createDataFrame(corpus(), "id long, text string"), str(tmp_path / "index"), buckets=16)
    wanted = {r.b for r in spark.createDataFrame([("w3",), ("w4",)], "term string").select(bm25._bucket("term", 16).alias("b")).collect()}
    one = bm25._live(spark, path, bm25.log(spark, path), "postings", sorted(wanted))
    assert {int(re.search(r"bucket=(\d+)", r[0])[1]) for r in one.select(F.input_file_name()).distinct().collect()} == wanted
    plan = bm25.search(spark.createDataFrame([(1, "w3 w4")], "qid int, text string"), path, 3)._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert scans and all(set(map(int, (x or y).split(","))) == wanted for x, y in scans)


def test_blocks_that_cannot_win_are_left(spark, tmp_path):
    path = bm25.build(spark.createDataFrame([(k, ("rare " if k < 6000 else "none ") + "other " * (k % 300)) for k in range(30_000)], "id long, text string"), str(tmp_path / "index"), buckets=2)
    got = bm25.search(spark.createDataFrame([(1, "rare")], "qid int, text string"), path, 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [0, 300, 600, 900, 1200]
    blocks = bm25._live(spark, path, bm25.log(spark, path), "blocks").where("term = 'rare'")
    assert blocks.agg(F.count_distinct("min_size")).first()[0] > 20  # the best come first


def test_failed_and_empty_builds(spark, tmp_path):
    path = str(tmp_path / "index")
    empty = spark.createDataFrame([], "id long, text string")
    assert found(spark, QUERIES, bm25.build(empty, path), 3) == {q: ([], []) for q, _ in QUERIES}
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string")
    docs.write.parquet(f"{path}/postings/generation=broken")  # a job that did not come to its commit
    bm25.append(docs, path)
    assert found(spark, [(1, "b"), (2, "a b")], path, 3) == {1: ([2, 1], pytest.approx([0.2, 0.2], abs=0.1)), 2: ([1], pytest.approx([0.8], abs=0.3))}
    with pytest.raises(ValueError, match="append"):
        bm25.build(docs, path)


def test_each_file_has_a_task_of_its_own_and_each_block_a_row(spark, tmp_path):
    docs = corpus()
    path = bm25.build(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "index"), buckets=16)
    own = bm25._live(spark, path, bm25.log(spark, path), "postings")
    files = [re.search(r"bucket=(\d+)/part-(\d+)", r[0]).groups() for r in own.select(F.input_file_name()).distinct().collect()]
    assert len({part for _, part in files}) == len(files) == len({bucket for bucket, _ in files})
    df = Counter(w for _, t in docs for w in set(words(t)))
    rows = own.select("term", "n", F.size("id").alias("ids"), (F.array_min("size") == F.col("min_size")).alias("size"), (F.array_max("tf") == F.col("max_tf")).alias("tf")).collect()
    assert all(r.n == r.ids <= bm25.BLOCK and r.size and r.tf for r in rows)
    assert Counter(r.term for r in rows) == {w: -(-n // bm25.BLOCK) for w, n in df.items()}


def test_small_runs_and_files(spark, tmp_path, monkeypatch):
    for name, value in (("RUN", 300), ("SORTED", 40), ("FILE", 700)):
        monkeypatch.setattr(bm25, name, value)
    docs = [*corpus(400), (900, ""), (901, None), (902, "...w1 w2? ")]
    path = bm25.build(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "index"), buckets=2)
    assert len({r[0] for r in bm25._live(spark, path, bm25.log(spark, path), "postings").select(F.input_file_name()).distinct().collect()}) > 4
    same(found(spark, QUERIES, path, 10), plain(QUERIES, docs, 10))
    named = [(f"d{k:04}", t) for k, t in docs]
    other = bm25.build(spark.createDataFrame([*named, (None, "w1 w2")], "id string, text string"), str(tmp_path / "named"), buckets=2)
    got = found(spark, [(3, "w3 W7 common")], other, 5)
    assert got[3][0] and set(got[3][0]) <= {i for i, t in named if {"w3", "w7", "common"} <= set(words(t))}


def test_a_search_reads_its_postings_from_the_index_once_more_only(spark, tmp_path):
    path = bm25.build(spark.createDataFrame(corpus(), "id long, text string"), str(tmp_path / "index"), buckets=4)
    plan = bm25.search(spark.createDataFrame([(1, "w3 w4")], "qid int, text string"), path, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*generation#\d+,bucket#\d+", plan)) == 1


ODD = [None, "", " ", "a-b_c  D", "İstanbul ΑΣ Σ x²½ ⅷ ǅ ß", "日本語 テスト。é, é!", "x y　z w", "😀 1٢3 " * 50, "Éa èB." * 300]


def test_words_are_those_of_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(bm25, "PIECE", 7)
    docs = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").select("id", F.coalesce("text", F.lit("")).alias("body"))
    want = docs.select("id", F.split(F.lower("body"), r"[^\p{L}\p{N}]+").alias("w")).select("id", F.filter("w", lambda w: w != "").alias("w"))
    want = {r.id: r.w for r in want.collect()}
    assert {r.id: r.size for r in bm25._sizes(docs).collect()} == {i: len(w) for i, w in want.items()}
    assert {i: [x.decode() for x in bm25._words((t or "").encode()).split()] for i, t in enumerate(ODD)} == want
    asked = bm25._asked(docs.select(F.col("id").alias("qid"), F.col("body").alias("text"))).collect()
    assert sorted((r.qid, r.term) for r in asked) == sorted((i, x) for i, w in want.items() for x in set(w))


def test_lists_of_many_terms_are_one_row(spark):
    docs = spark.createDataFrame([(k, f"own{k} common") for k in range(2000)], "id long, body string").coalesce(1).withColumn("file", (F.col("id") % 2).cast("int"))
    rows = bm25._lists(docs, 2, 4, 3).collect()
    assert len(rows) == len({(r.place, r.part) for r in rows}) <= 2 * 4 * 3
    assert {r.place % 2 for r in rows} == {0, 1} and {r.place // 2 for r in rows} == {0, 1, 2, 3}


def test_memories_are_not_written_before_they_are_indexed(spark, monkeypatch):
    from recallspark.plans import memories

    monkeypatch.setattr(memories, "saved", lambda df, name: pytest.fail(f"{name} are written"))
    path = memories._superseded(spark, "/root/testdata/sf0.001")
    assert [r.kind for r in bm25.log(spark, path)] == ["append", "remove"]
