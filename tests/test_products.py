"""Sums of products over what queries and rows share, against plain loops."""

import random

from recallspark.operators import products, retrieval


def landed(active, mentions, memories, queries, k):
    out = {}
    where, asked = {m: (s, p) for m, s, p in memories}, {q: (s, p) for q, s, p in queries}
    for q in asked:
        sums = {}
        for x, tag, a in active:
            for m, t, r in mentions if x == q else ():
                if t == tag:
                    sums[m] = sums.get(m, 0.0) + a * r
        boost = lambda m: (1.2 if where[m][0] is not None and where[m][0] == asked[q][0] else 1.0) * (1.35 if where[m][1] is not None and where[m][1] == asked[q][1] else 1.0)
        out[q] = [(m, s) for s, m in sorted((-round(s * boost(m), 9), m) for m, s in sums.items() if m in where)[:k]]
    return out


def test_landing_in_blocks(spark, monkeypatch):
    for name, value in (("WEIGHTS", 30), ("ROWS", 60), ("CELLS", 400)):
        monkeypatch.setattr(products, name, value)
    r = random.Random(4)
    for low in (1, -3):  # without and with weights that are not positive
        queries = [(q, r.choice([None, "s1", "s2"]), r.choice([None, 1, 2])) for q in range(12)]
        memories = [(m, r.choice([None, "s1", "s2", "s3"]), r.choice([None, 1, 2, 3])) for m in range(400)]
        mentions = [(m, f"t{t}", r.randrange(low, 4) / 4) for m in range(390) for t in r.sample(range(9), r.randrange(0, 4))]
        active = [(q, f"t{t}", r.randrange(low, 5) / 8) for q in range(11) for t in r.sample(range(9), r.randrange(1, 6))]
        got = {q: [] for q, *_ in queries}
        frames = spark.createDataFrame(active, "qid long, tag string, activation double"), spark.createDataFrame(mentions, "memory_id long, tag string, relevance double"), spark.createDataFrame(memories, "id long, session_id string, space_id long"), spark.createDataFrame(queries, "qid long, session_id string, space_id long")
        out = retrieval.landing(*frames, 7)
        for x in sorted(out.collect(), key=lambda x: (x.qid, x.rank)):
            got[x.qid].append((x.id, -x.score))
        assert got == {q: [(m, round(s, 9)) for m, s in rows] for q, rows in landed(active, mentions, memories, queries, 7).items()}


def test_pairs_are_not_shuffled(spark):
    one = spark.range(300).selectExpr("id AS qid", "'t' AS tag", "1.0D AS activation")
    mentions = spark.range(3000).selectExpr("id AS memory_id", "'t' AS tag", "0.5D + id / 1e6 AS relevance")
    memories, queries = spark.range(3000).selectExpr("id", "id AS session_id", "1L AS space_id"), spark.range(300).selectExpr("id AS qid", "id AS session_id", "1L AS space_id")
    met = []
    top = products.landing(one, mentions, memories, queries, 5)
    met.append(top.count())
    terms = spark.range(300).selectExpr("id AS qid", "explode(array('a', concat('b', id % 3))) AS term")
    postings = spark.range(3000).selectExpr("explode(array('a', concat('b', id % 3))) AS term", "id", "id / 1e4 AS part")
    words = products.conjunctions(terms, postings, 5)
    assert met == [1500] and {(x.qid, x.rank): x.id for x in words.collect()} == {(q, n + 1): 2999 - (2999 - q) % 3 - 3 * n for q in range(300) for n in range(5)}
    for frame in (top, words):  # no join of queries with rows by a tag or a word
        assert "tag#" not in "".join(x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_conjunctions(spark, monkeypatch):
    monkeypatch.setattr(products, "ROWS", 5)
    monkeypatch.setattr(products, "SETS", 3)
    r = random.Random(6)
    docs = {d: {w: r.randrange(1, 5) / 3 for w in r.sample("abcdef", r.randrange(0, 6))} for d in range(120)}
    asked = {q: r.sample("abcdefz", r.randrange(1, 4)) for q in range(20)}
    got = {}
    out = products.conjunctions(spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "qid long, term string"), spark.createDataFrame([(w, d, p) for d, ws in docs.items() for w, p in ws.items()], "term string, id long, part double"), 4)
    for x in sorted(out.collect(), key=lambda x: (x.qid, x.rank)):
        got.setdefault(x.qid, []).append((x.id, x.score))
    want = {q: sorted(((d, round(sum(ws[w] for w in words), 6)) for d, ws in docs.items() if set(words) <= set(ws)), key=lambda x: (-x[1], x[0]))[:4] for q, words in asked.items()}
    assert got == {q: rows for q, rows in want.items() if rows}
