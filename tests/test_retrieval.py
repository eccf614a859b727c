"""Vector searches and joins against plain loops, with unusable, ragged and repeated vectors."""

import contextlib
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recallspark.operators import persona, retrieval, similar


def rows(seed=1, n=150, dim=8):
    r = random.Random(seed)

    def unit():
        v = [r.gauss(0, 1) for _ in range(dim)]
        return [x / math.sqrt(sum(y * y for y in v)) for x in v]

    out = [(k, unit()) for k in range(n)]
    out += [(1000 + k, list(out[3][1])) for k in range(25)]  # copies of one vector
    out += [(1100 + k, [x * (1 - 0.01 * k) for x in out[3][1]]) for k in range(1, 4)]  # and vectors near it
    out += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * (dim - 2)), (2003, [math.nan] * dim), (2004, [math.inf] + [0.0] * (dim - 1)), (2005, [1.0, 0.0]), (2006, [0.5, 0.5]), (None, [1.0] * dim)]
    return out


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return round(sum(x * y for x, y in zip(a, b, strict=True)), 9)


def frame(spark, data, key="id"):
    return spark.createDataFrame(data, f"{key} long, vec array<double>")


@pytest.mark.parametrize("least", [None, 0.4])
@pytest.mark.parametrize("broadcast", [0, retrieval.BROADCAST])
def test_topk(spark, least, broadcast, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD", 50)
    data = rows()
    v = {k: x for k, x in data if k is not None and good(x)}
    queries = frame(spark, [(k, x) for k, x in data if k is None or k % 7 == 0 or k >= 2000], "qid")
    got = {}
    for r in retrieval.vector_topk(queries, frame(spark, data), 6, least, query_rows=9, item_rows=40, broadcast=broadcast).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    for q in [k for k in v if k % 7 == 0 or k >= 2000]:
        best = sorted((-dot(v[q], x), k) for k, x in v.items() if k != q and len(x) == len(v[q]) and (least is None or dot(v[q], x) > least))[:6]
        assert [(k, pytest.approx(-s, abs=2e-9)) for s, k in best] == [(k, s) for _, k, s in sorted(got.get(q, []))], q
    assert set(got) <= set(v)


def test_all_pairs_between_classes_and_their_members(spark):
    data = rows()
    v = {k: x for k, x in data if k is not None and good(x)}
    first = {}
    for k in sorted(v):
        first.setdefault(tuple(v[k]), k)
    assert {(r.id, r.class_id) for r in retrieval.vector_classes(frame(spark, data)).collect()} == {(k, first[tuple(x)]) for k, x in v.items()}
    reps = sorted(first.values())
    want = {(a, b): dot(v[a], v[b]) for i, a in enumerate(reps) for b in reps[i + 1 :] if len(v[a]) == len(v[b]) and dot(v[a], v[b]) > 0.6}
    got = retrieval.similar_pairs(frame(spark, data), 0.6, rows=30).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)


def test_pairs_by_random_projections_find_most(spark):
    r = random.Random(5)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    base = [unit([r.gauss(0, 1) for _ in range(32)]) for _ in range(150)]
    data = [(k, x) for k, x in enumerate(base)] + [(1000 + k, unit([y + r.gauss(0, 0.05) for y in x])) for k, x in enumerate(base)]
    df = frame(spark, data)
    exact = {(x.a, x.b): x.score for x in retrieval.similar_pairs(df, 0.92).collect()}
    found = {(x.a, x.b): x.score for x in retrieval.near_pairs_by_lsh(df, 0.92).collect()}
    assert set(found) <= set(exact) and all(abs(s - exact[p]) < 2e-9 for p, s in found.items())
    assert len(found) >= 0.9 * len(exact) > 100


def test_empty_sides(spark):
    df = frame(spark, rows())
    none = df.limit(0)
    assert retrieval.vector_topk(none.withColumnRenamed("id", "qid"), df).count() == retrieval.vector_topk(df.withColumnRenamed("id", "qid"), none).count() == 0
    assert retrieval.similar_pairs(none, 0.1).count() == retrieval.vector_classes(none).count() == 0


def test_the_sample_of_a_level_is_exact_with_ties(spark):
    r = random.Random(2)
    data = [(k, r.choice([0, 0, 0, 1, 2]), r.choice([0.5, 0.6, 0.7])) for k in range(400)]
    got = {x.id for x in persona.baseline_sample(spark.createDataFrame(data, "id long, signal_level int, confidence double").repartition(7)).collect()}
    low = sorted((-c, k) for k, level, c in data if level == 0)
    assert got == {k for k, level, _ in data if level} | {k for _, k in low[: max(1, len(low) // 5)]}
    one = spark.createDataFrame([(1, 0, 0.1)], "id long, signal_level int, confidence double")
    assert persona.baseline_sample(one).count() == 1 and persona.baseline_sample(one.where(F.lit(False))).count() == 0


def test_new_assertions_merge_with_each_other_in_order(spark):
    r = random.Random(7)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    centres = [unit([r.gauss(0, 1) for _ in range(12)]) for _ in range(5)]
    near = lambda: unit([x + r.gauss(0, 0.11) for x in r.choice(centres)])
    old = [(k, str(k % 2), near(), 0.4, [f"e{k}"], k % 5 == 0, k % 7 == 0) for k in range(1, 8)]
    new = [(100 + k, str(r.randint(0, 1)), near(), r.choice([0.3, 0.6, 0.9]), [f"n{k}"]) for k in range(60)]
    a = spark.createDataFrame(old, "id long, dimension string, vec array<double>, confidence double, evidences array<string>, locked boolean, is_superseded boolean")
    b = spark.createDataFrame(new, "id long, dimension string, vec array<double>, confidence double, evidences array<string>")
    merged, inserted = persona.merge_assertions(a, b)
    state = {k: [d, v, c, list(e), not locked and not gone] for k, d, v, c, e, locked, gone in old}
    fresh = {}
    for k, d, v, c, e in new:
        all_ = [(dot(v, x[1]), i < 100, -i, i) for i, x in {**state, **fresh}.items() if x[0] == d and x[4] and dot(v, x[1]) > 0.88]
        if not all_:
            fresh[k] = [d, v, c, list(e), True]
            continue
        i = max(all_)[3]
        x = (state if i < 100 else fresh)[i]
        x[2], x[3] = min(1.0, max(x[2], c) + 0.03), x[3] + e
    for got, want in ((merged, state), (inserted, fresh)):
        rows_ = {x.id: (round(x.confidence, 9), sorted(x.evidences)) for x in got.collect()}
        assert rows_ == {k: (round(x[2], 9), sorted(x[3])) for k, x in want.items()}
    assert 5 < len(fresh) < 40 and any(len(x[3]) > 2 for x in fresh.values())


def test_items_of_a_broadcast_search_are_not_shuffled(spark):
    data = rows()
    found = retrieval.vector_topk(frame(spark, data[:20], "qid"), frame(spark, data), 6)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan and "Exchange" not in plan  # before exchanges are put in, none was asked for below the search
    below = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert "Exchange" not in below
    alike = spark.createDataFrame([(f"k{k}", x) for k, x in data if k is not None], "id string, vec array<double>")
    both = [sorted(map(tuple, retrieval.vector_topk(alike.where("id like '%7'").withColumnRenamed("id", "qid"), alike, 4, broadcast=b).collect())) for b in (0, retrieval.BROADCAST)]
    assert both[0] == both[1] and both[0]


@pytest.mark.parametrize("approximate", [False, True])
def test_most_similar_of_each(spark, approximate, monkeypatch):
    monkeypatch.setattr(similar, "STRANGERS", 8)
    data = [x for x in rows(n=300) if x[0] is None or x[0] < 2000]
    v = {k: x for k, x in data if k is not None}
    got = {}
    found = similar.top_similar(frame(spark, data), 0.7, 5, approximate)
    for r in found.collect():
        got.setdefault(r.qid, {})[r.rank] = (r.id, r.score)
    want = {q: sorted((-dot(v[q], x), k) for k, x in v.items() if k != q and dot(v[q], x) > 0.7)[:5] for q in v}
    met = sum(len({k for _, k in best} & {k for k, _ in got.get(q, {}).values()}) for q, best in want.items())
    assert met >= (0.97 if approximate else 1) * sum(map(len, want.values())) > 100
    assert all(abs(s - dot(v[q], v[k])) < 2e-9 and k != q for q, own in got.items() for k, s in own.values())
    if not approximate:
        assert {q: [k for _, k in best] for q, best in want.items() if best} == {q: [own[i + 1][0] for i in range(len(own))] for q, own in got.items()}


def test_buckets_of_many_blocks(spark):
    data = [(k, x) for k, x in rows(n=200) if k is not None and k < 1000]
    exact = {(r.qid, r.id) for r in similar.top_similar(frame(spark, data), 0.5, 6).collect()}
    found = {(r.qid, r.id, r.score) for r in similar.bucketed_topk(frame(spark, data), 0.5, 6, recall=0.9999, block=10).collect()}
    assert len(exact & {x[:2] for x in found}) >= 0.98 * len(exact)


def test_topk_within_groups(spark):
    data = [(k, x) for k, x in rows() if k is not None]
    groups = spark.createDataFrame([(k, x, g) for k, x in data for g in ({k % 4, k % 3} if k % 5 else {k % 4})], "id long, vec array<double>, group int")
    asked = groups.where("id % 7 = 0 and group <> 2").withColumnRenamed("id", "qid")
    v, of = {k: x for k, x in data if good(x)}, {}
    for k in v:
        of[k] = {k % 4, k % 3} if k % 5 else {k % 4}
    for size in ({}, {"query_rows": 5, "item_rows": 11}):
        for least in (None, 0.3):
            got = {}
            for r in retrieval.group_topk(asked, groups, 6, least, **size).collect():
                got.setdefault(r.qid, []).append((r.rank, r.id, r.score))
            for q in [k for k in v if k % 7 == 0]:
                best = sorted((-dot(v[q], x), k) for k, x in v.items() if k != q and len(x) == len(v[q]) and (of[q] - {2}) & of[k] and (least is None or dot(v[q], x) > least))[:6]
                assert [(k, pytest.approx(-s, abs=2e-9)) for s, k in best] == [(k, s) for _, k, s in sorted(got.get(q, []))], q
    plan = retrieval.group_topk(asked, groups, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # no pair of a query and a candidate is joined


def test_blocks_of_floats_are_few_and_exact(spark, monkeypatch):
    r = random.Random(2)
    data = [(k, [float(r.randrange(-64, 65)) / 64 for _ in range(8)]) for k in range(300)]  # exact as floats
    v = spark.createDataFrame(data, "id long, vec array<float>")
    assert retrieval._vectors(v, "id").schema["vec"].dataType.elementType.typeName() == "float"
    assert retrieval._blocked(spark.range(200_000).selectExpr("id AS key", "array_repeat(1.0F, 64) AS vec"), None)[1] == 4  # 13 by rows of 16,384
    monkeypatch.setattr(retrieval, "CELLS", 400)
    monkeypatch.setattr(retrieval, "SCORES", 900)
    for least in (1.0, dot(data[0][1], data[1][1])):
        want = {(a, b) for a, x in data for b, y in data if a < b and dot(x, y) > least}
        first = {}
        for k, x in data:
            first.setdefault(tuple(x), k)
        assert {(x.a, x.b) for x in retrieval.similar_pairs(v, least).collect()} == {p for p in want if all(first[tuple(data[k][1])] == k for k in p)}
        found = {(x.qid, x.id) for x in retrieval.vector_topk(v.withColumnRenamed("id", "qid"), v, None, least, broadcast=0).collect()}
        assert {p for p in found if p[0] < p[1]} == want and len(found) == 2 * len(want)


def test_new_assertions_join_within_their_source(spark):
    a = spark.createDataFrame([(1, "d", [0.0, 1.0], 0.5, ["e"], False, False)], "id long, dimension string, vec array<double>, confidence double, evidences array<string>, locked boolean, is_superseded boolean")
    new = [(10, "d", [1.0, 0.0], 0.6, ["n10"], 1), (11, "d", [1.0, 0.0], 0.6, ["n11"], 2), (12, "d", [1.0, 0.01], 0.6, ["n12"], 1), (13, "e", [1.0, 0.0], 0.6, ["n13"], 1)]
    b = spark.createDataFrame(new, "id long, dimension string, vec array<double>, confidence double, evidences array<string>, source long")
    _, inserted = persona.merge_assertions(a, b, within="source")
    assert {r.id: sorted(r.evidences) for r in inserted.collect()} == {10: ["n10", "n12"], 11: ["n11"], 13: ["n13"]}
    _, inserted = persona.merge_assertions(a, b)
    assert {r.id: sorted(r.evidences) for r in inserted.collect()} == {10: ["n10", "n11", "n12"], 13: ["n13"]}


def test_similar_ones_meet_once_and_tell_both_sides(spark, monkeypatch):
    r = random.Random(4)
    data = [(k, [float(r.randrange(-8, 9)) for _ in range(6)]) for k in range(120)]
    v = spark.createDataFrame(data, "id long, vec array<float>")
    monkeypatch.setattr(retrieval, "TILE", (7, 16))
    monkeypatch.setattr(retrieval, "SCORES", 40)
    want = {(q, k) for q, x in data for _, k in sorted((-dot(x, y), k) for k, y in data if k != q and dot(x, y) > 30)[:4]}
    for rows in (None, 25):
        found = retrieval.similar_topk(v, 4, 30.0, rows)
        assert {(x.qid, x.id) for x in found.collect()} == want
        assert all(x.score == dot(data[x.qid][1], data[x.id][1]) for x in found.collect())
    sent = spark.range(400_000).selectExpr("id AS key", "array_repeat(1.0F, 64) AS vec")
    assert retrieval._blocked(sent, None)[1] == 4  # 7 blocks of a quarter of the components before, each sent to all


def test_few_buckets_carry_vectors(spark):
    bits, tables = similar.fitted(1_800_000, 0.92, 0.995)
    assert tables <= 16 and bits == 9  # 39 tables of 15 bits before, so that many copies of each vector


def test_a_task_holds_its_blocks_and_not_their_pairs(spark):
    """The memory of Python's workers while one block makes 12.5 million pairs."""

    def workers(field):
        found = {}
        for p in pathlib.Path("/proc").glob("[0-9]*"):
            with contextlib.suppress(OSError, IndexError):
                if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                    found[p.name] = int(re.findall(rf"{field}:\s*(\d+) kB", (p / "status").read_text())[0]) / 1024
        return found

    n = 5000
    v = spark.range(n).select("id", F.array(F.lit(1.0), F.col("id") / n, 1 - F.col("id") / n).alias("vec"))
    assert retrieval.similar_pairs(v.where("id < 10"), 0.3).count() == 45
    for p in workers("VmRSS"):
        with contextlib.suppress(OSError):
            pathlib.Path(f"/proc/{p}/clear_refs").write_text("5")  # the peak starts anew
    before = workers("VmRSS")
    assert before and retrieval.similar_pairs(v, 0.3, rows=n).count() == n * (n - 1) // 2
    after = workers("VmHWM")
    assert max(mb - before.get(p, min(before.values())) for p, mb in after.items()) < 450  # over 900 where a block's pairs were gathered


def test_blocks_of_which_some_are_empty(spark):
    for n in range(2, 7):
        data = [(k, [1.0, k / 10]) for k in range(n)]
        pairs = {(a, b, dot(x, y)) for a, x in data for b, y in data if a < b}
        assert sorted(map(tuple, retrieval.similar_pairs(frame(spark, data), 0.1, rows=1).collect())) == sorted(pairs)
        assert {(r.qid, r.id) for r in retrieval.similar_topk(frame(spark, data), n, 0.1, rows=1).collect()} == {p for a, b, _ in pairs for p in ((a, b), (b, a))}
