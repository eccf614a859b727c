"""Keys, units and runs that hold nearly all rows, against plain loops."""

import os
import random

from pyspark.sql import functions as F

from recallspark.operators import dedupe, governance, persona, spaces, tags
from recallspark.sources import sinks


def greedy(rows, minutes=10):
    """rows: (id, key, seconds); the ids that are kept."""
    out, last = set(), {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if not key or key not in last or t - last[key] > minutes * 60:
            out.add(i)
            if key:
                last[key] = t
    return out


def test_windowed_over_ranges(spark):
    r = random.Random(3)
    rows = [(k, "hot", r.randrange(0, 40_000)) for k in range(6000)]  # many rows in each window, and one run over all ranges
    rows += [(10_000 + k, "sparse", 1200 * k + r.randrange(3) * 599) for k in range(800)]
    rows += [(20_000 + k, "same", 77) for k in range(300)] + [(30_000 + k, f"k{k % 40}", r.randrange(0, 9000)) for k in range(400)]
    rows += [(40_000 + k, None if k % 2 else "", 5) for k in range(6)]
    df = spark.createDataFrame(rows, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    wide = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x.id for x in dedupe.windowed(df, "key").where("kept").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == greedy(rows)
    assert dedupe.windowed(df.limit(0), "key").count() == 0


def test_a_unit_of_a_million_events(spark):
    n = 1_000_000
    events = spark.range(n).select(
        (F.col("id") % 3 == 0).cast("long").alias("unit"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 == 0, "pin").otherwise("update").alias("action"), F.when(F.col("id") % 11 == 0, (F.col("id") % 5) / 2.0).alias("weight"), F.lit(None).cast("string").alias("note"),
    ).withColumnRenamed("unit", "id")
    units = spark.createDataFrame([(0, "active", 0.7, False, None, None), (1, "active", 0.7, False, None, None), (2, "active", 0.7, False, None, None)], "id long, status string, user_weight double, pinned boolean, valid_until timestamp, note string")
    want = {2: 0.7}
    for unit in (0, 1):
        w = 0.7
        for k in range(n):
            if (k % 3 == 0) == bool(unit):
                w = k % 5 / 2 if k % 11 == 0 else max(w, 1.5) if k % 7 == 0 else w
        want[unit] = w
    got = governance.apply_events(units, events)
    assert {r.id: r.user_weight for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_names_in_one_pass_and_in_parts(spark):
    r = random.Random(8)
    names = ["a", "aa", "aba", "bab", "ünï", "x y", ".", *("".join(r.choices("ab", k=r.randrange(3, 9))) for _ in range(60))]
    texts = [(k, "".join(r.choices("ab. xyünï", k=r.randrange(0, 60)))) for k in range(300)] + [(900, None), (901, ""), (902, "aab" * 50_000), (5, "repeated id aba")]
    df, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in [*names, "aa", "", None]], "name string")
    want = sorted((k, n) for k, t in texts if t for n in set(names) if n in t)
    for characters in (spaces.AUTOMATON, 40):
        assert sorted(map(tuple, spaces.names_in(df, known, characters).collect())) == want
    assert spaces.names_in(df, known.limit(0)).count() == spaces.names_in(df.limit(0), known).count() == 0
    assert "Generate" not in spaces.names_in(df, known)._jdf.queryExecution().optimizedPlan().toString()


def leaders(nodes, edges):
    """Each node leads unless an earlier leader is its neighbour."""
    out = set()
    for n in sorted(nodes):
        if not any(b in out for a, b in edges if a == n):
            out.add(n)
    return out


def test_leaders_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    whole = persona.saved
    monkeypatch.setattr(persona, "saved", lambda df, name: rounds.append(name) or whole(df, name))
    nodes = spark.range(10_000).select("id")
    chain = nodes.where("id > 0").select(F.col("id").alias("qid"), (F.col("id") - 1).alias("id"))
    assert {r.id for r in persona.first_come(nodes, chain).collect()} == set(range(0, 10_000, 2))
    assert rounds.count("decided") < 20


def test_leaders_of_any_graph(spark):
    r = random.Random(9)
    edges = {(a, b) for a in range(120) for b in r.sample(range(a), min(a, r.randrange(0, 4)))} | {(200 + k, 200 + k - 1) for k in range(1, 40)} | {(239, 200), (239, 210)}
    nodes = [*range(120), *range(200, 240)]
    got = persona.first_come(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(sorted(edges), "qid long, id long"))
    assert {x.id for x in got.collect()} == leaders(nodes, edges)
    assert persona.first_come(spark.createDataFrame([], "id long"), spark.createDataFrame([], "qid long, id long")).count() == 0


def test_chains_of_one_session(spark):
    r = random.Random(5)
    n = 1500
    at = {k: r.randrange(0, 400) for k in range(n)}
    tag = {k: r.choice("abcd") for k in range(n)}
    memories = spark.createDataFrame([(k, 1, at[k]) for k in range(n)], "memory_id long, session_id long, created_at long")
    mentions = spark.createDataFrame([(k, tag[k]) for k in range(n)], "memory_id long, tag string")
    refines = spark.createDataFrame([("a", "b"), ("b", "c")], "source_tag string, target_tag string")
    got = {x.memory_id: x.superseded_by for x in tags.merge_chains(memories, mentions, refines).collect()}
    order, want, run = sorted(range(n), key=lambda k: (at[k], k)), {}, []
    for k in [*order, None]:
        if run and (k is None or {tag[k], tag[run[-1]]} not in ({"a", "b"}, {"b", "c"})):
            want |= dict.fromkeys(run[:-1], run[-1])
            run = []
        run.append(k)
    assert got == want and len(want) > 100


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda data: spark.createDataFrame(data, "id long, content string, n long, first string, at long")
    sinks.upsert_table(path, rows([(k, f"text {k}", 5, None, 1) for k in range(200)]), ["id"], buckets=16)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    new = [(3, " ", 9, "a", 2), (3, None, 7, "b", 3), (500, "new", 1, "c", 2), (None, "no key", 1, None, 2), (None, "no key again", None, "d", 4)]
    sinks.upsert_table(path, rows(new), ["id"], ["at"], {"n": "max", "first": "keep", "at": "replace"})
    after = files()
    changed = {f.split("_bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert 1 <= len(changed) <= 3 and all(before[f] == after[f] for f in before.keys() & after.keys()) and len(before.keys() & after.keys()) >= 13
    sinks.upsert_table(path, rows([(3, "later", 1, "z", 9)]), ["id"], ["at"], {"n": "max", "first": "keep", "at": "replace"})
    got = {r.id: (r.content, r.n, r.first, r.at) for r in sinks.read_table(spark, path).collect()}
    assert len(got) == 202 and got[3] == ("later", 7, "b", 9) and got[500] == ("new", 1, "c", 2) and got[None] == ("no key again", None, "d", 4) and got[7] == ("text 7", 5, None, 1)
    sinks.upsert_table(path, rows([]), ["id"])
    assert sinks.read_table(spark, path).count() == 202


def test_texts_and_baskets_are_read_once(spark, monkeypatch):
    from recallspark.operators import tags
    from recallspark.plans import graph
    from recallspark.plans import views as V

    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc"), (3, "dd")], "id long, text string")
    found = tags.keyword_tags(docs, least=0.1)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # three times before
    assert {(r.doc, r.term) for r in found.collect()} == {(1, "aa"), (1, "bb"), (2, "bb"), (2, "cc"), (3, "dd")}
    calls, own = [], V.baskets
    monkeypatch.setattr(V, "baskets", lambda *a: calls.append(a) or own(*a))
    graph.QUERIES["g9_export_nodes"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1  # three times before
