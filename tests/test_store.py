"""Dedupe windows, edge weights, decay, spreading, folds and upserts against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recallspark.operators import dedupe, governance, quality, retrieval, tags, tasks
from recallspark.sources import sinks

T0 = datetime(2024, 1, 1)


def test_windowed_duplicates(spark):
    r = random.Random(3)
    rows = [(k, f"k{r.randint(0, 3)}" if r.random() < 0.9 else r.choice(["", None]), T0 + timedelta(seconds=r.randint(0, 20000))) for k in range(300)]
    rows += [(1000 + k, "m", T0 + timedelta(minutes=m)) for k, m in enumerate((0, 6, 12, 23))]
    got = {x.id: x.kept for x in dedupe.windowed(spark.createDataFrame(rows, "id long, key string, ts timestamp"), "key").collect()}
    last, want = {}, {}
    for k, key, at in sorted(rows, key=lambda x: (x[2], x[0])):
        want[k] = not key or key not in last or at - last[key] > timedelta(minutes=10)
        if key and want[k]:
            last[key] = at
    assert got == want
    assert [got[1000 + k] for k in range(4)] == [True, False, True, True]


def test_edge_weights(spark):
    r = random.Random(4)
    rows = [("a", f"b{r.randint(0, 4)}", "CO_OCCUR", T0 + timedelta(minutes=r.randint(0, 500)), k, r.choice(["s1", "s2", ""]), r.random()) for k in range(400)]
    schema = "source_tag string, target_tag string, relation_type string, ts timestamp, id long, session_id string, sim double"

    def loop(events, start=None):
        w = dict(start or {})
        for _, b, _, _, _, session, sim in sorted(events, key=lambda x: (x[3], x[4])):
            s = max(sim, 0.1)
            if b not in w:
                w[b] = (0.05 * s, 1, session)
                continue
            weight, n, last = w[b]
            n += 1
            bonus = 1 + 0.5 * min(n / 5, 1) if session and session == last else 1
            w[b] = (min(1, weight + 0.05 * (1 - weight) * s * min(n / 10, 2) * bonus), n, session)
        return w

    whole = tags.hebbian(spark.createDataFrame(rows, schema))
    want = loop(rows)
    for x in whole.collect():
        assert abs(x.hebbian_weight - want[x.target_tag][0]) < 1e-12 and x.co_activation_count == want[x.target_tag][1]
    early, late = sorted(rows, key=lambda x: (x[3], x[4]))[:200], sorted(rows, key=lambda x: (x[3], x[4]))[200:]
    more = tags.hebbian(spark.createDataFrame(late, schema), tags.hebbian(spark.createDataFrame(early, schema)))
    for x in more.collect():
        assert abs(x.hebbian_weight - want[x.target_tag][0]) < 1e-12 and x.co_activation_count == want[x.target_tag][1]


def test_decay(spark):
    rows = [(k, f"t{k}", 0.1 * (k % 5), 0.05 + 0.1 * (k % 7), k % 3, k % 4, None if k % 2 else T0, k % 6 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, "tag_id long, name string, storage_strength double, retrieval_strength double, total_activations long, cooldown_days int, last_activated_at timestamp, is_dormant boolean")
    keep = spark.createDataFrame([(1,), (7,)], "tag_id long")
    got = {x.tag_id: x for x in tags.forget(df, keep, F.lit("2024-06-01").cast("timestamp"), 5).collect()}
    for tag, _, s, r, n, cd, _, dormant in rows:
        if not dormant and tag not in (1, 7):
            for _ in range(5):
                r, cd = max(r * (1 - 0.02 * max(cd + 1, 1)), 0.01), cd + 1
            dormant = s * r < 0.05 and n < 2
        assert abs(got[tag].retrieval_strength - r) < 1e-12 and got[tag].cooldown_days == cd and got[tag].is_dormant == dormant


def test_spreading_on_a_graph_with_a_cycle_and_signed_edges(spark):
    edges = [("a", "b", "CO_OCCUR", 0.8), ("b", "c", "CAUSAL", 0.5), ("c", "a", "CO_OCCUR", 0.9), ("a", "d", "CONTRADICT", 0.9), ("d", "e", "CO_OCCUR", 0.9), ("b", "f", "SUPERSEDES", 0.9), ("c", "f", "REFINES", 0.4), ("x", "y", "OTHER", 0.5)]
    both = edges + [(b, a, t, w) for a, b, t, w in edges]
    got = {(x.qid, x.tag): x.activation for x in retrieval.spread(spark.createDataFrame([(1, "a", 0.9), (2, "x", 0.5)], "qid long, tag string, activation double"), spark.createDataFrame(both, "tag string, neighbor string, relation_type string, hebbian_weight double")).collect()}
    for qid, seeds in ((1, {"a": 0.9}), (2, {"x": 0.5})):
        state = dict(seeds)
        for _ in range(3):
            flow = {}
            for a, b, t, w in both:
                p = state.get(a, 0) * w * 0.5 * retrieval.RELATION_FACTORS.get(t, 1.0)
                if p > 0:
                    flow.setdefault(b, []).append(p)
            state = {t: (state[t] + 0.3 * sum(flow.get(t, [])) if t in state else max(flow[t])) for t in {*state, *flow}}
        top = max(state.values())
        assert {t for q, t in got if q == qid} == set(state)
        for t, v in state.items():
            assert abs(got[qid, t] - v / top) < 1e-12


def test_governance_fold(spark):
    units = spark.createDataFrame([(1, "active", 1.0, False, None, None), (2, "active", 2.0, False, None, None)], "id long, status string, user_weight double, pinned boolean, valid_until timestamp, note string")
    at = lambda k: T0 + timedelta(minutes=k)
    events = spark.createDataFrame(
        [(1, at(1), 1, "pin", None, None), (1, at(2), 2, "mark_wrong", None, None), (1, at(3), 3, "restore", None, None), (2, at(1), 4, "pin", None, "n"), (2, at(2), 5, "mute", None, None), (9, at(1), 6, "pin", None, None), (1, at(5), 7, "what", None, None)],
        "id long, ts timestamp, event_id long, action string, weight double, note string",
    )
    got = {x.id: x for x in governance.apply_events(units, events).collect()}
    assert (got[1].status, got[1].user_weight, got[1].pinned) == ("active", 1.5, True)
    assert (got[2].status, got[2].user_weight, got[2].note) == ("muted", 2.0, "n")
    assert governance.audit(units, events).where("id = 1").count() == 7
    assert {(x.id, x.reason) for x in governance.rejects(units, events).collect()} == {(9, "unknown_id"), (1, "unknown_action")}


def test_upsert_keeps_contents(spark):
    a = spark.createDataFrame([(1, "first", 1), (2, "two", 1)], "id int, content string, n int")
    b = spark.createDataFrame([(1, " ", 2), (3, "three", 3)], "id int, content string, n int")
    got = {(x.id, x.content, x.n) for x in sinks.upsert(a, b, ["id"]).collect()}
    assert got == {(1, "first", 2), (2, "two", 1), (3, "three", 3)}


def test_quality_rules(spark):
    m = spark.createDataFrame([(1, "打开 这个文件", "x"), (2, "Clean title", "y"), (3, "Same", "s"), (4, "same!", "s"), (5, "tool_call", "z"), (6, "No proof", "p")], "id long, title string, summary string")
    proof = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "id long")
    got = {x.id: (x.retention_class, x.recall_policy) for x in quality.rules(m, proof).collect()}
    assert got == {1: ("temporary_task", "exclude_default"), 2: ("long_term", "include"), 3: ("project_state", "downrank"), 4: ("project_state", "downrank"), 5: ("noise", "exclude"), 6: ("candidate", "downrank")}


def test_source_groups(spark):
    m = spark.createDataFrame([(1, "Same text!", "REASONING", "active", 0.9, T0), (2, "same text", "DECISION", "active", 0.5, T0), (3, "other", "FACT", "active", 0.5, T0)], "id long, raw_text string, memory_type string, status string, confidence double, created_at timestamp")
    keyed = dedupe.keyed_memories(m)
    groups = dedupe.source_groups(keyed)
    (g,) = groups.collect()
    members = dedupe.group_members(keyed, groups)
    assert (g.n, g.canonical_id, sorted(x.id for x in members.collect())) == (2, 2, [1, 2])
    assert [(x.source_id, x.target_id) for x in dedupe.merges(members).collect()] == [(1, 2)]
    links, muted = dedupe.backfill_merges(m.union(spark.createDataFrame([(4, "SAME text", "DECISION", "wrong", 0.9, T0), (5, None, "FACT", "active", 0.5, T0), (6, " .", "FACT", "active", 0.5, T0)], m.schema)))
    assert sorted((x.source_id, x.target_id) for x in links.collect()) == [(1, 2), (4, 2)]
    assert {x.id: x.status for x in muted.collect()} == {1: "muted", 2: "active", 3: "active", 4: "muted", 5: "active", 6: "active"}


def test_task_duplicates_equal_brute_force(spark):
    from difflib import SequenceMatcher

    r = random.Random(6)
    titles = ["call the bank", "call the bank now", "call bank", "order 1", "order 12", "order 123", "pay the rent today", "pay the rents today", "xy", "pay thy rent today"]
    rows = [(k, r.choice(titles), r.choice(["high", "low"]), r.choice(["todo", "doing", "done"]), T0 if r.random() < 0.7 else None, T0 + timedelta(minutes=r.randint(0, 50)), r.choice([1, 2])) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, title string, priority string, status string, due timestamp, created_at timestamp, space_id long")
    got = {x.id: (x.duplicate_of, round(x.similarity, 9)) for x in tasks.duplicates(df).collect()}

    def like(a, b):
        a, b = a.replace(" ", ""), b.replace(" ", "")
        if a == b:
            return 1.0
        if (a in b or b in a) and min(len(a), len(b)) >= 0.72 * max(len(a), len(b)):
            return 0.94
        return SequenceMatcher(None, min(a, b), max(a, b)).ratio()

    want, own = {}, [x for x in rows if x[3] != "done"]
    for x in own:
        earlier = [y for y in own if (y[2], y[4], y[6]) == (x[2], x[4], x[6]) and (y[5], y[0]) < (x[5], x[0]) and like(x[1], y[1]) >= 0.92]
        if earlier:
            y = max(earlier, key=lambda y: (y[5], y[0]))
            want[x[0]] = (y[0], round(like(x[1], y[1]), 9))
    assert got == want and len({s for _, s in want.values()}) > 2


def test_task_duplicates(spark):
    rows = [(1, "Buy milk and bread", 1), (2, "Buy  milk and bread!", 2), (3, "buy milk and breads", 3), (4, "Call home", 4), (5, "x", 5)]
    df = spark.createDataFrame([(k, t, "high", "todo", T0, T0 + timedelta(minutes=m), 1) for k, t, m in rows], "id long, title string, priority string, status string, due timestamp, created_at timestamp, space_id long")
    got = {(x.id, x.duplicate_of, round(x.similarity, 2)) for x in tasks.duplicates(df).collect()}
    assert got == {(2, 1, 1.0), (3, 2, 0.94)}  # the newest earlier one, though task 1 has the like title first
