"""Further queries: fingerprint log, conflicts, details, backfills, suggestions, edits, seeds, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import dedupe, persona, quality, reports, retrieval, spaces, tags, turns
from recallspark.plans import views as V
from recallspark.plans.conversations import _EP
from recallspark.plans.graph import _mentions


def _stamped(s, d):
    """Texts of which a third begins with what was done; many say the same within minutes, as their numbers repeat."""
    m = V.memories(s, d)
    k = F.col("id")
    said = F.when(k % 3 == 0, F.concat(F.lit("添加了一个测试待办“买牛奶 "), (k % 12).cast("string"), F.lit(" 号”。 "), F.coalesce("raw_text", F.lit("")))).otherwise(F.col("raw_text"))
    return m.withColumns({"raw_text": said, "created_at": F.timestamp_seconds(F.lit(1704067200) + k * 20), "title": F.when(k % 2 == 0, "t").otherwise(F.col("title")), "summary": F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 5).cast("string"))).otherwise(F.col("summary"))})


def _detail(s, d):
    t = V.turns(s, d)
    linked = turns.episode_turns(t)
    found = turns.episodes(linked)
    m = turns.extract(t, found)
    return reports.session_detail(found, linked, m, turns.evidence(m))


def _verdicts(s, d):
    k = F.col("o_orderkey")
    return V.read(s, d, "orders").select(k.alias("old_id"), (k + 1).alias("new_id"), F.col("o_orderdate").alias("ts"), F.when(k % 80 == 0, "supersede").when(k % 40 == 0, "refine").otherwise("none").alias("verdict"))


def _edits(s, d):
    e, k = V.read(s, d, "events"), F.col("event_id")
    return e.select((k % 500).alias("id"), "ts", "event_id", F.element_at(F.array(*[F.lit(x) for x in ("edit", "lock", "unlock", "delete", "restore")]), (k % 5 + 1).cast("int")).alias("action"), F.concat(F.lit("t"), k.cast("string")).alias("text"), (F.col("value") / 50).alias("confidence"))


def _asserted(s, d):
    return V.vectors(s, d).select("id", F.lit("a").alias("assertion"), F.lit(0.5).alias("confidence"), F.lit(False).alias("locked"), F.lit(False).alias("is_superseded"))


def _relations(s, d):
    b = V.baskets(s, d)
    r = F.array(F.struct(F.element_at("tags", 1).alias("from"), F.element_at("tags", -1).alias("to"), F.lit("causal").alias("type"), F.lit(None).cast("double").alias("sim")), F.struct(F.lit("Brand#0").alias("from"), F.element_at("tags", 1).alias("to"), F.lit("derived").alias("type"), F.lit(0.7).alias("sim")))
    return tags.explicit_relations(b.withColumn("relations", r))


def _parts(s, d):
    p = V.read(s, d, "part")
    return p.groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("terms")).select(F.col("p_type").alias("candidate_key"), F.col("p_type").alias("name"), F.col("terms").alias("tags"), "terms")


def _brand_spaces(s, d):
    p = V.read(s, d, "part")
    return p.groupBy((F.col("p_size") % 7).cast("long").alias("space_id")).agg(F.sort_array(F.collect_set(F.when(F.col("p_partkey") % 30 == 0, F.col("p_brand")))).alias("terms")).select("space_id", F.concat(F.lit("Size "), F.col("space_id").cast("string")).alias("name"), F.array(F.lit("none")).alias("aliases"), "terms")


def _snapshots(s, d, at, least_new=50):
    """Snapshots of before, one for each nation, then one of a time."""
    k = F.col("n_nationkey")
    history = V.read(s, d, "nation").select(F.timestamp_seconds(F.lit(986083200) + k * 3600).alias("taken_at"), (k + 100).alias("n_memories"), F.array(F.col("n_name")).alias("hot_tags"))
    return reports.snapshot(V.memories(s, d), tags.hot(V.tags(s, d), 50), history, F.lit(at).cast("timestamp"), least_new).select("taken_at", "n_memories", F.array_join("hot_tags", ",").alias("hot_tags"))


def _extractions(s, d):
    k = F.col("doc_id")
    return V.read(s, d, "documents").select(k.alias("id"), F.substring("text", 1, 150).alias("title"), F.substring("text", 1, 700).alias("summary"), F.col("text").alias("detail"), F.concat(F.lit('["a", " topic'), k.cast("string"), F.lit(' ", {"name": "Tool", "category": "tool"}]')).alias("tags"), F.lit('[{"from": "x", "to": "", "type": "causal"}, {"from": "x", "to": "y", "type": "causal"}]').alias("relations"))


QUERIES = {
    "d4_records": lambda s, d: dedupe.records(_stamped(s, d)),
    "d9_conflict_edges": lambda s, d: dedupe.conflict_edges(_verdicts(s, d), _mentions(s, d)).groupBy("source_tag", "target_tag", "relation_type").agg(F.count("*").alias("n")),
    "d9_superseded": lambda s, d: dedupe.apply_conflicts(V.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(False).alias("is_superseded"), F.lit(None).cast("timestamp").alias("valid_until")), _verdicts(s, d)).where("is_superseded").select("id", "superseded_by", "valid_until"),
    "g4_explicit_relations": lambda s, d: _relations(s, d).groupBy("relation_type", "sim").agg(F.count("*").alias("n")),
    "g5_new_tags": lambda s, d: tags.upsert_tags(V.tags(s, d).where("tag_id % 2 = 0"), V.read(s, d, "part").select(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "tool").otherwise("odd").alias("category"), F.col("p_partkey").alias("ts"))),
    "r9_session_detail": _detail,
    "r11_snapshot": lambda s, d: reports.snapshot(V.memories(s, d), tags.hot(V.tags(s, d), 50), None, F.lit(V.AS_OF).cast("timestamp")).select("taken_at", "n_memories", F.array_join("hot_tags", ",").alias("hot_tags")),
    "r15_extractions": lambda s, d: quality.apply_extractions(_extractions(s, d)).select("id", "title", F.length("summary").alias("n_summary"), F.length("detail").alias("n_detail"), F.array_join(F.transform("tags", lambda t: F.concat_ws("/", t["name"], t["category"])), ",").alias("tags"), F.size("relations").alias("n_relations")),
    "r11_snapshot_history": lambda s, d: _snapshots(s, d, "2001-05-30 00:00:00"),
    "r11_snapshot_not_due": lambda s, d: _snapshots(s, d, "2001-04-01 12:00:00", 10**6),
    "j8_source_backfill": lambda s, d: reports.source_backfill(V.memories(s, d), V.memories(s, d).where("session_id like '%1'"), 7),
    "j8_source_memories": lambda s, d: reports.source_memories(V.memories(s, d), reports.source_backfill(V.memories(s, d), V.memories(s, d).where("session_id like '%1'"))).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("memory_id").alias("ids")),
    "j12_cleanup": lambda s, d: spaces.cleanup(V.baskets(s, d).select(F.col("memory_id").alias("id")), _mentions(s, d), F.col("tag") == "Brand#3")[1].groupBy("tag").agg(F.count("*").alias("n")),
    "p7_suggest": lambda s, d: spaces.suggest(_parts(s, d), _brand_spaces(s, d)).withColumn("score", F.round("score", 6)),
    "p8_merge_suggestions": lambda s, d: spaces.merge_suggestions(_parts(s, d)),
    "u6_edits": lambda s, d: persona.edit(_asserted(s, d), _edits(s, d)).withColumn("confidence", F.round("confidence", 6)),
    "u6_audit": lambda s, d: persona.edit_audit(_asserted(s, d), _edits(s, d).withColumn("confidence", F.round("confidence", 1))),
    "v5_seed_tags": lambda s, d: retrieval.seed_tags(retrieval.vector_topk(V.vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), V.vectors(s, d), 5).join(V.vectors(s, d).select("id", F.when(F.col("label") % 2 == 0, "tag").otherwise("memory").alias("kind")), "id"), 0.3).withColumn("activation", F.round("activation", 6)),
}
_NORM = V.normalized_sql
_SCAN = """{name}n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS rn FROM {rows}), {name}k AS (SELECT id, {key} AS k, rn, ts AS last, true AS kept FROM {name}n WHERE rn = 1 AND {key} IS NOT NULL
          UNION ALL SELECT x.id, k, x.rn, CASE WHEN x.ts > y.last + INTERVAL 10 MINUTE THEN x.ts ELSE y.last END, x.ts > y.last + INTERVAL 10 MINUTE FROM {name}k y JOIN {name}n x ON x.{key} = y.k AND x.rn = y.rn + 1), {name} AS (SELECT {name}n.* EXCLUDE (rn), coalesce(q.kept, true) AS kept FROM {name}n LEFT JOIN {name}k q USING (id))"""
_HISTORY = "hist AS (SELECT make_timestamp((986083200 + n_nationkey * 3600)::BIGINT * 1000000) AS taken_at, CAST(n_nationkey + 100 AS BIGINT) AS n_memories, n_name AS hot_tags FROM nation)"
ORACLES = {
    "d4_records": f"""WITH RECURSIVE {V.MEMORIES}, st AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN '添加了一个测试待办“买牛奶 ' || (id % 12)::VARCHAR || ' 号”。 ' || coalesce(raw_text, '') ELSE raw_text END AS raw_text, TIMESTAMP '2024-01-01' + to_seconds(id * 20) AS created_at, CASE WHEN id % 2 = 0 THEN 't' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN 's' || (id % 5)::VARCHAR ELSE summary END AS summary) FROM mem),
        n0 AS (SELECT id, created_at AS ts, {_NORM("raw_text")} AS nr, {_NORM("title || chr(10) || summary || chr(10) || coalesce(raw_text, '')")} AS nj, {_NORM("title || chr(10) || summary")} AS nt FROM st),
        n AS (SELECT id, ts, CASE WHEN nr = '' THEN '#' || id::VARCHAR ELSE nr END AS h, CASE WHEN id % 3 = 0 THEN 'todo_add:' || {_NORM("'买牛奶 ' || (id % 12)::VARCHAR || ' 号'")} END AS ak, CASE WHEN id % 3 = 0 THEN 'todo_add:' || left(nj, 160) ELSE left(nj, 180) END AS fk, nt AS tk FROM n0),
        a AS (SELECT *, arg_min(id, (ts, id)) OVER (PARTITION BY h) = id AS ok FROM n),
        {_SCAN.format(name="b", rows="(SELECT * FROM a WHERE ok)", key="ak")}, {_SCAN.format(name="c", rows="(SELECT * EXCLUDE (kept) FROM b WHERE kept)", key="fk")}, {_SCAN.format(name="e", rows="(SELECT * EXCLUDE (kept) FROM c WHERE kept)", key="tk")},
        z AS (SELECT a.id, CASE WHEN NOT a.ok THEN 'normalized_duplicate' WHEN NOT b.kept THEN 'action_duplicate' WHEN NOT c.kept THEN 'fact_duplicate' WHEN NOT e.kept THEN 'title_summary_duplicate' END AS reason FROM a LEFT JOIN b USING (id) LEFT JOIN c USING (id) LEFT JOIN e USING (id))
        SELECT id, CASE WHEN reason IS NULL THEN 'created' ELSE 'skipped' END AS decision, reason FROM z""",
    "d9_conflict_edges": f"""WITH {V.BASKETS}, m AS (SELECT memory_id, unnest(list_distinct(tags)) AS tag FROM baskets), v AS (SELECT o_orderkey AS o, o_orderkey + 1 AS n, CASE WHEN o_orderkey % 80 = 0 THEN 'SUPERSEDES' ELSE 'REFINES' END AS relation_type FROM orders WHERE o_orderkey % 40 = 0)
        SELECT a.tag AS source_tag, b.tag AS target_tag, relation_type, count(*) AS n FROM v JOIN m a ON a.memory_id = o JOIN m b ON b.memory_id = n WHERE a.tag <> b.tag GROUP BY ALL""",
    "d9_superseded": "SELECT o_orderkey AS id, o_orderkey + 1 AS superseded_by, o_orderdate AS valid_until FROM orders WHERE o_orderkey % 80 = 0",
    "g4_explicit_relations": f"WITH {V.BASKETS}, r AS (SELECT 'CAUSAL' AS relation_type, 0.5::DOUBLE AS sim FROM baskets UNION ALL SELECT 'DERIVED', 0.7::DOUBLE FROM baskets WHERE list_contains(tags, 'Brand#0')) SELECT relation_type, sim, count(*) AS n FROM r GROUP BY ALL",
    "g5_new_tags": f"WITH {V.TAGS} SELECT p_brand AS name, CASE WHEN arg_min(p_size, p_partkey) % 2 = 0 THEN 'TOOL' ELSE 'CONCEPT' END AS category, min(p_partkey) AS first_seen_at FROM part WHERE p_brand NOT IN (SELECT name FROM tags WHERE tag_id % 2 = 0) GROUP BY p_brand",
    "r9_session_detail": f"""{_EP} SELECT e.session_id, e.episode_no, e.episode_id, e.title, (SELECT count(*) FROM linked l WHERE l.session_id = e.session_id AND l.episode_no = e.episode_no) AS turns, (SELECT count(*) FROM mems m WHERE m.episode_id = e.episode_id) AS memories,
        (SELECT count(*) FROM ev JOIN mems m USING (memory_id) WHERE m.episode_id = e.episode_id) AS evidence FROM eps2 e""",
    "r11_snapshot": f"WITH {V.TAGS} SELECT TIMESTAMP '{V.AS_OF}' AS taken_at, (SELECT count(*) FROM documents) AS n_memories, string_agg(name, ',' ORDER BY storage_strength * retrieval_strength DESC, name) AS hot_tags FROM tags WHERE NOT is_dormant",
    "r15_extractions": "SELECT doc_id AS id, left(text, 100) AS title, CAST(least(length(text), 500) AS INT) AS n_summary, CAST(least(length(text), 1500) AS INT) AS n_detail, 'topic' || doc_id::VARCHAR || '/CONCEPT,Tool/TOOL' AS tags, CAST(1 AS INT) AS n_relations FROM documents",
    "r11_snapshot_history": f"WITH {V.TAGS}, {_HISTORY}, one AS (SELECT TIMESTAMP '2001-05-30' AS taken_at, (SELECT count(*) FROM documents) AS n_memories, string_agg(name, ',' ORDER BY storage_strength * retrieval_strength DESC, name) AS hot_tags FROM tags WHERE NOT is_dormant) SELECT * FROM (SELECT * FROM hist UNION ALL SELECT * FROM one) ORDER BY taken_at DESC LIMIT 10",
    "r11_snapshot_not_due": f"WITH {_HISTORY} SELECT * FROM hist ORDER BY taken_at DESC LIMIT 10",
    "j8_source_backfill": f"WITH {V.MEMORIES}, n AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1) // 7 AS c FROM mem WHERE session_id NOT LIKE '%1' AND session_id IS NOT NULL), h AS (SELECT session_id, c, sha256(string_agg(id::VARCHAR, '|' ORDER BY created_at, id)) AS h, count(*) AS n, min(created_at) AS a, max(created_at) AS b FROM n GROUP BY ALL) SELECT session_id, CAST(sum(n) AS BIGINT) AS message_count, sha256(string_agg(h, '|' ORDER BY c)) AS content_hash, min(a) AS started_at, max(b) AS ended_at FROM h GROUP BY session_id",
    "j8_source_memories": f"WITH {V.MEMORIES} SELECT session_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM mem WHERE session_id NOT LIKE '%1' GROUP BY session_id",
    "u6_audit": """WITH e AS (SELECT event_id % 500 AS id, ts, event_id, ['edit','lock','unlock','delete','restore'][event_id % 5 + 1] AS action, 't' || event_id::VARCHAR AS tx, round(value / 50, 1) AS c0 FROM events), f AS (SELECT e.*, least(greatest(c0, 0.0), 1.0) AS c FROM e JOIN embeddings ON vec_id = id),
        g AS (SELECT *, coalesce(last_value(CASE WHEN action = 'edit' THEN tx END IGNORE NULLS) OVER w, 'a') AS ot, coalesce(last_value(CASE WHEN action = 'edit' THEN c END IGNORE NULLS) OVER w, 0.5) AS oc, coalesce(last_value(CASE WHEN action IN ('lock', 'unlock') THEN CASE action WHEN 'lock' THEN 1 ELSE 0 END END IGNORE NULLS) OVER w, 0) AS ol FROM f WINDOW w AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT id, ts, event_id, 'edit_assertion' AS action, ot AS old, tx AS new FROM g WHERE action = 'edit' AND tx <> ot UNION ALL SELECT id, ts, event_id, 'edit_confidence', oc::DOUBLE::VARCHAR, c::DOUBLE::VARCHAR FROM g WHERE action = 'edit' AND c <> oc
        UNION ALL SELECT id, ts, event_id, action, ol::VARCHAR, CASE action WHEN 'lock' THEN '1' ELSE '0' END FROM g WHERE action IN ('lock', 'unlock') UNION ALL SELECT id, ts, event_id, action, CASE action WHEN 'delete' THEN 'active' ELSE 'superseded' END, CASE action WHEN 'delete' THEN 'superseded' ELSE 'active' END FROM g WHERE action IN ('delete', 'restore')""",
    "j12_cleanup": f"WITH {V.BASKETS} SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM baskets WHERE NOT list_contains(tags, 'Brand#3')) GROUP BY tag",
    "p7_suggest": """WITH c AS (SELECT p_type AS k, list_sort(list(DISTINCT lower(replace(p_brand, '#', ' ')))) AS t FROM part GROUP BY 1), sp AS (SELECT CAST(p_size % 7 AS BIGINT) AS space_id, 'size ' || (p_size % 7)::VARCHAR || ' none ' || coalesce(string_agg(DISTINCT lower(replace(p_brand, '#', ' ')), ' ' ORDER BY lower(replace(p_brand, '#', ' '))) FILTER (p_partkey % 30 = 0), '') AS body FROM part GROUP BY p_size % 7),
        bd AS (SELECT space_id, trim(body) AS body FROM sp), x AS (SELECT k, space_id, len(list_filter(t, lambda z: contains(body, z))) / len(t)::DOUBLE AS score FROM c, bd) SELECT k AS candidate_key, space_id, round(score, 6) AS score FROM x WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY k ORDER BY x.score DESC, space_id) = 1""",
    "p8_merge_suggestions": """WITH t AS (SELECT DISTINCT p_type AS k, p_brand AS t FROM part), rel AS (SELECT DISTINCT a.t, b.t AS o FROM (SELECT DISTINCT t FROM t) a JOIN (SELECT DISTINCT t FROM t) b ON contains(a.t, b.t) OR contains(b.t, a.t)), x AS (SELECT a.k AS a, b.k AS b, count(DISTINCT a.t) AS n FROM t a JOIN rel ON rel.t = a.t JOIN t b ON rel.o = b.t AND a.k <> b.k GROUP BY ALL)
        SELECT a, b, n, round(least(0.95::DOUBLE, 0.55::DOUBLE + 0.12::DOUBLE * n), 6) AS score, CAST(row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS INT) AS rank FROM x QUALIFY rank <= 3""",
    "u6_edits": """WITH e AS (SELECT event_id % 500 AS id, ts, event_id, ['edit','lock','unlock','delete','restore'][event_id % 5 + 1] AS action, 't' || event_id::VARCHAR AS tx, value / 50 AS c FROM events),
        g AS (SELECT id, arg_max(tx, (ts, event_id)) FILTER (action = 'edit') AS t, arg_max(least(greatest(c, 0.0), 1.0), (ts, event_id)) FILTER (action = 'edit') AS c, arg_max(action = 'lock', (ts, event_id)) FILTER (action IN ('lock', 'unlock')) AS l, arg_max(action = 'delete', (ts, event_id)) FILTER (action IN ('delete', 'restore')) AS x FROM e GROUP BY id)
        SELECT vec_id AS id, coalesce(t, 'a') AS assertion, round(coalesce(c, 0.5::DOUBLE), 6) AS confidence, coalesce(l, false) AS locked, coalesce(x, false) AS is_superseded FROM embeddings LEFT JOIN g ON g.id = vec_id""",
    "v5_seed_tags": """WITH p AS (SELECT q.vec_id AS qid, i.vec_id AS id, i.label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9) AS s FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 5)
        SELECT qid, id AS tag, round(s, 6) AS activation FROM t WHERE label % 2 = 0 AND s > 0.3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 3""",
}
