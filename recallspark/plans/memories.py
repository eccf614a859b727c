"""Queries over documents as memories: fingerprints, duplicates, quality, lists, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import text as X
from recallspark.operators import bm25, dedupe, quality, reports, retrieval, spaces, tags
from recallspark.plans import views as V
from recallspark.sources.scratch import saved, scratch_path

M = V.memories
NORM = V.normalized_sql("raw_text")


def _at():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")


def _events(s, d):
    e = V.read(s, d, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("action_key"))


def _links(s, d):
    """Evidence: documents with a label."""
    return V.read(s, d, "labels").select(F.col("doc_id").alias("id"))


def _reviews(s, d):
    return quality.rules(M(s, d), _links(s, d))


def _queries(s, d):
    b = V.read(s, d, "benchmark")
    words = F.slice(retrieval.tokens("text"), 1, 2)
    return b.select(F.col("item_id").alias("qid"), F.array_join(words, " ").alias("text"))


def _indexed(s, d):
    """An index of documents that are built from first and added after, by their ids."""
    own = V.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = bm25.build(own.where("id % 3 <> 0"), scratch_path(s, "index"))
    bm25.append(own.where("id % 3 = 0"), path)
    return path


def _superseded(s, d):
    """An index of titles, summaries and texts of memories, of which the superseded ones are taken out."""
    m = M(s, d)
    path = bm25.build(m, scratch_path(s, "index"), text=["title", "summary", "raw_text"])
    bm25.remove(m.where("is_superseded"), path)
    return path


QUERIES = {
    "v4_build": lambda s, d: bm25.terms(s, _indexed(s, d)),
    "v4_indexed": lambda s, d: bm25.search(_queries(s, d), _indexed(s, d), 10),
    "v4_removed": lambda s, d: bm25.search(_queries(s, d), _superseded(s, d), 10),
    "t1_normalized": lambda s, d: V.operational(s, d).select("id", F.sha2(X.normalize_conversation("raw_text"), 256).alias("h"), X.compact_key("raw_text").alias("key")),
    "t4_action_keys": lambda s, d: V.operational(s, d).select("id", X.action_keys("raw_text", "title", "summary").alias("k")).select("id", "k.action_key", "k.entity_key", "k.fact_key"),
    "t6_titles": lambda s, d: M(s, d).select("id", "title", X.title_key("title").alias("title_key"), "summary"),
    "d1_ingestion_gate": lambda s, d: dedupe.ingestion_gate(V.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts"), "text")).select("id", "conversation_hash", "status"),
    "d2_exact": lambda s, d: dedupe.exact(M(s, d)),
    "d3_windowed": lambda s, d: dedupe.windowed(_events(s, d), "action_key").select("id", "action_key", "kept"),
    "d5_source_groups": lambda s, d: dedupe.source_groups(dedupe.keyed_memories(M(s, d))).select("group_key", "n", "canonical_id", F.array_join("types", ",").alias("types"), F.array_join("statuses", ",").alias("statuses"), "first_at", "last_at"),
    "d5_group_members": lambda s, d: _members(s, d),
    "d6_merges": lambda s, d: dedupe.backfill_merges(M(s, d), _some_merges(s, d))[0],
    "d6_muted": lambda s, d: dedupe.backfill_merges(M(s, d), _some_merges(s, d))[1].groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids")),
    "d10_open_candidates": lambda s, d: dedupe.open_candidates(M(s, d).where("id % 50 = 0"), M(s, d)),
    "d10_newest_of_type": lambda s, d: dedupe.newest_of_type(M(s, d)).select("memory_type", "id", "rank"),
    "d11_title_groups": lambda s, d: dedupe.title_groups(M(s, d)),
    "r5_quality_rules": lambda s, d: _reviews(s, d).select("id", F.array_join("flags", ",").alias("flags"), "duplicate_count", *quality.FIELDS),
    "r6_quality_audit": lambda s, d: quality.audit(_reviews(s, d), 3, V.source_sessions(s, d)).select("kind", "value", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples")),
    "r13_worklist": lambda s, d: quality.worklist(_reviews(s, d), M(s, d), M(s, d).where("id % 2 = 0"), 25),
    "a1_memory_list": lambda s, d: reports.memory_list(M(s, d), _homes(s, d), "the", "active", "agent 1", None, 5, 30).select("id", "pinned", "created_at", "display_title", "total"),
    "a1_session_list": lambda s, d: reports.memory_list(M(s, d), _homes(s, d), session=F.lit("web2"), limit=40).select("id", "status", "agent", "title_source", "total"),
    "a2_status_breakdown": lambda s, d: reports.status_breakdown(M(s, d)),
    "a3_page": lambda s, d: reports.page(M(s, d), "ion", ["title", "summary"], ["id"], 10, 20).select("id", "total"),
    "a7_valid_at": lambda s, d: reports.valid_at(M(s, d), _at()).select("id"),
    "r10_totals": lambda s, d: reports.totals(memories=M(s, d), turns=V.turns(s, d), events=V.read(s, d, "events")),
    "r10_store_stats": lambda s, d: reports.store_stats(V.tags(s, d), 5, memories=M(s, d), turns=V.turns(s, d), events=V.read(s, d, "events")).withColumn("value", F.round("value", 6)),
    "r12_new_since": lambda s, d: reports.new_since(M(s, d), _at()),
    "j6_unbound": lambda s, d: spaces.unbound(M(s, d), _links(s, d)).select("id"),
    "j9_content_audit": lambda s, d: reports.content_audit(_stored(s, d), V.turns(s, d)),
    "j9_filled": lambda s, d: reports.fill_content(_stored(s, d), V.turns(s, d)).select("session_id", "turn_index", F.sha2("content", 256).alias("h")),
    "j7_uncovered": lambda s, d: reports.uncovered(M(s, d).select("session_id").distinct(), M(s, d), M(s, d).where("id % 97 = 0").select("session_id").distinct(), 3),
    "j5_pending_imports": lambda s, d: reports.pending_imports(_sessions(s, d), _sessions(s, d).where("session_id % 4 <> 0").withColumn("content_hash", F.when(F.col("session_id") % 5 == 0, "old").otherwise(F.col("content_hash")))),
    "g11_keyword_tags": lambda s, d: tags.keyword_tags(V.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), least=0.05).select("doc", "term", F.round("weight", 6).alias("weight")),
    "v4_bm25": lambda s, d: retrieval.bm25_search(_queries(s, d), V.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), k=10),
    "j2_title_ranges": lambda s, d: reports.match_title_ranges(*_ranges(s, d)),
}


def _members(s, d):
    keyed = dedupe.keyed_memories(M(s, d))
    return dedupe.group_members(keyed, dedupe.source_groups(keyed)).select("group_key", "id")


def _some_merges(s, d):
    """Links that exist: those of even memories into the first copy of their text."""
    keyed = dedupe.keyed_memories(M(s, d))
    first = keyed.groupBy("group_key").agg(F.min("id").alias("target_id"))
    return keyed.join(first, "group_key").where("id % 2 = 0 and id <> target_id").select(F.col("id").alias("source_id"), "target_id", F.lit("MERGED_INTO").alias("relation_type"))


def _homes(s, d):
    """Sources as sessions of an agent."""
    k = F.length("session_id")
    own = M(s, d).where("session_id is not null").groupBy("session_id").agg(F.min("id").alias("_i"))
    return own.select("session_id", F.concat(F.lit("agent "), (F.col("_i") % 2).cast("string")).alias("agent"), F.concat(F.lit("Home of "), F.col("session_id")).alias("display_title"), F.when(k % 2 == 0, "missing").otherwise("index").alias("title_source"))


def _stored(s, d):
    t = V.turns(s, d)
    k = F.col("session_id") + F.col("turn_index")
    return t.select("session_id", "turn_index", F.when(k % 7 == 0, "tool").otherwise(F.col("role")).alias("role"), F.when(k % 3 == 0, "").otherwise(F.col("content")).alias("content"), F.when(k % 2 == 0, F.sha2("content", 256)).otherwise("").alias("content_hash"), "agent")


def _sessions(s, d):
    t = V.turns(s, d).groupBy("session_id", F.col("agent").alias("source")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", F.sha2("content", 256).alias("h")))), lambda x: x["h"]), "|"), 256).alias("content_hash"))
    return t


def _ranges(s, d):
    e = V.read(s, d, "events").withColumn("t", F.unix_seconds("ts"))
    files = e.groupBy((F.col("user_id") * 1000 + F.floor(F.col("t") / 86400) % 1000).alias("file_id")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    titles = e.where("event_id % 5 = 0").groupBy((F.col("event_id") % 300).alias("title_id")).agg(F.min("t").alias("start"), (F.min("t") + 40000).alias("end"))
    return files, titles


_REVIEWS = f"""WITH {V.MEMORIES}, k AS (SELECT id, lower(coalesce(title,'') || chr(10) || coalesce(summary,'')) AS body, left(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 80) AS title_key FROM mem),
  c AS (SELECT title_key, count(*) AS n FROM k WHERE title_key <> '' GROUP BY title_key), e AS (SELECT DISTINCT doc_id FROM labels),
  f AS (SELECT id, coalesce(c.n, 1) AS duplicate_count, list_filter([{", ".join(f"CASE WHEN contains(body, '{t}') THEN '{kind}:{t}' END" for kind, ts in (("pollution", X.POLLUTION), ("temporary", X.TEMPORARY)) for t in ts)},
    CASE WHEN e.doc_id IS NULL THEN 'low_evidence' END, CASE WHEN coalesce(c.n, 1) > 1 THEN 'duplicate_candidate' END], lambda x: x IS NOT NULL) AS flags FROM k LEFT JOIN c USING (title_key) LEFT JOIN e ON e.doc_id = id),
  g AS (SELECT *, CASE WHEN len(list_filter(flags, lambda x: starts_with(x, 'pollution'))) > 0 THEN 1 WHEN len(list_filter(flags, lambda x: starts_with(x, 'temporary'))) > 0 THEN 2 WHEN list_contains(flags, 'low_evidence') THEN 3 WHEN list_contains(flags, 'duplicate_candidate') THEN 4 ELSE 5 END AS c FROM f),
  reviews AS (SELECT id, flags, duplicate_count, ['auto_rejected','auto_muted','auto_flagged','auto_flagged','auto_accepted'][c] AS review_status, ['noise','temporary_task','candidate','project_state','long_term'][c] AS retention_class,
    ['exclude','exclude_default','downrank','downrank','include'][c] AS recall_policy, [0.05::DOUBLE,0.25::DOUBLE,0.35::DOUBLE,0.55::DOUBLE,0.82::DOUBLE][c] AS quality_score, c >= 3 AS needs_llm FROM g)"""
_GROUPS = f"""WITH {V.MEMORIES}, n AS (SELECT *, {NORM} AS norm FROM mem WHERE status <> 'deleted'), k AS (SELECT *, sha256(norm) AS group_key, list_position(['DECISION','PREFERENCE','FACT','REASONING','EVENT'], memory_type) AS r FROM n WHERE norm <> ''),
  groups AS (SELECT group_key, count(*) AS n, arg_min(id, (CASE WHEN status <> 'active' THEN 1 ELSE 0 END, r, -confidence, created_at, id)) AS canonical_id, list_sort(list(id)) AS members, list_sort(list_distinct(list(memory_type))) AS types,
    list_sort(list_distinct(list(status))) AS statuses, min(created_at) AS first_at, max(created_at) AS last_at FROM k GROUP BY group_key HAVING count(*) > 1)"""
_HOMES = "homes AS (SELECT session_id, 'agent ' || (min(id) % 2)::VARCHAR AS agent, 'Home of ' || session_id AS display_title, CASE WHEN length(session_id) % 2 = 0 THEN 'missing' ELSE 'index' END AS title_source FROM mem WHERE session_id IS NOT NULL GROUP BY session_id)"
_MERGES = f"""{_GROUPS}, old AS (SELECT id AS source_id, min(id) OVER (PARTITION BY group_key) AS target_id FROM k), new AS (SELECT m AS source_id, canonical_id AS target_id FROM (SELECT unnest(members) AS m, canonical_id FROM groups) WHERE m <> canonical_id AND NOT EXISTS (SELECT 1 FROM old WHERE source_id % 2 = 0 AND source_id <> target_id AND source_id = m AND target_id = canonical_id))"""
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0)"
_BM25 = f"""d AS (SELECT id, {_TOK.format("text")} AS t FROM src), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
        q AS (SELECT DISTINCT item_id AS qid, unnest(({_TOK.format("text")})[1:2]) AS term FROM benchmark), need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid),
        p AS (SELECT term, id, size, count(*) AS tf FROM (SELECT id, len(t) AS size, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, count(*) AS c FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, id)
        SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM s JOIN need USING (qid) WHERE c = need QUALIFY rank <= 10"""
ORACLES = {
    "t1_normalized": f"WITH {V.OPERATIONAL}, n AS (SELECT id, {V.normalized_sql(V.DATED.format('raw_text'))} AS t FROM oper) SELECT id, sha256(t) AS h, CASE WHEN t = '' THEN '' ELSE sha256(left(t, 120)) END AS key FROM n",
    "t4_action_keys": f"""WITH {V.OPERATIONAL}, j AS (SELECT id, title || chr(10) || summary || chr(10) || raw_text AS joined FROM oper), n AS (SELECT id, joined, {V.normalized_sql(V.DATED.format('joined'))} AS t, {V.ACTION_SQL} AS a FROM j),
        e AS (SELECT *, lower(regexp_extract(joined, '{X.UUID}', 0, 'i')) AS u, CASE WHEN starts_with(a, 'todo') THEN regexp_extract(joined, '{X.QUOTED}', 1) WHEN starts_with(a, 'space') THEN regexp_extract(joined, '{V.SPACE_SQL}', 1, 'i') ELSE '' END AS q FROM n),
        f AS (SELECT *, CASE WHEN u <> '' THEN u WHEN starts_with(a, 'todo') OR starts_with(a, 'space') THEN CASE WHEN q <> '' THEN {V.normalized_sql('q')} ELSE left(t, 80) END ELSE '' END AS entity FROM e)
        SELECT id, CASE WHEN a <> '' AND entity <> '' THEN a || ':' || left(sha256(entity), 16) ELSE '' END AS action_key, entity AS entity_key, CASE WHEN a <> '' THEN a || ':' || left(sha256(left(t, 160)), 16) ELSE left(sha256(left(t, 180)), 16) END AS fact_key FROM f""",
    "t6_titles": f"WITH {V.MEMORIES} SELECT id, title, left(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 80) AS title_key, summary FROM mem",
    "d1_ingestion_gate": f"WITH n AS (SELECT doc_id AS id, {V.normalized_sql('text')} AS t FROM documents), h AS (SELECT id, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS conversation_hash FROM n) SELECT id, conversation_hash, CASE WHEN conversation_hash = '' OR row_number() OVER (PARTITION BY conversation_hash ORDER BY id) = 1 THEN 'processed' ELSE 'conversation_hash_duplicate' END AS status FROM h",
    "d2_exact": f"WITH {V.MEMORIES}, n AS (SELECT id, {NORM} AS t FROM mem), h AS (SELECT id, CASE WHEN t = '' THEN '#' || id::VARCHAR ELSE sha256(t) END AS normalized_hash FROM n) SELECT id, normalized_hash, min(id) OVER (PARTITION BY normalized_hash) AS kept_id FROM h",
    "d3_windowed": """WITH RECURSIVE e AS (SELECT event_id AS id, ts, user_id::VARCHAR || '|' || event_type AS action_key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
        k AS (SELECT id, action_key, rn, ts AS last, true AS kept FROM e WHERE rn = 1
          UNION ALL SELECT e.id, e.action_key, e.rn, CASE WHEN e.ts > k.last + INTERVAL 10 MINUTE THEN e.ts ELSE k.last END, e.ts > k.last + INTERVAL 10 MINUTE FROM k JOIN e ON e.action_key = k.action_key AND e.rn = k.rn + 1)
        SELECT id, action_key, kept FROM k""",
    "d5_source_groups": f"{_GROUPS} SELECT group_key, n, canonical_id, array_to_string(types, ',') AS types, array_to_string(statuses, ',') AS statuses, first_at, last_at FROM groups",
    "d5_group_members": f"{_GROUPS} SELECT group_key, unnest(members) AS id FROM groups",
    "d6_merges": f"{_MERGES} SELECT source_id, target_id, 'MERGED_INTO' AS relation_type FROM new",
    "d6_muted": f"{_MERGES} SELECT CASE WHEN id IN (SELECT source_id FROM new) THEN 'muted' ELSE status END AS status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM mem GROUP BY 1",
    "d10_open_candidates": f"WITH {V.MEMORIES}, o AS (SELECT * FROM mem WHERE valid_until IS NULL) SELECT m.id, o.id AS other_id, CAST(row_number() OVER (PARTITION BY m.id ORDER BY o.created_at DESC, o.id DESC) AS INT) AS rank FROM mem m JOIN o ON m.memory_type = o.memory_type AND m.id <> o.id WHERE m.id % 50 = 0 QUALIFY rank <= 5",
    "d10_newest_of_type": f"WITH {V.MEMORIES} SELECT memory_type, id, CAST(row_number() OVER (PARTITION BY memory_type ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM mem WHERE valid_until IS NULL QUALIFY rank <= 5",
    "r10_totals": "SELECT 'memories' AS name, count(*) AS n FROM documents UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events",
    "d11_title_groups": f"WITH {V.MEMORIES}, k AS (SELECT id, left(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 80) AS title_key FROM mem) SELECT title_key, count(*) AS n, min(id) AS first_id FROM k WHERE title_key <> '' GROUP BY title_key HAVING count(*) > 1",
    "r5_quality_rules": f"{_REVIEWS} SELECT id, array_to_string(flags, ',') AS flags, duplicate_count, review_status, retention_class, recall_policy, quality_score, needs_llm FROM reviews",
    "r6_quality_audit": f"{_REVIEWS}, {V.SESSIONS}, x AS (SELECT id, 'review_status' AS kind, review_status AS value FROM reviews UNION ALL SELECT id, 'retention_class', retention_class FROM reviews UNION ALL SELECT id, 'recall_policy', recall_policy FROM reviews UNION ALL SELECT id, 'flag', unnest(flags) FROM reviews UNION ALL SELECT session_id, 'missing_title', agent FROM src WHERE title_source = 'missing') SELECT kind, value, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS samples FROM x GROUP BY kind, value",
    "r13_worklist": f"{_REVIEWS} SELECT id, created_at FROM reviews JOIN mem USING (id) WHERE needs_llm AND id % 2 <> 0 ORDER BY created_at, id LIMIT 25",
    "a1_memory_list": f"WITH {V.MEMORIES}, {_HOMES}, o AS (SELECT mem.*, display_title, count(*) OVER () AS total FROM mem JOIN homes USING (session_id) WHERE NOT is_superseded AND status = 'active' AND agent = 'agent 1' AND (contains(lower(title), 'the') OR contains(lower(summary), 'the') OR contains(lower(raw_text), 'the'))) SELECT id, pinned, created_at, display_title, total FROM o ORDER BY pinned DESC, created_at DESC, id LIMIT 30 OFFSET 5",
    "a1_session_list": f"WITH {V.MEMORIES}, {_HOMES}, o AS (SELECT mem.*, agent, title_source, count(*) OVER () AS total FROM mem JOIN homes USING (session_id) WHERE NOT is_superseded AND status <> 'deleted' AND session_id = 'web2') SELECT id, status, agent, title_source, total FROM o ORDER BY pinned DESC, created_at DESC, id LIMIT 40",
    "a2_status_breakdown": f"WITH {V.MEMORIES} SELECT CASE WHEN is_superseded THEN 'superseded' ELSE status END AS state, count(*) AS n FROM mem GROUP BY 1",
    "a3_page": f"WITH {V.MEMORIES}, m AS (SELECT id, count(*) OVER () AS total FROM mem WHERE contains(lower(title), 'ion') OR contains(lower(summary), 'ion')) SELECT id, total FROM m ORDER BY id LIMIT 20 OFFSET 10",
    "a7_valid_at": f"WITH {V.MEMORIES} SELECT id FROM mem WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15')",
    "r10_store_stats": f"WITH {V.TAGS} SELECT 'table' AS kind, 'memories' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'table', 'turns', count(*)::DOUBLE FROM conversations UNION ALL SELECT 'table', 'events', count(*)::DOUBLE FROM events UNION ALL (SELECT 'tag', name, round(storage_strength * retrieval_strength, 6) FROM tags WHERE NOT is_dormant ORDER BY storage_strength * retrieval_strength DESC, name LIMIT 5)",
    "r12_new_since": f"WITH {V.MEMORIES} SELECT count(*) FILTER (created_at > TIMESTAMP '2024-01-15') AS n_new, count(*) FILTER (created_at > TIMESTAMP '2024-01-15') >= 5 AS due FROM mem",
    "j6_unbound": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j9_content_audit": f"""WITH {V.TURNS}, st AS (SELECT session_id, turn_index, CASE WHEN (session_id + turn_index) % 7 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN (session_id + turn_index) % 3 = 0 THEN '' ELSE content END AS content, CASE WHEN (session_id + turn_index) % 2 = 0 THEN sha256(content) ELSE '' END AS content_hash, agent FROM turns),
        j AS (SELECT st.*, t.role AS r, t.content AS c FROM st LEFT JOIN turns t USING (session_id, turn_index))
        SELECT agent, CASE WHEN c IS NULL THEN 'missing_text' WHEN NOT (role = r AND (content_hash = '' OR content_hash = sha256(c))) THEN 'mismatched' WHEN trim(content) <> '' THEN 'has_content' ELSE 'fillable' END AS state, count(*) AS n FROM j GROUP BY 1, 2""",
    "j9_filled": f"""WITH {V.TURNS}, st AS (SELECT session_id, turn_index, content AS c, (session_id + turn_index) % 7 = 0 AND role <> 'tool' AS other, (session_id + turn_index) % 3 = 0 AS blank FROM turns) SELECT session_id, turn_index, sha256(CASE WHEN blank AND other THEN '' ELSE c END) AS h FROM st""",
    "j7_uncovered": f"WITH {V.MEMORIES} SELECT session_id, count(*) AS n_memories FROM mem WHERE status NOT IN ('deleted', 'wrong', 'muted') AND session_id NOT IN (SELECT session_id FROM mem WHERE id % 97 = 0 AND session_id IS NOT NULL) GROUP BY session_id HAVING count(*) >= 3",
    "j5_pending_imports": "SELECT conv_id % 3 AS source, CASE WHEN conv_id % 4 = 0 THEN 'new' WHEN conv_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1, 2",
    "g11_keyword_tags": """WITH w AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents), tf AS (SELECT doc, term, count(*) AS tf FROM w WHERE length(term) > 1 GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sz AS (SELECT doc, sum(tf) AS size FROM tf GROUP BY doc),
        x AS (SELECT doc, term, tf / size::DOUBLE * ln((SELECT count(*) FROM documents) / df::DOUBLE) AS weight FROM tf JOIN df USING (term) JOIN sz USING (doc))
        SELECT doc, term, round(weight, 6) AS weight FROM x WHERE weight > 0.05 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY round(weight, 9) DESC, term) <= 6""",
    "v4_bm25": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_BM25}",
    "v4_indexed": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_BM25}",
    "v4_removed": f"WITH {V.MEMORIES}, src AS (SELECT id, concat_ws(chr(10), title, summary, raw_text) AS text FROM mem WHERE NOT is_superseded), {_BM25}",
    "v4_build": f"SELECT term, count(*) AS df, CAST(max(tf) AS INT) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "j2_title_ranges": """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), f AS (SELECT user_id * 1000 + (t // 86400) % 1000 AS file_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1),
        ti AS (SELECT event_id % 300 AS title_id, min(t) AS c, min(t) + 40000 AS d FROM e WHERE event_id % 5 = 0 GROUP BY 1),
        m AS (SELECT file_id, title_id, least(b, d + 900) - greatest(a, c - 900) AS o, CASE WHEN c - 900 <= a AND d + 900 >= b THEN b - a + 1 ELSE 0 END AS full_ FROM f JOIN ti ON least(b, d + 900) >= greatest(a, c - 900)),
        r AS (SELECT file_id, title_id, CAST(o + full_ AS DOUBLE) AS score, row_number() OVER w AS r, lead(o + full_) OVER w AS second FROM m WINDOW w AS (PARTITION BY file_id ORDER BY o + full_ DESC, title_id)),
        x AS (SELECT f.file_id, title_id, score, CASE WHEN title_id IS NULL THEN 'unresolved' WHEN second IS NULL OR score > 1.5 * second THEN 'resolved' ELSE 'ambiguous' END AS status FROM f LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (file_id))
        SELECT file_id, status, CASE WHEN status = 'resolved' THEN title_id END AS title_id, round(score, 6) AS score FROM x""",
}
