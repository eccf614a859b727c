"""Queries over conversations: pairs, episodes, memories with evidence, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import text as X
from recallspark.operators import quality, reports, turns
from recallspark.plans import views as V
from recallspark.sources.scratch import saved, scratch_path
from recallspark.streaming import ingest


def _chain(s, d):
    t = V.turns(s, d)
    linked = turns.episode_turns(t)
    found = turns.episodes(linked)
    memories = turns.extract(t, found)
    return t, linked, found, memories, turns.evidence(memories)


def _states(s, d):
    """What reviewers decided about some sessions."""
    k = F.col("session_id")
    return V.source_sessions(s, d).where(k % 6 == 0).select("session_id", F.when(k % 12 == 0, "").otherwise("manual_done").alias("review_status"))


def _turn_reviews(s, d):
    k = F.col("session_id") + F.col("turn_index")
    return V.turns(s, d).where(k % 3 == 0).select("session_id", "turn_index", F.when(k % 2 == 0, "deleted").otherwise("approved").alias("review_status"), F.concat(F.lit("n"), k.cast("string")).alias("review_note"))


def flagship(s, d):
    """Conversations to episodes, memories and evidence, their quality classes, and the coverage board over them."""
    t = V.sourced_turns(s, d)
    linked = turns.episode_turns(t)
    found = saved(turns.episodes(linked), "episodes")
    memories = saved(turns.extract(t, found), "memories")
    links = turns.evidence(memories)
    proof = links.where("evidence_role = 'support'").select(F.col("memory_id").alias("id"))
    reviews = quality.rules(memories.select(F.col("memory_id").alias("id"), "title", "summary"), proof)
    return turns.coverage(t, found, memories, links, reviews, _states(s, d))


def _watched(s, d):
    """Turns as a stream that comes in two parts, each a micro-batch of its own."""
    source, out, check = (scratch_path(s, x) for x in ("stream", "watched", "state"))
    t = V.turns(s, d)
    schema = t.select("session_id", "turn_index", "role", "content").schema
    for part in (F.col("turn_index") < 3, F.col("turn_index") >= 3):
        t.where(part).select("session_id", "turn_index", "role", "content").write.mode("append").parquet(source)
        ingest.run_once(ingest.watched(s.readStream.schema(schema).parquet(source)), out, check).awaitTermination()
    return s.read.parquet(out)


QUERIES = {
    "r1_turn_pairs": lambda s, d: turns.pair(V.turns(s, d)),
    "r2_episode_turns": lambda s, d: turns.episode_turns(V.turns(s, d)),
    "r2_placeholders": lambda s, d: turns.placeholders(V.turns(s, d)),
    "r2_episodes": lambda s, d: _chain(s, d)[2],
    "r3_memories": lambda s, d: _chain(s, d)[3],
    "r3_evidence": lambda s, d: _chain(s, d)[4],
    "j1_evidence_chain": lambda s, d: turns.evidence_chain(_chain(s, d)[4], _chain(s, d)[3], V.turns(s, d)).select("memory_id", "session_id", "turn_index", "evidence_role", "role", F.length("evidence").alias("n_chars")),
    "a8_context_before": lambda s, d: turns.context_before(V.turns(s, d), 3, 40).select("session_id", "turn_index", F.array_join("context", "|").alias("context")),
    "a5_turn_counts": lambda s, d: turns.turn_counts(V.turns(s, d)),
    "a5_turn_page": lambda s, d: turns.turn_page(V.sourced_turns(s, d), "reviewable", 20, 50, _turn_reviews(s, d)).select("session_id", "turn_index", "role", "review_status", "review_note", "n_all", "n_reviewable", "n_internal"),
    "a5_internal_page": lambda s, d: turns.turn_page(V.sourced_turns(s, d), "internal", 0, 10, None, F.lit(7)).select("session_id", "turn_index", "role", "review_status", "n_all", "n_reviewable", "n_internal"),
    "r4_import_report": lambda s, d: turns.import_report(V.sourced_turns(s, d).withColumn("agent", F.concat(F.lit("agent "), F.col("agent").cast("string"))), V.source_sessions(s, d)).withColumn("title_sources", F.array_join(F.transform(F.map_entries("title_sources"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")),
    "r7_coverage": flagship,
    "r7_board_turns": lambda s, d: turns.board_page(flagship(s, d), V.source_sessions(s, d), "talk", "sessions", "turns_desc", 3, 15).select("session_id", "turns", "reviewable", "updated_at", "total"),
    "r7_board_coverage": lambda s, d: turns.board_page(flagship(s, d), V.source_sessions(s, d), "", "missing_titles", "coverage_asc", 0, 20).select("session_id", "turns", "reviewable", "display_title_source", "total"),
    "r7_board_newest": lambda s, d: turns.board_page(flagship(s, d), V.source_sessions(s, d), "agent 1").select("session_id", "display_title", "review_status", "total"),
    "x1_watched": _watched,
    "r8_source_stats": lambda s, d: reports.source_stats(V.source_sessions(s, d), V.sourced_turns(s, d), _chain(s, d)[4], 2),
    "t7_display_titles": lambda s, d: V.turns(s, d).select("session_id", "turn_index", X.compact_display_title("content", F.col("role"))["title"].alias("title"), X.is_memory_subject_text("content").alias("subject")),
    "t9_value_gate": lambda s, d: V.turns(s, d).select("session_id", "turn_index", X.value_gate("content").alias("g")).select("session_id", "turn_index", "g.total", "g.verdict", "g.reason"),
}
_EP = f"""WITH {V.TURNS}, marked AS (SELECT *, role = 'user' AND {V.subject_sql("content")} AS starts FROM turns),
  linked AS (SELECT session_id, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index) AS BIGINT) AS episode_no, turn_index, role,
    CASE WHEN starts THEN 'trigger' WHEN role = 'assistant' THEN 'final_answer' ELSE 'context' END AS role_in_episode, CASE WHEN starts THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM marked QUALIFY episode_no > 0),
  eps AS (SELECT session_id, episode_no, min(turn_index) AS start_turn, max(turn_index) AS end_turn, count(*) AS n_turns, min(turn_index) FILTER (role_in_episode = 'final_answer') AS answer_turn FROM linked GROUP BY ALL),
  eps2 AS (SELECT *, 'ep_' || left(sha256(session_id::VARCHAR || '|' || start_turn::VARCHAR), 24) AS episode_id, 'Episode ' || episode_no::VARCHAR AS title FROM eps),
  mems0 AS (SELECT e.*, trim(regexp_replace(t.content, '[\\s\\p{{Z}}]+', ' ', 'g')) AS q FROM eps2 e JOIN turns t ON t.session_id = e.session_id AND t.turn_index = e.start_turn),
  mems AS (SELECT 'mem_' || left(sha256(session_id::VARCHAR || '|' || episode_id), 24) AS memory_id, session_id, episode_id, left(q, 42) || CASE WHEN length(q) > 42 THEN '…' ELSE '' END AS title,
    left(q, 240) || CASE WHEN length(q) > 240 THEN '...' ELSE '' END AS summary, start_turn AS source_turn, answer_turn AS support_turn FROM mems0),
  ev AS (SELECT memory_id, session_id, source_turn AS turn_index, 'source' AS evidence_role, 1.0::DOUBLE AS weight FROM mems UNION ALL SELECT memory_id, session_id, support_turn, 'support', 0.5::DOUBLE FROM mems WHERE support_turn IS NOT NULL)"""
_GOOD = "(role IN ('user', 'assistant') AND length(trim(coalesce(content, ''))) > 0)"
_COUNTED = f"""WITH {V.SOURCED}, g AS (SELECT *, {_GOOD} AND NOT is_tool_call AND NOT is_tool_result AS good FROM turns),
  c AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_all, count(*) FILTER (good) OVER (PARTITION BY session_id) AS n_reviewable, count(*) FILTER (NOT good) OVER (PARTITION BY session_id) AS n_internal FROM g)"""
_BOARD = f"""{_EP.replace(V.TURNS, V.SOURCED).replace("WHEN role = 'assistant' THEN 'final_answer'", "WHEN role = 'assistant' THEN 'final_answer' WHEN is_tool_call OR is_tool_result THEN 'tool_support'")},
  tk AS (SELECT *, left(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 80) AS k FROM mems), tc AS (SELECT k, count(*) AS n FROM tk WHERE k <> '' GROUP BY k),
  cl AS (SELECT session_id, memory_id, CASE WHEN {" OR ".join(f"contains(lower(title || chr(10) || summary), '{t}')" for t in X.POLLUTION)} THEN 1 WHEN {" OR ".join(f"contains(lower(title || chr(10) || summary), '{t}')" for t in X.TEMPORARY)} THEN 2 WHEN support_turn IS NULL THEN 3 WHEN coalesce(n, 1) > 1 THEN 4 ELSE 5 END AS c FROM tk LEFT JOIN tc USING (k)),
  mc AS (SELECT session_id, count(*) AS memories, count(*) FILTER (c = 5) AS long_term, count(*) FILTER (c = 2) AS temporary_task, count(*) FILTER (c = 1) AS noise, count(*) FILTER (c = 4) AS project_state, count(*) FILTER (c >= 3) AS needs_llm FROM cl GROUP BY session_id),
  ec AS (SELECT session_id, count(*) AS episodes FROM eps2 GROUP BY 1), vc AS (SELECT session_id, count(*) AS evidence FROM (SELECT DISTINCT session_id, memory_id, turn_index, evidence_role FROM ev) GROUP BY 1),
  tn AS (SELECT session_id, count(*) AS turns, count(*) FILTER ({_GOOD}) AS reviewable, count(*) FILTER (role IN ('user', 'assistant') AND NOT {_GOOD} AND content_length > 0) AS pending, count(*) FILTER (NOT {_GOOD}) AS internal, count(*) FILTER (is_tool_call) AS tool_calls, count(*) FILTER (is_tool_result) AS tool_results FROM turns GROUP BY session_id),
  bd AS (SELECT tn.*, coalesce(episodes, 0) AS episodes, coalesce(evidence, 0) AS evidence, coalesce(memories, 0) AS memories, coalesce(long_term, 0) AS long_term, coalesce(temporary_task, 0) AS temporary_task, coalesce(noise, 0) AS noise, coalesce(project_state, 0) AS project_state, coalesce(needs_llm, 0) AS needs_llm FROM tn LEFT JOIN ec USING (session_id) LEFT JOIN vc USING (session_id) LEFT JOIN mc USING (session_id)),
  board AS (SELECT *, CASE WHEN session_id % 6 = 0 AND session_id % 12 <> 0 THEN 'manual_done' WHEN memories <= 0 THEN 'rule_processed' WHEN needs_llm > 0 THEN 'needs_llm' WHEN noise + temporary_task + project_state > 0 THEN 'needs_review' ELSE 'rule_processed' END AS review_status FROM bd)"""
ORACLES = {
    "r1_turn_pairs": f"""WITH {V.TURNS}, said AS (SELECT session_id, turn_index, role, trim(coalesce(content, '')) AS c FROM turns WHERE length(trim(coalesce(content, ''))) >= 30 AND role IN ('user', 'assistant')),
        n AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index) AS BIGINT) AS pair_no FROM said)
        SELECT session_id, pair_no, left(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || c, chr(10) ORDER BY turn_index), 5000) AS text FROM n WHERE pair_no > 0 GROUP BY session_id, pair_no""",
    "r2_episode_turns": f"{_EP} SELECT session_id, episode_no, turn_index, role, role_in_episode, weight FROM linked",
    "r2_placeholders": f"""WITH {V.TURNS}, n AS (SELECT *, sum(CASE WHEN role = 'user' AND length(content) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index) AS no FROM turns),
        e AS (SELECT session_id, no, min(turn_index) AS start_turn, max(turn_index) AS end_turn, count(*) AS n_turns, sha256(arg_min(content, turn_index)) AS h FROM n WHERE no > 0 GROUP BY session_id, no),
        i AS (SELECT *, 'ep_' || left(sha256(session_id::VARCHAR || '|' || start_turn::VARCHAR || '|' || h), 24) AS episode_id FROM e)
        SELECT 'mem_' || left(sha256(episode_id || '|' || h), 24) AS memory_id, session_id, episode_id, 'Memory ' || CAST(no AS BIGINT)::VARCHAR AS title, start_turn, end_turn, n_turns, 'turn' AS granularity, 'user_claim' AS speaker_scope, 0.5::DOUBLE AS confidence FROM i""",
    "r2_episodes": f"{_EP} SELECT session_id, episode_no, start_turn, end_turn, n_turns, answer_turn, episode_id, title FROM eps2",
    "r3_memories": f"{_EP} SELECT * FROM mems",
    "r3_evidence": f"{_EP} SELECT * FROM ev",
    "j1_evidence_chain": f"{_EP} SELECT ev.memory_id, ev.session_id, ev.turn_index, evidence_role, t.role, CAST(length(t.content) AS INT) AS n_chars FROM ev JOIN mems USING (memory_id) JOIN turns t ON t.session_id = ev.session_id AND t.turn_index = ev.turn_index",
    "a8_context_before": f"WITH {V.TURNS} SELECT session_id, turn_index, coalesce(array_to_string(list(left(content, 40)) OVER (PARTITION BY session_id ORDER BY turn_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS context FROM turns",
    "a5_turn_counts": f"WITH {V.TURNS} SELECT session_id, count(*) AS n_all, count(*) FILTER ({_GOOD}) AS n_reviewable, count(*) FILTER (NOT {_GOOD}) AS n_internal FROM turns GROUP BY session_id",
    "a5_turn_page": f"""{_COUNTED}, o AS (SELECT * FROM c WHERE good ORDER BY session_id, turn_index LIMIT 50 OFFSET 20) SELECT session_id, turn_index, role, CASE WHEN (session_id + turn_index) % 6 = 0 THEN 'deleted' WHEN (session_id + turn_index) % 3 = 0 THEN 'approved' ELSE 'active' END AS review_status,
        CASE WHEN (session_id + turn_index) % 3 = 0 THEN 'n' || (session_id + turn_index)::VARCHAR ELSE '' END AS review_note, n_all, n_reviewable, n_internal FROM o""",
    "a5_internal_page": f"{_COUNTED} SELECT session_id, turn_index, role, 'active' AS review_status, n_all, n_reviewable, n_internal FROM c WHERE session_id = 7 AND NOT good ORDER BY turn_index LIMIT 10",
    "r4_import_report": f"""WITH {V.SOURCED}, {V.SESSIONS}, r AS (SELECT 'agent ' || agent::VARCHAR AS agent, count(DISTINCT session_id) AS sessions, count(*) AS turns, count(*) FILTER (role = 'user' AND {V.subject_sql("content")}) AS episodes, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (is_tool_call) AS tool_calls, count(*) FILTER (is_tool_result) AS tool_results,
        count(*) FILTER (is_tool_call OR is_tool_result OR role NOT IN ('user', 'assistant')) AS process_turns, count(*) FILTER (length(trim(content)) < 30 AND NOT is_tool_call AND NOT is_tool_result) AS low_value FROM turns GROUP BY 1),
        k AS (SELECT agent, title_source, count(*) AS n FROM src GROUP BY ALL), t AS (SELECT agent, CAST(coalesce(sum(n) FILTER (title_source <> 'missing'), 0) AS BIGINT) AS titled, CAST(coalesce(sum(n) FILTER (title_source = 'missing'), 0) AS BIGINT) AS missing_titles, string_agg(title_source || '=' || n::VARCHAR, ',' ORDER BY title_source) AS title_sources FROM k GROUP BY agent)
        SELECT r.*, episodes AS memories, titled, missing_titles, title_sources FROM r JOIN t USING (agent)""",
    "r7_coverage": f"{_BOARD} SELECT * FROM board",
    "r7_board_turns": f"{_BOARD}, {V.SESSIONS}, o AS (SELECT *, count(*) OVER () AS total FROM src LEFT JOIN board USING (session_id) WHERE contains(lower(display_title), 'talk')) SELECT session_id, turns, reviewable, updated_at, total FROM o ORDER BY turns DESC, updated_at DESC, session_id LIMIT 15 OFFSET 3",
    "r7_board_coverage": f"{_BOARD}, {V.SESSIONS}, o AS (SELECT *, count(*) OVER () AS total FROM src LEFT JOIN board USING (session_id) WHERE title_source = 'missing' OR display_title_source <> 'agent_original') SELECT session_id, turns, reviewable, display_title_source, total FROM o ORDER BY reviewable / turns::DOUBLE, turns DESC, session_id LIMIT 20",
    "r7_board_newest": f"{_BOARD}, {V.SESSIONS}, o AS (SELECT *, count(*) OVER () AS total FROM src LEFT JOIN board USING (session_id) WHERE agent = 'agent 1') SELECT session_id, display_title, review_status, total FROM o ORDER BY updated_at DESC, session_id LIMIT 20",
    "x1_watched": f"""WITH {V.TURNS}, m AS (SELECT session_id, turn_index, role, trim(coalesce(content, '')) AS c FROM turns WHERE role IN ('user', 'assistant')), b AS (SELECT * FROM (VALUES (0, 3), (1, 1000000000)) AS v(b, until)),
        w AS (SELECT m.*, b FROM m JOIN b ON turn_index < until QUALIFY row_number() OVER (PARTITION BY session_id, b ORDER BY turn_index DESC) <= 10),
        a AS (SELECT session_id, b FROM m JOIN b ON (turn_index >= 3) = (b = 1) WHERE role = 'assistant' AND length(c) >= 30 GROUP BY ALL),
        l AS (SELECT session_id, b, max(turn_index) AS turn_index, list('User: ' || c ORDER BY turn_index) FILTER (role = 'user' AND length(c) >= 30) AS u, list('Assistant: ' || c ORDER BY turn_index) FILTER (role = 'assistant' AND length(c) >= 30) AS v FROM w JOIN a USING (session_id, b) GROUP BY ALL),
        n AS (SELECT *, greatest(coalesce(len(u), 0), coalesce(len(v), 0)) AS n FROM l)
        SELECT session_id, turn_index, concat_ws(chr(10), u[n - 1], v[n - 1], u[n], v[n]) AS conversation FROM n WHERE n > 1 UNION ALL SELECT session_id, turn_index, concat_ws(chr(10), u[n], v[n]) FROM n WHERE n = 1""",
    "r8_source_stats": f"""{_EP}, {V.SESSIONS}, k AS (SELECT 'agent' AS dimension, agent AS value, count(*) AS n FROM src GROUP BY 2 UNION ALL SELECT 'title_source', title_source, count(*) FROM src GROUP BY 2 UNION ALL SELECT 'display_title_source', display_title_source, count(*) FROM src GROUP BY 2)
        SELECT * FROM k WHERE dimension <> 'agent' UNION ALL (SELECT * FROM k WHERE dimension = 'agent' ORDER BY n DESC, value LIMIT 2) UNION ALL SELECT 'total', 'source_sessions', count(*) FROM src UNION ALL SELECT 'total', 'missing_titles', count(*) FROM src WHERE title_source = 'missing' UNION ALL SELECT 'total', 'memories_with_evidence', count(DISTINCT memory_id) FROM ev
        UNION ALL SELECT 'total', 'turns', count(*) FROM conversations UNION ALL SELECT 'total', 'tool_turns', count(*) FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 7 <= 1""",
    "t7_display_titles": f"""WITH {V.TURNS}, q AS (SELECT *, trim(regexp_replace(content, '[\\s\\p{{Z}}]+', ' ', 'g')) AS q FROM turns)
        SELECT session_id, turn_index, CASE WHEN q <> '' THEN left(q, 36) || CASE WHEN length(q) > 36 THEN '…' ELSE '' END ELSE role END AS title, {V.subject_sql("content")} AS subject FROM q""",
    "t9_value_gate": f"""WITH {V.TURNS}, q AS (SELECT *, regexp_replace(content, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS s FROM turns),
        r AS (SELECT *, CASE WHEN length(s) < 30 THEN 'short' WHEN regexp_matches(s, '^https?://') AND length(s) < 80 THEN 'url' WHEN starts_with(s, 'toolCall') OR starts_with(s, 'toolResult') OR starts_with(s, 'thinking') THEN 'process' ELSE 'length' END AS reason FROM q),
        t AS (SELECT *, CASE WHEN reason <> 'length' THEN 0.0 WHEN length(s) > 500 THEN 3.3 WHEN length(s) > 200 THEN 2.3 WHEN length(s) > 100 THEN 2.0 ELSE 1.3 END::DOUBLE AS total FROM r)
        SELECT session_id, turn_index, total, CASE WHEN reason <> 'length' THEN 'skip' WHEN total >= 3.0 THEN 'write' WHEN total >= 2.5 THEN 'gray' ELSE 'skip' END AS verdict, reason FROM t""",
}
