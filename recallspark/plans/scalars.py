"""Queries over scalar functions and small folds that the others do not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import text as X
from recallspark.operators import dedupe, quality, reports
from recallspark.plans import views as V
from recallspark.plans.memories import _REVIEWS, _reviews

M = V.memories
POLICIES = ("include", "downrank", "exclude", "exclude_default")


def _results(s, d):
    """Verdicts of an external model, one in three of them for memories that are there."""
    k = F.col("id")
    return M(s, d).withColumn("id", F.when(k % 3 == 0, k).otherwise(-k - 1)).select("id", F.when(k % 2 == 0, F.concat(F.lit("New "), F.col("title"))).otherwise(" ").alias("title"), F.lit("").alias("summary"), F.repeat(F.lit("d"), (k % 4000).cast("int")).alias("detail"), F.when(k % 4 == 0, "decision").otherwise("nonsense").alias("memory_type"), F.when(k % 5 == 0, "EXCLUDE").otherwise("what").alias("recall_policy"), F.when(k % 6 == 0, 1.7).when(k % 9 == 0, -0.5).alias("score"))


def _scores():
    """External scores of two memories in three, some beyond 1 to 5."""
    k = F.col("id")
    return F.when(k % 3 != 0, F.array((k % 7).cast("int"), (k % 5).cast("int"), (k % 4 + 1).cast("int"), (k % 9 - 1).cast("int")))


def _titles(s, d):
    u, k = V.read(s, d, "customer"), F.col("c_custkey")
    files = u.select(k.alias("file_id"), F.concat(F.lit("/t/"), k.cast("string")).alias("path"), F.col("c_name").alias("name"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("turn "), k.cast("string"))).alias("first_user_turn"))
    by_path = files.where("file_id % 5 = 0").select("path", F.concat(F.lit("P"), F.col("file_id").cast("string")).alias("title"))
    by_name = files.where("file_id % 3 = 0").select("name", F.concat(F.lit("N"), F.col("file_id").cast("string")).alias("title"))
    by_range = files.where("file_id % 2 = 0").select("file_id", F.concat(F.lit("R"), F.col("file_id").cast("string")).alias("title"))
    return reports.resolve_titles(files, by_path, by_name, by_range)


QUERIES = {
    "t3_compact_keys": lambda s, d: M(s, d).select("id", X.compact_key("raw_text", 40).alias("key"), X.title_summary_key("title", "summary").alias("ts_key")),
    "t5_predicates": lambda s, d: V.operational(s, d).select("id", X.is_structured_operational(F.col("raw_text")).alias("operational"), X.is_persona_relevant("raw_text", "title", "summary", F.col("memory_type"), F.col("signal_level")).alias("persona")),
    "t9_scored_gate": lambda s, d: M(s, d).select("id", X.value_gate("raw_text", _scores()).alias("g")).select("id", "g.total", "g.verdict", "g.reason"),
    "t10_derived": lambda s, d: M(s, d).select("id", X.value_gate("raw_text", _scores()).alias("g"), "signal_level").select("id", X.derived_fields(F.col("g.verdict"), F.col("g.total"), F.col("signal_level") == 2).alias("x")).select("id", "x.confidence", "x.signal_level"),
    "t12_flags": lambda s, d: M(s, d).select("id", F.array_join(X.quality_flags("raw_text", F.lit("")), ",").alias("flags")),
    "t17_paths": lambda s, d: V.read(s, d, "pages").select("page_id", X.redact_home("url", "http://").alias("path")),
    "t18_lengths": lambda s, d: V.read(s, d, "events").select("event_id", X.content_length(F.when(F.col("event_id") % 2 == 0, F.replace(F.col("props"), F.lit('"k"'), F.lit('"content_length"'))).otherwise(F.col("props")), F.col("event_type")).alias("n")),
    "t20_embed_text": lambda s, d: M(s, d).select("id", F.sha2(X.embed_text("title", "summary", "raw_text"), 256).alias("h")),
    "t19_reasons": lambda s, d: M(s, d).select("id", F.array_join(X.reasons(pinned=F.col("pinned"), strong=F.col("signal_level") == 2, muted=F.col("status") == "muted"), ",").alias("reasons")),
    "t19_explanations": lambda s, d: M(s, d).select("id", F.array_join(X.explanation(F.filter(F.array("session_id", "space_id"), lambda t: t.isNotNull()), F.col("memory_type"), F.col("pinned"), F.when(F.col("id") % 29 == 0, "expired").otherwise(F.col("status")), F.col("user_weight") - 0.1), "|").alias("reasons")),
    "r13_enhanced": lambda s, d: quality.apply_enhancements(M(s, d), _results(s, d), V.TYPES, POLICIES).select("id", "title", "summary", F.length("summary_detail").alias("n_detail"), "memory_type", "recall_policy", F.round("confidence", 6).alias("confidence"), "quality_score", "needs_llm"),
    "r14_reviews": lambda s, d: quality.set_review(_reviews(s, d).select("id", "review_status"), V.read(s, d, "labels").select((F.col("doc_id") * 2).alias("id")), M(s, d), "approved")[0].groupBy("review_status").agg(F.count("*").alias("n")),
    "r14_missing": lambda s, d: quality.set_review(_reviews(s, d).select("id", "review_status"), V.read(s, d, "labels").select((F.col("doc_id") * 2).alias("id")), M(s, d), "approved")[1],
    "j3_titles": _titles,
    "a2_live": lambda s, d: dedupe.newest_of_type(M(s, d).where("status = 'active' and not is_superseded"), 3).select("memory_type", "id", "rank"),
}
_CLIP = "least(greatest({}, 1), 5)"
_SCORED = rf"""WITH q AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS s FROM documents),
  r AS (SELECT *, CASE WHEN length(s) < 30 THEN 'short' WHEN regexp_matches(s, '^https?://') AND length(s) < 80 THEN 'url' WHEN starts_with(s, 'toolCall') OR starts_with(s, 'toolResult') OR starts_with(s, 'thinking') THEN 'process' WHEN id % 3 <> 0 THEN 'scored' ELSE 'length' END AS reason FROM q),
  t AS (SELECT *, CASE reason WHEN 'scored' THEN round(0.30::DOUBLE * {_CLIP.format("id % 7")} + 0.30::DOUBLE * {_CLIP.format("id % 5")} + 0.25::DOUBLE * {_CLIP.format("id % 4 + 1")} + 0.15::DOUBLE * {_CLIP.format("id % 9 - 1")}, 2) WHEN 'length' THEN CASE WHEN length(s) > 500 THEN 3.3 WHEN length(s) > 200 THEN 2.3 WHEN length(s) > 100 THEN 2.0 ELSE 1.3 END::DOUBLE ELSE 0.0::DOUBLE END AS total FROM r),
  v AS (SELECT *, CASE WHEN reason NOT IN ('scored', 'length') THEN 'skip' WHEN total >= 3.0 THEN 'write' WHEN total >= 2.5 THEN 'gray' ELSE 'skip' END AS verdict FROM t)"""
ORACLES = {
    "t3_compact_keys": f"WITH {V.MEMORIES}, n AS (SELECT id, {V.normalized_sql('raw_text')} AS t, {V.normalized_sql('title || chr(10) || summary')} AS u FROM mem) SELECT id, CASE WHEN t = '' THEN '' ELSE sha256(left(t, 40)) END AS key, 'ts:' || left(sha256(u), 16) AS ts_key FROM n",
    "t5_predicates": f"""WITH {V.OPERATIONAL}, j AS (SELECT *, raw_text AS joined FROM oper), n AS (SELECT *, {V.ACTION_SQL} AS a FROM j), p AS (SELECT * REPLACE (title || chr(10) || summary || chr(10) || raw_text AS joined) FROM n), q AS (SELECT *, {V.ACTION_SQL} AS b FROM p)
        SELECT id, a <> '' OR regexp_matches(raw_text, '{X.OPERATIONAL}', 'i') AS operational, CASE WHEN memory_type IN ('PREFERENCE', 'DECISION', 'REASONING') THEN true WHEN memory_type = 'EVENT' AND signal_level <= 0 AND (b <> '' OR regexp_matches(joined, '{X.OPERATIONAL}', 'i')) THEN false ELSE regexp_matches(joined, '{X.PERSONA}') END AS persona FROM q""",
    "t9_scored_gate": f"{_SCORED} SELECT id, total, verdict, reason FROM v",
    "t10_derived": f"{_SCORED} SELECT id, CASE WHEN verdict = 'gray' THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END AS confidence, CAST(CASE WHEN id % 3 = 2 THEN 2 WHEN total >= 4.0 THEN 1 ELSE 0 END AS INT) AS signal_level FROM v",
    "t12_flags": f"WITH t AS (SELECT doc_id AS id, lower(text) AS b FROM documents) SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(b, '{t}') THEN '{kind}:{t}' END" for kind, ts in (('pollution', X.POLLUTION), ('temporary', X.TEMPORARY)) for t in ts)}], lambda x: x IS NOT NULL), ',') AS flags FROM t",
    "t17_paths": "SELECT page_id, CASE WHEN starts_with(lower(url), 'http://') THEN '~' || substr(url, 8) ELSE url END AS path FROM pages",
    "t18_lengths": "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) ELSE length(event_type) END AS INT) AS n FROM events",
    "t20_embed_text": f"WITH {V.MEMORIES} SELECT id, sha256(title || ' ' || summary || ' ' || left(raw_text, 500)) AS h FROM mem",
    "t19_reasons": f"WITH {V.MEMORIES} SELECT id, array_to_string(list_filter([CASE WHEN pinned THEN 'pinned' END, CASE WHEN signal_level = 2 THEN 'strong' END, CASE WHEN status = 'muted' THEN 'muted' END], lambda x: x IS NOT NULL), ',') AS reasons FROM mem",
    "t19_explanations": f"""WITH {V.MEMORIES}, m AS (SELECT *, CASE WHEN id % 29 = 0 THEN 'expired' ELSE status END AS st, user_weight - 0.1 AS w FROM mem) SELECT id, concat_ws('|', CASE WHEN session_id IS NOT NULL OR space_id IS NOT NULL THEN '{X.EXPLAINED["tags"]}' || concat_ws('、', session_id, space_id) END, CASE WHEN memory_type IN ('DECISION', 'PREFERENCE', 'REASONING') THEN '{X.EXPLAINED["judgement"]}' END, CASE WHEN pinned THEN '{X.EXPLAINED["pinned"]}' END,
        {", ".join(f"CASE WHEN st = '{k}' THEN '{X.EXPLAINED[k]}' END" for k in ("active", "expired", "wrong", "muted", "deleted"))}, CASE WHEN w > 1.05 THEN '{X.EXPLAINED["raised"]}' WHEN w < 0.95 AND st NOT IN ('wrong', 'muted', 'deleted') THEN '{X.EXPLAINED["lowered"]}' END) AS reasons FROM m""",
    "r13_enhanced": f"""WITH {V.MEMORIES} SELECT id, CASE WHEN id % 2 = 0 THEN left('New ' || title, 120) ELSE title END AS title, summary, CAST(least(id % 4000, 3000) AS INT) AS n_detail, CASE WHEN id % 4 = 0 THEN 'DECISION' ELSE memory_type END AS memory_type,
        CASE WHEN id % 5 = 0 THEN 'exclude' ELSE 'include' END AS recall_policy, round(greatest(confidence, CASE WHEN id % 6 = 0 THEN 1.0 WHEN id % 9 = 0 THEN 0.0 ELSE 0.75 END), 6) AS confidence, CASE WHEN id % 6 = 0 THEN 1.0 WHEN id % 9 = 0 THEN 0.0 ELSE 0.75 END::DOUBLE AS quality_score, false AS needs_llm FROM mem WHERE id % 3 = 0""",
    "r14_reviews": f"{_REVIEWS}, sel AS (SELECT DISTINCT doc_id * 2 AS id FROM labels) SELECT CASE WHEN id IN (SELECT id FROM sel) THEN 'approved' ELSE review_status END AS review_status, count(*) AS n FROM reviews GROUP BY 1",
    "r14_missing": "SELECT DISTINCT doc_id * 2 AS id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "j3_titles": """WITH c AS (SELECT c_custkey AS k, c_name AS n FROM customer), x AS (SELECT k AS file_id, n, CASE WHEN k % 5 = 0 THEN 'P' || k::VARCHAR WHEN k % 3 = 0 THEN 'N' || k::VARCHAR WHEN k % 2 = 0 THEN 'R' || k::VARCHAR END AS original_title, CASE WHEN k % 5 = 0 THEN 'path' WHEN k % 3 = 0 THEN 'name' WHEN k % 2 = 0 THEN 'range' ELSE 'missing' END AS title_source FROM c)
        SELECT file_id, original_title, title_source, coalesce(original_title, CASE WHEN file_id % 4 <> 0 THEN 'turn ' || file_id::VARCHAR END, n) AS display_title FROM x""",
    "a2_live": f"WITH {V.MEMORIES} SELECT memory_type, id, CAST(row_number() OVER (PARTITION BY memory_type ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM mem WHERE valid_until IS NULL AND status = 'active' AND NOT is_superseded QUALIFY rank <= 3",
}
