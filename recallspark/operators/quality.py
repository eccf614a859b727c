"""Rule-based quality classes, the audit over them, and applying tables of external verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.functions.text import quality_flags, title_key

# The class of each finding, by precedence.
CLASSES = [
    ("pollution", ("auto_rejected", "noise", "exclude", 0.05, False)),
    ("temporary", ("auto_muted", "temporary_task", "exclude_default", 0.25, False)),
    ("low_evidence", ("auto_flagged", "candidate", "downrank", 0.35, True)),
    ("duplicate_candidate", ("auto_flagged", "project_state", "downrank", 0.55, True)),
    ("", ("auto_accepted", "long_term", "include", 0.82, True)),
]
FIELDS = ("review_status", "retention_class", "recall_policy", "quality_score", "needs_llm")


def rules(memories: DataFrame, links: DataFrame) -> DataFrame:
    """id, flags, duplicate_count and the review of each memory (id, title, summary), by evidence links (id) and titles.

    Title counts are pre-aggregated and joined, so a title that comes often is no burden to one task.
    """
    proof = links.groupBy("id").agg(F.count("*").alias("evidence_count"))
    keyed = memories.withColumn("title_key", title_key("title"))
    counts = keyed.where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("duplicate_count"))
    own = keyed.join(proof, "id", "left").join(counts, "title_key", "left").fillna(1, ["duplicate_count"]).fillna(0, ["evidence_count"])
    more = F.array_compact(F.array(F.when(F.col("evidence_count") <= 0, "low_evidence"), F.when(F.col("duplicate_count") > 1, "duplicate_candidate")))
    own = own.withColumn("flags", F.concat(quality_flags("title", "summary"), more))
    has = lambda name: F.exists("flags", lambda f: f.startswith(name)) if name else F.lit(True)
    case = None
    for name, values in CLASSES:
        struct = F.struct(*[F.lit(v).alias(f) for v, f in zip(values, FIELDS, strict=True)])
        case = F.when(has(name), struct) if case is None else case.when(has(name), struct)
    return own.withColumn("_r", case).select("id", "flags", "duplicate_count", *[F.col(f"_r.{f}").alias(f) for f in FIELDS])


def audit(reviews: DataFrame, samples: int = 3, sessions: DataFrame | None = None) -> DataFrame:
    """Counts by status, class and policy, and of each flag, with the smallest ids as samples; and of sessions (session_id, agent, title_source) without a title, by agent."""
    kinds = F.explode(F.concat(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in FIELDS[:3]]), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("value")))))
    own = reviews.select("id", kinds.alias("x")).select("id", "x.kind", "x.value")
    if sessions is not None:
        own = own.union(sessions.where("title_source = 'missing'").select(F.col("session_id").cast(reviews.schema["id"].dataType), F.lit("missing_title"), "agent"))
    first = W.Window.partitionBy("kind", "value").orderBy("id")
    picked = own.withColumn("r", F.row_number().over(first)).where(F.col("r") <= samples).groupBy("kind", "value").agg(F.sort_array(F.collect_list("id")).alias("samples"))
    return own.groupBy("kind", "value").agg(F.count("*").alias("n")).join(picked, ["kind", "value"])


def worklist(reviews: DataFrame, memories: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The n oldest memories that an external model is to look at and has not."""
    return reviews.where("needs_llm").select("id").join(done.select("id"), "id", "left_anti").join(memories.select("id", "created_at"), "id").orderBy("created_at", "id").limit(n)


def apply_enhancements(memories: DataFrame, results: DataFrame, types: tuple[str, ...], policies: tuple[str, ...]) -> DataFrame:
    """Memories after a table of results (id, title, summary, detail, memory_type, recall_policy, score): cut, checked and clipped."""
    r = results.select(
        "id", F.substring("title", 1, 120).alias("_t"), F.substring("summary", 1, 1000).alias("_s"), F.substring("detail", 1, 3000).alias("_d"),
        F.when(F.upper("memory_type").isin(*types), F.upper("memory_type")).alias("_m"), F.when(F.lower("recall_policy").isin(*policies), F.lower("recall_policy")).alias("_p"),
        F.least(F.greatest(F.coalesce("score", F.lit(0.75)), F.lit(0.0)), F.lit(1.0)).alias("_q"),
    )
    filled = lambda new, old: F.coalesce(F.when(F.trim(new) != "", F.col(new)), F.col(old))
    out = memories.join(r, "id")
    return out.select("id", filled("_t", "title").alias("title"), filled("_s", "summary").alias("summary"), F.coalesce("_d", F.lit("")).alias("summary_detail"), F.coalesce("_m", "memory_type").alias("memory_type"), F.coalesce("_p", F.lit("include")).alias("recall_policy"), F.greatest("confidence", "_q").alias("confidence"), F.col("_q").alias("quality_score"), F.lit(False).alias("needs_llm"))


def apply_extractions(rows: DataFrame) -> DataFrame:
    """A table of extractions (id, title, summary, detail, tags as JSON, relations as JSON) as typed columns.

    Tags are names or {name, category}; names are trimmed and those under two characters dropped, categories in capitals.  Relations need both ends.
    """
    plain = F.from_json("tags", "array<string>")
    tag = F.transform(plain, lambda t: F.struct(F.trim(F.coalesce(F.get_json_object(t, "$.name"), t)).alias("name"), F.upper(F.coalesce(F.get_json_object(t, "$.category"), F.lit("CONCEPT"))).alias("category")))
    rel = F.transform(F.from_json("relations", "array<struct<from:string,to:string,type:string>>"), lambda r: F.struct(F.trim(r["from"]).alias("from"), F.trim(r["to"]).alias("to"), F.upper(F.coalesce(r["type"], F.lit("CO_OCCUR"))).alias("type")))
    return rows.select(
        "id", F.substring("title", 1, 100).alias("title"), F.substring("summary", 1, 500).alias("summary"), F.substring("detail", 1, 1500).alias("detail"),
        F.filter(tag, lambda t: F.length(t["name"]) >= 2).alias("tags"), F.filter(rel, lambda r: (F.length(r["from"]) > 0) & (F.length(r["to"]) > 0)).alias("relations"),
    )


def set_review(states: DataFrame, selected: DataFrame, known: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """States (id, review_status) with a status set for the selected ids, and the selected ids that do not exist."""
    ids = selected.select("id").distinct()
    there = ids.join(known.select("id"), "id", "left_semi")
    new = states.join(there, "id", "left_anti").unionByName(there.withColumn("review_status", F.lit(status)))
    return new, ids.join(known.select("id"), "id", "left_anti")
