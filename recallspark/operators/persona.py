"""Profiles of users: assertions that evidence confirms, refines and replaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from recallspark.functions.text import is_persona_relevant, text_of
from recallspark.operators.ranges import numbered
from recallspark.operators.retrieval import group_topk, usable, vector_topk
from recallspark.sources.scratch import saved

# Similarity to the profile from which a question is answered by it, by level of intrusion.
THRESHOLDS = (0.15, 0.30, 0.50, 0.65, 0.80)


def baseline_sample(memories: DataFrame, share: float = 0.2) -> DataFrame:
    """All memories of signal levels 1 and 2, and the most confident share (at least one) of level 0, which is ranked by ranges, not in one task."""
    low = memories.where("signal_level = 0").select("id", "confidence", F.lit(0).alias("_level"))
    ranked = numbered(low, ["_level"], [F.desc("confidence"), F.asc("id")], "id")
    n = low.count()
    chosen = ranked.where(F.col("k") <= max(1, int(n * share + 1e-9))).select("id")
    return memories.where("signal_level > 0").unionByName(memories.where("signal_level = 0").join(chosen, "id", "left_semi"))


def prefilter(memories: DataFrame, cursor: Column | None = None, least: int = 50, newest: int = 50) -> DataFrame:
    """id, state of live memories newer than the cursor, or of the newest ones where there is none: short, irrelevant or checked."""
    relevant = is_persona_relevant("raw_text", "title", "summary", F.col("memory_type"), F.col("signal_level"))
    text = F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), text_of("summary"))
    state = F.when(F.length(F.trim(text)) < least, "short").when(~relevant, "irrelevant").otherwise("checked")
    live = memories.where(~F.col("is_superseded"))
    own = live.where(F.col("created_at") > cursor) if cursor is not None else live.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    return own.select("id", state.alias("state"))


def assertion_pairs(memories: DataFrame, assertions: DataFrame, k: int = 8, least: float = 0.12) -> DataFrame:
    """qid, id, score: the unlocked assertions that are nearest to each memory, if near enough."""
    own = assertions.where(~F.col("locked") & ~F.col("is_superseded"))
    found = vector_topk(memories.select(F.col("id").alias("qid"), "vec"), own.select("id", "vec"), k)
    return found.where(F.col("score") >= least)


def prefilter_counts(states: DataFrame, pairs: DataFrame, assertions: DataFrame) -> DataFrame:
    """One row: memories, those skipped (short, irrelevant, or without a near assertion), checks, and the checks that were spared against all with all."""
    checked = pairs.select(F.col("qid").alias("id")).distinct().withColumn("_near", F.lit(True))
    own = states.join(checked, "id", "left")
    told = (F.col("state") == "checked") & F.coalesce("_near", F.lit(False))
    one = own.agg(F.count("*").alias("memories"), F.sum(F.when(told, 0).otherwise(1)).alias("skipped"))
    checks, all_ = pairs.agg(F.count("*").alias("checks")), assertions.where(~F.col("locked") & ~F.col("is_superseded")).agg(F.count("*").alias("_n"))
    joined = one.join(F.broadcast(checks)).join(F.broadcast(all_))  # one row each
    return joined.select("memories", "skipped", "checks", (F.col("memories") * F.col("_n") - F.col("checks")).alias("saved"))


def apply_verdicts(assertions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Assertions (id, dimension, assertion, confidence, evidences, is_superseded) after verdicts (id, ts, memory_id, verdict, delta, new_text).

    confirm adds its delta, to 1 at most, and its evidence; supersede marks the old one and adds the new text; refine adds the new text.  Sums of
    deltas do not depend on order, as each is clipped at 1 and none is negative.
    """
    good = verdicts.where(F.col("verdict").isin("confirm", "refine", "supersede"))
    step = good.groupBy("id").agg(
        F.sum(F.when(F.col("verdict") == "confirm", F.greatest("delta", F.lit(0.0))).otherwise(0.0)).alias("_d"),
        F.sort_array(F.collect_set(F.when(F.col("verdict") == "confirm", F.col("memory_id")))).alias("_e"), F.max(F.col("verdict") == "supersede").alias("_x"),
    )
    old = assertions.join(step, "id", "left").select(
        "id", "dimension", "assertion", F.least(F.lit(1.0), F.col("confidence") + F.coalesce("_d", F.lit(0.0))).alias("confidence"),
        F.array_union("evidences", F.coalesce("_e", F.col("evidences"))).alias("evidences"), (F.col("is_superseded") | F.coalesce("_x", F.lit(False))).alias("is_superseded"),
    )
    new = good.where(F.col("verdict").isin("refine", "supersede") & (F.trim(text_of("new_text")) != "")).join(assertions.select("id", "dimension"), "id")
    name = F.concat_ws("|", F.col("id").cast("string"), "new_text")
    new = new.select(F.concat(F.lit("pa_"), F.substring(F.sha2(name, 256), 1, 24)).alias("id"), "dimension", F.col("new_text").alias("assertion"), F.lit(0.6).cast("double").alias("confidence"), F.array(F.col("memory_id")).alias("evidences"), F.lit(False).alias("is_superseded"))
    return old.withColumn("id", F.col("id").cast("string")).unionByName(new.dropDuplicates(["id"]))


def active_profile(assertions: DataFrame, n: int = 2) -> DataFrame:
    """The most confident assertions of each dimension."""
    order = W.Window.partitionBy("dimension").orderBy(F.desc("confidence"), "id")
    return assertions.where(~F.col("is_superseded")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def route(questions: DataFrame, assertions: DataFrame, level: int = 2, k: int = 5, cited: int = 3) -> DataFrame:
    """qid, mean, best, route, deviates, citations and confidence: whether a question is answered from the profile, from experience or both.

    The mean of the k nearest assertions decides; citations are the nearest ones, unless experience answers, and confidence is their mean
    confidence where the profile does, else 0.  assertions: id, vec, confidence.
    """
    found = vector_topk(questions.select("qid", "vec"), assertions.select("id", "vec"), max(k, cited))
    clipped = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    first = F.col("rank") <= cited
    told = found.join(assertions.select("id", "confidence"), "id")
    own = told.groupBy("qid").agg(
        F.round(F.avg(F.when(F.col("rank") <= k, clipped)), 6).alias("mean"), F.round(F.max(clipped), 6).alias("best"),
        F.array_sort(F.array_compact(F.collect_list(F.when(first, F.struct("rank", "id"))))).alias("_c"), F.round(F.avg(F.when(first, F.col("confidence"))), 2).alias("_m"),
    )
    way = F.when(F.col("mean") < 0.15, "experience").when(F.col("mean") >= THRESHOLDS[level], "persona").otherwise("mixed")
    own = own.withColumn("route", way).withColumn("deviates", (F.col("best") >= 0.2) & (F.col("best") < 0.4))
    ids = F.transform("_c", lambda x: x["id"])
    return own.select("qid", "mean", "best", "route", "deviates", F.when(F.col("route") == "experience", F.array().cast(T.ArrayType(assertions.schema["id"].dataType))).otherwise(ids).alias("citations"), F.when(F.col("route") == "persona", F.col("_m")).otherwise(0.0).alias("confidence"))


def first_come(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (id) that lead if all are taken in turn, and one leads unless an earlier leader is its neighbour (edges: qid, id, the earlier one).

    Rounds decide at once whatever has no undecided neighbour left.  A node with one such neighbour is its opposite, so whatever waits for it waits
    for that neighbour instead: waits get twice as long each round, and a chain of any length is decided in a number of rounds that grows
    with its logarithm.  Each round is written.
    """
    todo = saved(nodes.select("id"), "open")
    waits = saved(edges.select("qid", "id", F.lit(False).alias("other")).distinct(), "waits")  # qid leads if no (id leads) <> other holds
    forced = todo.limit(0)
    leaders = []
    while todo.head(1):
        free = todo.join(waits.select(F.col("qid").alias("id")).distinct(), "id", "left_anti").join(forced, "id", "left_anti")
        now = saved(free.select("id", F.lit(True).alias("leads")).union(forced.select("id", F.lit(False))), "decided")
        leaders.append(now.where("leads").select("id"))
        todo = saved(todo.join(now, "id", "left_anti"), "open")
        waits = waits.join(now.select(F.col("id").alias("qid")), "qid", "left_anti").join(now, "id", "left")
        waits = saved(waits.withColumn("met", F.col("leads") != F.col("other")).where("met is null or met").select("qid", "id", "other", "met").distinct(), "waits")
        both = waits.where("met is null").groupBy("qid", "id").agg(F.count("*").alias("n")).where("n > 1")
        forced = saved(waits.where("met").select(F.col("qid").alias("id")).union(both.select("qid")).distinct(), "forced")
        waits = waits.where("met is null").drop("met").join(forced.withColumnRenamed("id", "qid"), "qid", "left_anti")
        alone = waits.groupBy("qid").agg(F.count("*").alias("n"), F.min("id").alias("next"), F.min("other").alias("turned")).where("n = 1").select(F.col("qid").alias("id"), "next", "turned")
        waits = waits.join(alone, "id", "left").select("qid", F.coalesce("next", "id").alias("id"), F.when(F.col("next").isNull(), F.col("other")).otherwise(F.col("other") == F.col("turned")).alias("other")).distinct()
        waits = saved(waits, "waits")
    return reduce(DataFrame.union, leaders) if leaders else todo


def merge_assertions(assertions: DataFrame, new: DataFrame, least: float = 0.88, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Assertions (id, dimension, confidence, evidences, locked, is_superseded, vec) after new ones (id, dimension, confidence, evidences, vec), and the new ones that say something else.

    New ones come in the order of their ids.  Each joins the nearest live, unlocked assertion of its dimension above a similarity, among those that
    exist and the new ones before it that joined none; what joins brings its evidences, and sets the confidence to the larger of both plus 0.03.
    `within` names a column of the new ones: then a new one only joins another of the same value there, the few that come of one source.
    For each new one the nearest that exists in its dimension is found first, and the pairs of new ones above the similarity; who joins none is settled by first_come.
    """
    own = assertions.where(~F.col("locked") & ~F.col("is_superseded"))
    told = lambda df, key: df.select(F.col("id").alias(key), "vec", F.col("dimension").alias("group"))
    old = saved(group_topk(told(new, "qid"), told(own, "id"), 1, least).select("qid", "id", "score"), "near")
    if within:
        good = new.where(usable("vec")).select("id", "dimension", within, F.col("vec").cast("array<double>").alias("vec"))
        pairs = good.select(F.col("id").alias("qid"), "dimension", within, F.col("vec").alias("_v")).join(good, ["dimension", within]).where((F.col("id") < F.col("qid")) & (F.size("_v") == F.size("vec")))
        dot = F.round(F.aggregate(F.zip_with("_v", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9)
        near = saved(pairs.select("qid", "id", dot.alias("score")).where(F.col("score") > least), "near")
    else:
        near = saved(group_topk(told(new, "qid"), told(new, "id"), None, least).select("qid", "id", "score").where("id < qid"), "near")
    open_ = saved(new.select("id").join(old.select(F.col("qid").alias("id")), "id", "left_anti"), "open")
    edges = near.join(open_.select(F.col("id").alias("qid")), "qid", "left_semi").join(open_, "id", "left_semi").select("qid", "id")
    first = saved(first_come(open_, edges), "first")
    found = old.withColumn("kind", F.lit("old")).union(near.join(first, "id", "left_semi").join(first.select(F.col("id").alias("qid")), "qid", "left_anti").select("qid", "id", "score", F.lit("new")))
    best = found.groupBy("qid").agg(F.max_by(F.struct("kind", "id"), F.struct("score", F.col("kind") == "old", -F.col("id"))).alias("t")).select("qid", "t.kind", F.col("t.id").alias("target"))
    order = W.Window.partitionBy("kind", "target").orderBy("id")
    step = new.join(best.withColumnRenamed("qid", "id"), "id").select("kind", "target", "id", "confidence", "evidences", F.row_number().over(order).alias("i"))
    counted = step.groupBy("kind", "target").agg(F.max("i").alias("n"), F.max(F.col("confidence") - 0.03 * (F.col("i") - 1)).alias("_x"), F.array_sort(F.flatten(F.collect_list("evidences"))).alias("_e"))
    counted = saved(counted, "merged")

    def fold(df: DataFrame, kind: str) -> DataFrame:
        """Each joining one adds 0.03 to the larger confidence, so the last value is the largest of all with what came after them."""
        out = df.join(counted.where(F.col("kind") == kind).drop("kind").withColumnRenamed("target", "id"), "id", "left")
        sure = F.least(F.lit(1.0), F.greatest("confidence", "_x") + 0.03 * F.col("n"))
        proof = F.concat("evidences", F.array_except(F.array_distinct("_e"), "evidences"))
        return out.withColumns({"confidence": F.when(F.col("n").isNotNull(), sure).otherwise(F.col("confidence")), "evidences": F.when(F.col("n").isNotNull(), proof).otherwise(F.col("evidences"))}).drop("n", "_x", "_e")

    return fold(assertions, "old"), fold(new.join(first, "id", "left_semi"), "new")


def edit(assertions: DataFrame, events: DataFrame) -> DataFrame:
    """Assertions (id, assertion, confidence, locked, is_superseded) after events (id, ts, event_id, action, text, confidence): edit, lock, unlock, delete, restore.

    Each field is what the last event that sets it says; confidences are clipped to 0..1.
    """
    at, act = F.struct("ts", "event_id"), F.col("action")
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, at))
    step = events.groupBy("id").agg(
        last(F.col("text"), (act == "edit") & F.col("text").isNotNull()).alias("_t"), last(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), (act == "edit") & F.col("confidence").isNotNull()).alias("_c"),
        last(act == "lock", act.isin("lock", "unlock")).alias("_l"), last(act == "delete", act.isin("delete", "restore")).alias("_x"),
    )
    new = {"assertion": F.coalesce("_t", "assertion"), "confidence": F.coalesce("_c", "confidence"), "locked": F.coalesce("_l", "locked"), "is_superseded": F.coalesce("_x", "is_superseded")}
    return assertions.join(step, "id", "left").withColumns(new).drop("_t", "_c", "_l", "_x")


def edit_audit(assertions: DataFrame, events: DataFrame) -> DataFrame:
    """id, ts, event_id, action, old, new: a row for each field that an event changes; edits to an equal value leave none, locks and deletes always do."""
    clip = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    start = assertions.select("id", F.col("assertion").alias("_t"), F.col("confidence").alias("_c"), F.col("locked").alias("_l"))
    own = events.where(F.col("action").isin("edit", "lock", "unlock", "delete", "restore")).select("id", "ts", "event_id", "action", "text", clip.alias("confidence")).join(start, "id")
    upto = W.Window.partitionBy("id").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, -1)
    act, edit_ = F.col("action"), F.col("action") == "edit"
    before = lambda value, first: F.coalesce(F.last(value, ignorenulls=True).over(upto), first)
    text, sure = F.when(edit_ & (F.col("text") != ""), F.col("text")), F.when(edit_, F.col("confidence"))
    lock = F.when(act.isin("lock", "unlock"), act == "lock")
    own = own.withColumns({"_ot": before(text, F.col("_t")), "_oc": before(sure, F.col("_c")), "_ol": before(lock, F.col("_l"))})
    row = lambda name, old, new: F.struct(F.lit(name).alias("action"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    rows = F.array_compact(F.array(
        F.when(text.isNotNull() & (text != F.col("_ot")), row("edit_assertion", F.col("_ot"), text)), F.when(sure.isNotNull() & (sure != F.col("_oc")), row("edit_confidence", F.col("_oc"), sure)),
        F.when(act == "lock", row("lock", F.col("_ol").cast("int"), F.lit(1))), F.when(act == "unlock", row("unlock", F.col("_ol").cast("int"), F.lit(0))),
        F.when(act == "delete", row("delete", F.lit("active"), F.lit("superseded"))), F.when(act == "restore", row("restore", F.lit("superseded"), F.lit("active"))),
    ))
    return own.select("id", "ts", "event_id", F.inline(rows))
