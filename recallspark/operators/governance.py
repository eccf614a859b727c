"""Ordered events folded into states: governance of memories, profile assertions and tasks, with an audit row per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

ACTIONS = ("pin", "unpin", "mark_wrong", "mark_expired", "mute", "delete", "restore", "update")


def apply_events(units: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """units (key, status, user_weight, pinned, valid_until, note) after events (key, ts, event_id, action, weight, note).

    pin sets the weight given, or 1.5 at least; unpin takes the pin away; mark_wrong, mute, delete and restore set the status, mark_expired ends
    validity at its time, update sets note and weight where given.  Each field is decided by the last event that sets it.  A weight is set, or raised to 1.5
    at least by a pin that gives none; put together, such steps are one set and one raise behind it, so the last of either kind tells all, and
    events of one unit are aggregated where they stand, however many there are.  Unknown actions and ids change nothing.
    """
    good = events.where(F.col("action").isin(*ACTIONS))
    at = F.struct("ts", "event_id")
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, at))
    act = F.col("action")
    status = F.when(act == "mark_wrong", "wrong").when(act == "mute", "muted").when(act == "delete", "deleted").when(act == "restore", "active")
    sets, raises = act.isin("pin", "update") & F.col("weight").isNotNull(), (act == "pin") & F.col("weight").isNull()
    out = good.groupBy(key).agg(
        last(status, status.isNotNull()).alias("_status"), last(act == "pin", act.isin("pin", "unpin")).alias("_pinned"), last(F.col("ts"), act == "mark_expired").alias("_until"),
        last(F.col("note"), F.col("note").isNotNull()).alias("_note"), last(F.col("weight"), sets).alias("_set"), F.max(F.when(sets, at)).alias("_set_at"), F.max(F.when(raises, at)).alias("_raised"), F.count("*").alias("_n"),
    )
    joined = units.join(out, key, "left")
    later = F.col("_raised").isNotNull() & (F.col("_set_at").isNull() | (F.col("_raised") > F.col("_set_at")))
    base = F.coalesce("_set", "user_weight")
    fold = F.when(later, F.greatest(base, F.lit(1.5))).otherwise(base)
    return joined.select(
        *[c for c in units.columns if c not in ("status", "user_weight", "pinned", "valid_until", "note")],
        F.coalesce("_status", "status").alias("status"), fold.alias("user_weight"), F.coalesce("_pinned", "pinned").alias("pinned"),
        F.coalesce("_until", "valid_until").alias("valid_until"), F.coalesce("_note", "note").alias("note"), F.coalesce("_n", F.lit(0)).alias("n_events"),
    )


def audit(units: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """One row for each field that an event sets (also to an equal value): key, ts, event_id, action, field; rejects are left out."""
    fields = {
        "pin": ("pinned", "user_weight"), "unpin": ("pinned",), "mark_wrong": ("status",), "mark_expired": ("valid_until",),
        "mute": ("status",), "delete": ("status",), "restore": ("status",), "update": ("note", "user_weight"),
    }
    lists = F.create_map(*[x for a, f in fields.items() for x in (F.lit(a), F.array(*[F.lit(c) for c in (*f, "updated_at")]))])
    good = events.where(F.col("action").isin(*ACTIONS)).join(units.select(key), key, "left_semi")
    return good.select(key, "ts", "event_id", "action", F.explode(lists[F.col("action")]).alias("field"))


def rejects(units: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Events of unknown actions or ids, with the reason."""
    known = units.select(key).withColumn("_k", F.lit(True))
    joined = events.join(known, key, "left")
    reason = F.when(~F.col("action").isin(*ACTIONS), "unknown_action").when(F.col("_k").isNull(), "unknown_id")
    return joined.withColumn("reason", reason).where("reason is not null").drop("_k")


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (source_id, target_id, relation_type) with new ones; those that exist stay as they are."""
    keys = ["source_id", "target_id", "relation_type"]
    return links.unionByName(new.dropDuplicates(keys).join(links.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def link_neighbors(links: DataFrame) -> DataFrame:
    return links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other_id"), "relation_type", F.lit("out").alias("direction")).union(links.select("target_id", "source_id", "relation_type", F.lit("in")))


def task_history(tasks: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """What each event (key, ts, event_id, action, status) did to its task: old and new status, whether it took effect, and why not.

    close makes an open task done, reopen a done one open, update sets the status it names; closing what is done or cancelled and reopening what is not
    done change nothing.  Between updates the status follows from the event before and from whether anything was closed since, so
    no event needs the outcome of another.
    """
    order = W.Window.partitionBy(key).orderBy("ts", "event_id")
    upto = order.rowsBetween(W.Window.unboundedPreceding, -1)
    own = events.where(F.col("action").isin("close", "reopen", "update")).join(tasks.select(key, F.col("status").alias("_s")), key)
    sets = F.when((F.col("action") == "update") & F.col("status").isNotNull(), F.col("status"))
    own = own.withColumns({"_sets": sets, "_base": F.coalesce(F.last(sets, ignorenulls=True).over(upto), F.col("_s")), "_part": F.coalesce(F.count(sets).over(upto), F.lit(0)), "_prev": F.lag("action").over(order)})
    within = W.Window.partitionBy(key, "_part").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, -1)
    acts = F.col("action").isin("close", "reopen")
    own = own.withColumns({"_closed": F.coalesce(F.max(F.when(acts, F.col("action") == "close")).over(within), F.lit(False)), "_last": F.last(F.when(acts, F.col("action")), ignorenulls=True).over(within)})
    base = F.col("_base")
    old = F.when(base == "cancelled", base).when(F.col("_last") == "close", "done").when(F.col("_last") == "reopen", F.when((base == "done") | F.col("_closed"), "todo").otherwise(base)).otherwise(base)
    own = own.withColumn("old_status", old)
    done = F.col("old_status").isin("done", "cancelled")
    act = F.col("action")
    reason = F.when((act == "close") & done, F.concat(F.lit("already "), F.col("old_status"))).when((act == "reopen") & (F.col("old_status") != "done"), F.concat(F.lit("is "), F.col("old_status"))).when((act == "update") & (F.col("_sets").isNull() | (F.col("_sets") == F.col("old_status"))), "no change")
    new = F.when(reason.isNotNull(), F.col("old_status")).when(act == "close", "done").when(act == "reopen", "todo").otherwise(F.col("_sets"))
    return own.select(key, "ts", "event_id", "action", "old_status", new.alias("new_status"), reason.isNull().alias("effective"), reason.alias("reason"))


def task_states(tasks: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """Tasks after their history: the status, when it was last completed and reopened, and how many events took effect."""
    own = history.where("effective")
    to_done, from_done = F.col("new_status") == "done", F.col("old_status") == "done"
    last = own.groupBy(key).agg(
        F.max_by("new_status", F.struct("ts", "event_id")).alias("_last"), F.max(F.when(to_done, F.col("ts"))).alias("_done"),
        F.max(F.when(from_done, F.col("ts"))).alias("reopened_at"), F.count("*").alias("history_rows"),
    )
    out = tasks.join(last, key, "left").withColumn("status", F.coalesce("_last", "status"))
    return out.withColumn("completed_at", F.when(F.col("status") == "done", F.col("_done"))).withColumn("history_rows", F.coalesce("history_rows", F.lit(0))).drop("_last", "_done")


def skipped(tasks: DataFrame, history: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Events that changed nothing, with the reason; those of unknown tasks are not found."""
    lost = events.join(tasks.select(key), key, "left_anti").select(key, "event_id", F.lit("not found").alias("reason"))
    return history.where("not effective").select(key, "event_id", "reason").union(lost)
