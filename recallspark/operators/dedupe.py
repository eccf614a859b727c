"""Deduplication by fingerprints: gates, exact and windowed duplicates, source groups.

Hot keys: groups are pre-aggregated, and the windowed scan deals the rows of a key by ranges of time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from recallspark.functions.text import action_keys, let, normalize_conversation, title_key, title_summary_key
from recallspark.operators import greedy
from recallspark.sources.scratch import saved

TYPE_RANK = ("DECISION", "PREFERENCE", "FACT", "REASONING", "EVENT")


def ingestion_gate(events: DataFrame, text: str = "text", at: str = "ts", key: str = "id", log: DataFrame | None = None) -> DataFrame:
    """status processed for the first input of a conversation, conversation_hash_duplicate for later ones and those in the log.

    A text that is empty after normalisation has an empty hash and never is a duplicate.
    """
    # coalesce: a key that cannot be null spares the join a test for null, which would hash every text again.
    own = events.withColumn("conversation_hash", F.coalesce(let(normalize_conversation(text), lambda norm: F.when(norm == "", "").otherwise(F.sha2(norm, 256))), F.lit("")))
    # Empty hashes are dropped after the aggregation by a value of it, as a filter of the key would hash every text once more.
    first = own.groupBy("conversation_hash").agg(F.min(F.struct(at, key)).alias("_first"), F.max(F.col("conversation_hash") != "").alias("_some")).where("_some").drop("_some")
    if log is not None:
        first = first.join(log.select("conversation_hash", F.lit(True).alias("_known")).distinct(), "conversation_hash", "left")
    else:
        first = first.withColumn("_known", F.lit(False))
    known = F.coalesce(F.col("_known"), F.lit(False))
    is_first = (F.col("conversation_hash") == "") | ((F.struct(at, key) == F.col("_first")) & ~known)
    return own.join(first, "conversation_hash", "left").withColumn("status", F.when(is_first, "processed").otherwise("conversation_hash_duplicate")).drop("_first", "_known")


def normalized_hash(text: str, key: str) -> Column:
    return F.coalesce(let(normalize_conversation(text), lambda norm: F.when(norm == "", F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(F.sha2(norm, 256))), F.lit(""))


def exact(memories: DataFrame, text: str = "raw_text", at: str = "created_at", key: str = "id") -> DataFrame:
    """id, normalized_hash, kept_id: the earliest memory with the same normalised text; texts that are empty keep themselves."""
    own = memories.select(key, at, normalized_hash(text, key).alias("normalized_hash"))
    first = own.groupBy("normalized_hash").agg(F.min_by(key, F.struct(at, key)).alias("kept_id"))
    return own.join(first, "normalized_hash").select(key, "normalized_hash", "kept_id")


def windowed(rows: DataFrame, key: str, at: str = "ts", id_col: str = "id", minutes: int = 10) -> DataFrame:
    """rows with kept: false if a kept row of the same key came at most `minutes` before; skipped rows never block later ones.

    Keys and runs of rows may hold any number of rows: the chain of kept rows is followed range by range (see greedy).  Null and empty keys are always
    kept, rows without a time never.
    """
    keyed = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("_key"), F.unix_micros(at).alias("_t"), F.col(id_col).alias("_id"))
    kept = greedy.kept(keyed.where("_t is not null and _id is not null"), minutes * 60_000_000).withColumnRenamed("_id", id_col).withColumn("_kept", F.lit(True))
    free = F.col(key).isNull() | (F.col(key) == "")
    return rows.join(kept, id_col, "left").withColumn("kept", F.coalesce("_kept", free)).drop("_kept")


def keyed_memories(memories: DataFrame) -> DataFrame:
    """id, group_key (a hash of the normalised text) and what ranks a memory, of all that are not deleted; written once, so texts are normalised once.

    Texts that are empty after normalisation have no key: they are dropped after the write, as a filter before would
    normalise every text a second time.
    """
    key = let(normalize_conversation("raw_text"), lambda norm: F.when(norm != "", F.sha2(norm, 256)))
    own = memories.where(F.col("status") != "deleted").select("id", key.alias("group_key"), "status", "memory_type", "confidence", "created_at")
    return saved(own, "keys").where("group_key is not null")


#: Ranks of statuses: active before all others, or each for itself as merging wants it.
ACTIVE_FIRST = {"active": 0}
BY_STATUS = {"active": 0, "expired": 1, "wrong": 2, "muted": 3, "deleted": 9}


def _canonical(statuses: dict[str, int]) -> Column:
    """The order in which members stand for their group."""
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv])[F.col("status")], F.lit(5))
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPE_RANK]), F.upper("memory_type"))
    return F.struct(status.alias("a"), F.when(F.coalesce(kind, F.lit(0)) == 0, 99).otherwise(kind).alias("b"), (-F.col("confidence")).alias("c"), F.col("created_at").alias("d"), F.col("id").alias("e"))


def source_groups(keyed: DataFrame, statuses: dict[str, int] = ACTIVE_FIRST) -> DataFrame:
    """Groups of keyed memories with the same normalised text: their size, canonical member, types, statuses and times; group_members gives the members."""
    out = keyed.groupBy("group_key").agg(
        F.count("*").alias("n"), F.min_by("id", _canonical(statuses)).alias("canonical_id"),
        F.sort_array(F.collect_set("memory_type")).alias("types"), F.sort_array(F.collect_set("status")).alias("statuses"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )
    return out.where("n > 1")


def group_members(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """group_key, id, canonical_id: a row for each member of a group, so that a large group needs no large row."""
    return keyed.select("group_key", "id").join(groups.select("group_key", "canonical_id"), "group_key")


def merges(members: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Links MERGED_INTO from every other member to the canonical one, but those that exist."""
    out = members.where("id <> canonical_id").select(F.col("id").alias("source_id"), F.col("canonical_id").alias("target_id")).withColumn("relation_type", F.lit("MERGED_INTO"))
    return out if links is None else out.join(links.select("source_id", "target_id", "relation_type"), ["source_id", "target_id", "relation_type"], "left_anti")


def backfill_merges(memories: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links that merge copies into their canonical memory, by the ranks of all statuses, and memories with the merged ones muted."""
    keyed = keyed_memories(memories)
    new = saved(merges(group_members(keyed, source_groups(keyed, BY_STATUS)), links), "merges")
    return new, mute_merged(memories, new)


def mute_merged(memories: DataFrame, links: DataFrame) -> DataFrame:
    """memories where the source of a new MERGED_INTO link is muted."""
    gone = links.where(F.upper("relation_type") == "MERGED_INTO").select(F.col("source_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    return memories.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "muted").otherwise(F.col("status"))).drop("_gone")


def title_groups(memories: DataFrame) -> DataFrame:
    """Titles that come more than once, by letters and digits alone."""
    return memories.select("id", title_key("title").alias("title_key")).where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def newest_of_type(memories: DataFrame, n: int = 5) -> DataFrame:
    """The n newest open memories of each type."""
    newest = W.Window.partitionBy("memory_type").orderBy(F.desc("created_at"), F.desc("id"))
    return memories.where(F.col("valid_until").isNull()).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def open_candidates(new: DataFrame, memories: DataFrame, n: int = 5) -> DataFrame:
    """id, other_id, rank: for each new memory the n newest open ones of its type that are not itself."""
    others = newest_of_type(memories, n + 1).select("memory_type", F.col("id").alias("other_id"), "rank")
    order = W.Window.partitionBy("id").orderBy("rank")
    near = new.select("id", "memory_type").join(others, "memory_type").where("id <> other_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("id", "other_id", "rank")


def records(memories: DataFrame, minutes: int = 10) -> DataFrame:
    """The fingerprint log: id, decision (created or skipped) and reason of every memory.

    Staged: exact text first, then the same action, the same fact, and the same title with summary within some minutes; each
    stage looks at the survivors of the one before, so a row that is dropped late never blocks an early one.  A task is what the text itself quotes first.
    """
    keyed = memories.withColumn("_k", action_keys("raw_text", "title", "summary", by_text=True))
    keyed = keyed.select("id", F.col("created_at").alias("ts"), normalized_hash("raw_text", "id").alias("h"), F.col("_k.action_key").alias("action_key"), F.col("_k.fact_key").alias("fact_key"), title_summary_key("title", "summary").alias("title_summary_key"))
    keyed = saved(keyed, "fingerprints")  # four stages look at the keys; texts are normalised once
    first = keyed.groupBy("h").agg(F.min_by("id", F.struct("ts", "id")).alias("kept_id"))
    alive = keyed.join(first.select("h", F.col("kept_id").alias("id")), ["h", "id"], "left_semi")
    log = keyed.select("id").join(alive.select("id", F.lit(True).alias("_first")), "id", "left").select("id", F.when(F.col("_first").isNull(), "normalized_duplicate").alias("reason"))
    for key in ("action_key", "fact_key", "title_summary_key"):
        seen = windowed(alive, key, "ts", "id", minutes)
        log = log.join(seen.where("not kept").select("id", F.lit(key.removesuffix("_key") + "_duplicate").alias("_r")), "id", "left").withColumn("reason", F.coalesce("reason", "_r")).drop("_r")
        alive = seen.where("kept").drop("kept")
    return log.select("id", F.when(F.col("reason").isNull(), "created").otherwise("skipped").alias("decision"), "reason")


def apply_conflicts(memories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """memories after verdicts (old_id, new_id, verdict, ts): superseded ones point to the newest that replaces them and end when it came."""
    won = verdicts.where("verdict = 'supersede'").groupBy(F.col("old_id").alias("id")).agg(F.max_by("new_id", F.struct("ts", "new_id")).alias("superseded_by"), F.max("ts").alias("_until"))
    out = memories.join(won, "id", "left")
    return out.withColumn("is_superseded", F.col("is_superseded") | F.col("superseded_by").isNotNull()).withColumn("valid_until", F.coalesce("_until", "valid_until")).drop("_until")


def conflict_edges(verdicts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges from every tag of an old memory to every different tag of the one that supersedes or refines it, at similarity 0.3."""
    kind = F.when(F.col("verdict") == "supersede", "SUPERSEDES").when(F.col("verdict") == "refine", "REFINES")
    own = verdicts.select("old_id", "new_id", "ts", kind.alias("relation_type")).where("relation_type is not null").distinct()
    old, new = mentions.select(F.col("memory_id").alias("old_id"), F.col("tag").alias("source_tag")), mentions.select(F.col("memory_id").alias("new_id"), F.col("tag").alias("target_tag"))
    return own.join(old, "old_id").join(new, "new_id").where("source_tag <> target_tag").select("old_id", "new_id", "source_tag", "target_tag", "relation_type", F.lit(0.3).alias("sim"), "ts")
