"""Turns, episodes and the memories that are extracted from them.

Turns: session_id, turn_index, role, content; optional is_tool_call, is_tool_result, is_final_answer.  Every function is one
sort by session at most; texts do not travel through windows where ids do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.functions.text import compact, compact_display_title, is_memory_subject_text, text_of
from recallspark.operators.reports import any_contains


def pair(turns: DataFrame, least: int = 30, limit: int = 5000) -> DataFrame:
    """session_id, pair_no, text: each user message with the answers that follow it; short messages and leading answers are dropped."""
    said = turns.withColumn("content", F.trim(text_of("content"))).where((F.length("content") >= least) & F.col("role").isin("user", "assistant"))
    upto = W.Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(W.Window.unboundedPreceding, 0)
    said = said.withColumn("pair_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto)).where("pair_no > 0")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "content")
    lines = F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line"))))
    return said.groupBy("session_id", "pair_no").agg(F.substring(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 1, limit).alias("text"))


def _flag(turns: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in turns.columns else default


def episode_turns(turns: DataFrame, start: Column | None = None) -> DataFrame:
    """session_id, episode_no, turn_index, role, role_in_episode, weight: a user turn worth remembering, or one that `start` holds for, starts an episode."""
    upto = W.Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(W.Window.unboundedPreceding, 0)
    starts = (F.col("role") == "user") & (is_memory_subject_text("content") if start is None else start)
    own = turns.select(
        "session_id", "turn_index", "role", F.coalesce(starts, F.lit(False)).alias("starts"),
        _flag(turns, "is_final_answer", F.col("role") == "assistant").alias("final"),
        (_flag(turns, "is_tool_call", F.lit(False)) | _flag(turns, "is_tool_result", F.lit(False))).alias("tool"),
    ).withColumn("episode_no", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(upto)).where("episode_no > 0")
    part = F.when(F.col("starts"), "trigger").when(F.col("final"), "final_answer").when(F.col("tool"), "tool_support").otherwise("context")
    return own.select("session_id", "episode_no", "turn_index", "role", part.alias("role_in_episode"), F.when(F.col("starts"), 1.0).otherwise(0.5).alias("weight"))


def episodes(linked: DataFrame) -> DataFrame:
    """One row for each episode of episode_turns: id, title, first and last turn, first final answer."""
    final = F.min(F.when(F.col("role_in_episode") == "final_answer", F.col("turn_index")))
    out = linked.groupBy("session_id", "episode_no").agg(F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.count("*").alias("n_turns"), final.alias("answer_turn"))
    name = F.concat_ws("|", F.col("session_id").cast("string"), F.col("start_turn").cast("string"))
    return out.withColumn("episode_id", F.concat(F.lit("ep_"), F.substring(F.sha2(name, 256), 1, 24))).withColumn("title", F.concat(F.lit("Episode "), F.col("episode_no").cast("string")))


def extract(turns: DataFrame, found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One memory for each episode that is not in existing (memory_id): title, summary and evidence turns of its trigger."""
    trigger = turns.select("session_id", F.col("turn_index").alias("start_turn"), F.col("content").alias("raw_text"))
    out = found.join(trigger, ["session_id", "start_turn"])
    name = F.concat_ws("|", F.col("session_id").cast("string"), F.col("episode_id"))
    out = out.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(name, 256), 1, 24)).alias("memory_id"), "session_id", "episode_id",
        compact_display_title("raw_text", F.col("title"), 42)["title"].alias("title"), compact("raw_text", 240).alias("summary"),
        F.col("start_turn").alias("source_turn"), F.col("answer_turn").alias("support_turn"),
    )
    return out if existing is None else out.join(existing.select("memory_id"), "memory_id", "left_anti")


def placeholders(turns: DataFrame, least: int = 30, title: str = "Memory") -> DataFrame:
    """One memory for each user turn of `least` characters, which starts an episode, without any of its text: ids are hashes of its place and content.

    content_length and content_hash are taken where turns have them, so texts need not be there.  memory_id, session_id, episode_id, title (numbered within
    the session), start_turn, end_turn, n_turns, granularity, speaker_scope and confidence; the turn is the memory's one source.
    """
    size = F.col("content_length") if "content_length" in turns.columns else F.length("content")
    said = F.col("content_hash") if "content_hash" in turns.columns else F.sha2("content", 256)
    found = episodes(episode_turns(turns, size >= least)).select("session_id", "episode_no", "start_turn", "end_turn", "n_turns")
    out = found.join(turns.select("session_id", F.col("turn_index").alias("start_turn"), said.alias("_h")), ["session_id", "start_turn"])
    hashed = lambda prefix, *parts: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24))
    out = out.withColumn("episode_id", hashed("ep_", F.col("session_id"), F.col("start_turn"), F.col("_h")))
    return out.select(
        hashed("mem_", F.col("episode_id"), F.col("_h")).alias("memory_id"), "session_id", "episode_id", F.concat(F.lit(f"{title} "), F.col("episode_no").cast("string")).alias("title"), "start_turn", "end_turn", "n_turns",
        F.lit("turn").alias("granularity"), F.lit("user_claim").alias("speaker_scope"), F.lit(0.5).alias("confidence"),
    )


def evidence(memories: DataFrame) -> DataFrame:
    """memory_id, session_id, turn_index, evidence_role, weight of extracted memories."""
    own = F.array(F.struct(F.col("source_turn").alias("turn_index"), F.lit("source").alias("evidence_role"), F.lit(1.0).alias("weight")), F.struct(F.col("support_turn").alias("turn_index"), F.lit("support").alias("evidence_role"), F.lit(0.5).alias("weight")))
    return memories.select("memory_id", "session_id", F.inline(own)).where(F.col("turn_index").isNotNull())


def evidence_chain(links: DataFrame, memories: DataFrame, turns: DataFrame) -> DataFrame:
    """Each memory with the turns that bear it out, in their order."""
    return links.join(memories.select("memory_id", "title", "episode_id"), "memory_id").join(turns.select("session_id", "turn_index", "role", F.col("content").alias("evidence")), ["session_id", "turn_index"])


def context_before(turns: DataFrame, n: int = 5, limit: int = 200) -> DataFrame:
    """The last n texts of the same session before each turn, oldest first."""
    before = W.Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(-n, -1)
    return turns.select("session_id", "turn_index", F.collect_list(F.substring(text_of("content"), 1, limit)).over(before).alias("context"))


def reviewable(turns: DataFrame) -> Column:
    tool = _flag(turns, "is_tool_call", F.lit(False)) | _flag(turns, "is_tool_result", F.lit(False))
    return F.col("role").isin("user", "assistant") & (F.length(F.trim(text_of("content"))) > 0) & ~tool


def turn_counts(turns: DataFrame) -> DataFrame:
    """Per session: all turns, those that can be reviewed, and internal ones."""
    good = F.when(reviewable(turns), 1).otherwise(0)
    return turns.groupBy("session_id").agg(F.count("*").alias("n_all"), F.sum(good).alias("n_reviewable"), F.sum(1 - good).alias("n_internal"))


def turn_page(turns: DataFrame, view: str, offset: int, limit: int, reviews: DataFrame | None = None, session: Column | None = None) -> DataFrame:
    """A page of turns (view: reviewable, internal or all), of one session where `session` names it, with the three counts of its session.

    reviews (session_id, turn_index, review_status, review_note) lie over the turns; those without are active.
    """
    own = turns if session is None else turns.where(F.col("session_id") == session)
    keep = {"reviewable": reviewable(own), "internal": ~reviewable(own), "all": F.lit(True)}[view]
    rows = own.where(keep).orderBy("session_id", "turn_index").offset(offset).limit(limit)
    rows = rows.join(turn_counts(own), "session_id")
    if reviews is None:
        return rows.withColumns({"review_status": F.lit("active"), "review_note": F.lit("")})
    over = reviews.select("session_id", "turn_index", "review_status", "review_note")
    return rows.join(over, ["session_id", "turn_index"], "left").fillna({"review_status": "active", "review_note": ""})


def import_report(turns: DataFrame, sessions: DataFrame | None = None, agent: str = "agent") -> DataFrame:
    """What an import would bring, per source; nothing is written.

    Sessions, turns, estimated episodes and memories (one for each episode), user turns, tool calls and results, turns that are no talk, and
    short turns; with sessions (agent, session_id, title_source): those with a title of their own, those without, and how many there are of each
    source of titles.
    """
    subject = (F.col("role") == "user") & is_memory_subject_text("content")
    call, result = _flag(turns, "is_tool_call", F.lit(False)), _flag(turns, "is_tool_result", F.lit(False))
    low = F.length(F.trim(text_of("content"))) < 30
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = turns.groupBy(agent).agg(
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"), count(subject).alias("episodes"), count(subject).alias("memories"), count(F.col("role") == "user").alias("user_turns"),
        count(call).alias("tool_calls"), count(result).alias("tool_results"), count(call | result | ~F.col("role").isin("user", "assistant")).alias("process_turns"), count(low & ~call & ~result).alias("low_value"),
    )
    if sessions is None:
        return out
    kinds = sessions.groupBy(agent, "title_source").agg(F.count("*").alias("n"))
    missing = F.sum(F.when(F.col("title_source") == "missing", F.col("n")).otherwise(0))
    titles = kinds.groupBy(agent).agg((F.sum("n") - missing).alias("titled"), missing.alias("missing_titles"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("title_source", "n")))).alias("title_sources"))
    return out.join(titles, agent, "left")


def coverage(turns: DataFrame, found: DataFrame, memories: DataFrame, links: DataFrame, reviews: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The coverage board: each fact is counted by session first and joined then, so that nothing fans out.

    turns may have content_length, the length of contents that are not stored: such turns are pending.  reviews (id, retention_class,
    needs_llm) are classes of memories; states (session_id, review_status) what reviewers decided, which goes before the status that follows from the classes.
    """
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    told = F.col("role").isin("user", "assistant") & (F.length(F.trim(text_of("content"))) > 0)
    pending = F.col("role").isin("user", "assistant") & ~told & (F.col("content_length") > 0) if "content_length" in turns.columns else F.lit(False)
    board = turns.groupBy("session_id").agg(
        F.count("*").alias("turns"), count(told).alias("reviewable"), count(pending).alias("pending"), count(~told).alias("internal"),
        count(_flag(turns, "is_tool_call", F.lit(False))).alias("tool_calls"), count(_flag(turns, "is_tool_result", F.lit(False))).alias("tool_results"),
    )
    board = board.join(found.groupBy("session_id").agg(F.count("*").alias("episodes")), "session_id", "left")
    board = board.join(links.groupBy("session_id").agg(F.count_distinct("memory_id", "turn_index", "evidence_role").alias("evidence")), "session_id", "left")
    classes = ("long_term", "temporary_task", "noise", "project_state")
    own = memories.select("session_id", "memory_id")
    own = own.join(reviews.select(F.col("id").alias("memory_id"), "retention_class", "needs_llm"), "memory_id", "left") if reviews is not None else own.withColumns({"retention_class": F.lit(""), "needs_llm": F.lit(False)})
    facts = own.groupBy("session_id").agg(F.count("*").alias("memories"), *[count(F.col("retention_class") == c).alias(c) for c in classes], count(F.col("needs_llm")).alias("needs_llm"))
    board = board.join(facts, "session_id", "left").fillna(0, ["episodes", "evidence", "memories", *classes, "needs_llm"])
    follows = F.when(F.col("memories") <= 0, "rule_processed").when(F.col("needs_llm") > 0, "needs_llm").when(F.col("noise") + F.col("temporary_task") + F.col("project_state") > 0, "needs_review").otherwise("rule_processed")
    if states is None:
        return board.withColumn("review_status", follows)
    board = board.join(states.select("session_id", F.nullif(F.col("review_status"), F.lit("")).alias("_s")), "session_id", "left")
    return board.withColumn("review_status", F.coalesce("_s", follows)).drop("_s")


def board_order(sort: str) -> list[Column]:
    """Orders of the board: the newest first (also for unknown names), most turns, most turns to review, or least covered first."""
    newest, turns_ = F.desc("updated_at"), F.desc("turns")
    orders = {"turns_desc": [turns_, newest], "reviewable_desc": [F.desc("reviewable"), turns_], "coverage_asc": [F.asc(F.col("reviewable") / F.col("turns")), turns_]}
    return [*orders.get(sort, [newest]), F.asc("session_id")]


def board_page(board: DataFrame, sessions: DataFrame, word: str = "", mode: str = "sessions", sort: str = "updated_desc", offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of the board with what is known of its sessions (session_id, agent, original_title, display_title, title_source, display_title_source, updated_at) and the total.

    word is looked for in titles, agent and session; mode missing_titles keeps sessions whose title is not the agent's own.
    """
    own = sessions.join(board, "session_id", "left")
    if mode == "missing_titles":
        own = own.where((F.coalesce("title_source", F.lit("")) == "missing") | (F.coalesce("display_title_source", F.lit("")) != "agent_original"))
    own = own.where(any_contains(word, ["display_title", "original_title", "agent", "session_id"])) if word else own
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(*board_order(sort)).offset(offset).limit(limit).join(F.broadcast(total))  # total: one row
