"""Lists, lookups and reports over the store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.operators.ranges import numbered


def any_contains(word: str, columns: list[str]) -> Column:
    """True where any of the columns holds the word, whatever its case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word.lower())) for c in columns])


def memory_list(memories: DataFrame, sessions: DataFrame | None = None, word: str = "", status: str | None = None, agent: str | None = None, session: Column | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of live memories, pinned ones first, then the newest, with the total of all that match.

    sessions (session_id, agent, display_title, title_source) tell where memories come from; word is looked for in title, summary and text.
    Deleted memories are shown only if `status` asks for them.
    """
    own = memories.where(~F.col("is_superseded") & (F.coalesce("status", F.lit("active")) == status if status else F.coalesce("status", F.lit("active")) != "deleted"))
    if sessions is not None:
        own = own.join(sessions.select("session_id", "agent", "display_title", "title_source"), "session_id", "left")
    own = own.where(F.col("agent") == agent) if agent else own
    own = own.where(F.col("session_id") == session) if session is not None else own
    own = own.where(any_contains(word, ["title", "summary", "raw_text"])) if word else own
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(F.desc("pinned"), F.desc("created_at"), "id").offset(offset).limit(limit).join(F.broadcast(total))  # total: one row


def status_breakdown(memories: DataFrame) -> DataFrame:
    live = F.when(F.col("is_superseded"), "superseded").otherwise(F.col("status"))
    return memories.groupBy(live.alias("state")).agg(F.count("*").alias("n"))


def page(df: DataFrame, word: str, columns: list[str], order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of any governance table, with the count of all that match."""
    own = df.where(any_contains(word, columns)) if word else df
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def valid_at(memories: DataFrame, at: Column) -> DataFrame:
    """Memories that hold at a time: from valid_from on and before valid_until."""
    return memories.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def source_stats(sessions: DataFrame, turns: DataFrame, links: DataFrame, n: int = 12) -> DataFrame:
    """dimension, value, n: totals, and how many sessions (agent, title_source, display_title_source) there are of each kind, by one grouping.

    Totals are source_sessions, missing_titles, memories_with_evidence (of links: memory_id), turns and tool_turns (is_tool_call, is_tool_result); of agents
    the n largest are listed.
    """
    kinds = ("agent", "title_source", "display_title_source")
    sets = sessions.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in kinds])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    order = W.Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    sets = sets.withColumn("r", F.row_number().over(order)).where((F.col("dimension") != "agent") | (F.col("r") <= n)).drop("r")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = [
        sessions.agg(F.count("*").alias("source_sessions"), count(F.col("title_source") == "missing").alias("missing_titles")),
        links.agg(F.count_distinct("memory_id").alias("memories_with_evidence")), turns.agg(F.count("*").alias("turns"), count(F.col("is_tool_call") | F.col("is_tool_result")).alias("tool_turns")),
    ]
    rows = [df.select(F.inline(F.array(*[F.struct(F.lit("total").alias("dimension"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in df.columns]))) for df in one]
    return reduce(DataFrame.union, rows, sets)


def totals(**tables: DataFrame) -> DataFrame:
    """name, n of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def store_stats(tags: DataFrame, top: int = 10, **tables: DataFrame) -> DataFrame:
    """kind, name, value: the size of each table, and the heat of the hottest tags."""
    sizes = totals(**tables).select(F.lit("table").alias("kind"), "name", F.col("n").cast("double").alias("value"))
    heat = F.col("storage_strength") * F.col("retrieval_strength")
    return sizes.union(tags.where(~F.col("is_dormant")).select(F.lit("tag"), "name", heat.alias("value")).orderBy(F.desc("value"), "name").limit(top))


def snapshot(memories: DataFrame, hot_tags: DataFrame, history: DataFrame | None, at: Column, least_new: int = 50, least_days: int = 7, keep: int = 10) -> DataFrame:
    """The history of snapshots (taken_at, n_memories, hot_tags) with a new one if enough is new or enough time is past; the newest stay."""
    tags = hot_tags.agg(F.array_sort(F.collect_list(F.struct((-F.col("heat")).alias("h"), F.col("name")))).alias("t")).select(F.transform("t", lambda x: x["name"]).alias("hot_tags"))
    new = memories.agg(F.count("*").alias("n_memories")).join(F.broadcast(tags)).select(at.alias("taken_at"), "n_memories", "hot_tags")
    if history is None:
        return new
    last = history.agg(F.max("taken_at").alias("_t"), F.max_by("n_memories", "taken_at").alias("_n"))
    due = new.join(F.broadcast(last)).where(F.col("_t").isNull() | (F.col("n_memories") - F.col("_n") >= least_new) | (F.col("taken_at") >= F.col("_t") + F.make_dt_interval(F.lit(least_days)))).drop("_t", "_n")
    return history.unionByName(due).orderBy(F.desc("taken_at")).limit(keep)


def new_since(memories: DataFrame, at: Column, least: int = 5) -> DataFrame:
    """Whether enough memories came after a time for another consolidation."""
    n = F.sum(F.when(F.col("created_at") > at, 1).otherwise(0))
    return memories.agg(n.alias("n_new"), (n >= least).alias("due"))


def content_audit(stored: DataFrame, texts: DataFrame) -> DataFrame:
    """agent, state, n: how stored turns (session_id, turn_index, role, content, content_hash, agent) compare with source texts (.., role, content)."""
    found = texts.select("session_id", "turn_index", F.col("role").alias("_r"), F.col("content").alias("_c"))
    own = stored.join(found, ["session_id", "turn_index"], "left")
    has = F.trim(F.coalesce("content", F.lit(""))) != ""
    fits = (F.col("role") == F.col("_r")) & (F.col("content_hash").isNull() | (F.col("content_hash") == "") | (F.col("content_hash") == F.sha2("_c", 256)))
    state = F.when(F.col("_c").isNull(), "missing_text").when(~fits, "mismatched").when(has, "has_content").otherwise("fillable")
    return own.groupBy("agent", state.alias("state")).agg(F.count("*").alias("n"))


def fill_content(stored: DataFrame, texts: DataFrame) -> DataFrame:
    """Stored turns with empty contents filled from matching texts; contents that are there stay."""
    found = texts.select("session_id", "turn_index", F.col("role").alias("_r"), F.col("content").alias("_c"))
    own = stored.join(found, ["session_id", "turn_index"], "left")
    fits = (F.col("role") == F.col("_r")) & (F.coalesce("content_hash", F.lit("")).isin("") | (F.col("content_hash") == F.sha2("_c", 256)))
    empty = F.trim(F.coalesce("content", F.lit(""))) == ""
    return own.withColumn("content", F.when(empty & fits, F.col("_c")).otherwise(F.col("content"))).drop("_r", "_c")


def pending_imports(found: DataFrame, known: DataFrame) -> DataFrame:
    """source, state, n: sessions that are new, changed or unchanged, by a hash of their content."""
    old = known.select("session_id", F.col("content_hash").alias("_h"))
    state = F.when(F.col("_h").isNull(), "new").when(F.col("_h") != F.col("content_hash"), "changed").otherwise("unchanged")
    return found.join(old, "session_id", "left").groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


def match_title_ranges(files: DataFrame, titles: DataFrame, tolerance: int = 900, bucket: int = 3600) -> DataFrame:
    """file_id, status, title_id, score: the title whose time range best covers or overlaps that of a file.

    files: file_id, start, end; titles: title_id, start, end (seconds).  A title that covers the file, within the tolerance, scores the file's
    length + 1 and the overlap; others score the overlap.  The best is taken if it is the only one or over 1.5 times the second, else the file is
    ambiguous; without any it is unresolved.  Ranges meet by buckets of time, so no side is compared with all of the other.
    """
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    f = files.select("file_id", F.col("start").alias("a"), F.col("end").alias("b")).withColumn("slot", slots(F.col("a"), F.col("b")))
    t = titles.select("title_id", F.col("start").alias("c"), F.col("end").alias("d")).withColumn("slot", slots(F.col("c") - tolerance, F.col("d") + tolerance))
    over = F.least("b", F.col("d") + tolerance) - F.greatest("a", F.col("c") - tolerance)
    first = F.greatest(F.floor(F.col("a") / bucket), F.floor((F.col("c") - tolerance) / bucket))
    met = f.join(t, "slot").where((F.col("slot") == first) & (over >= 0))
    covers = (F.col("c") - tolerance <= F.col("a")) & (F.col("d") + tolerance >= F.col("b"))
    met = met.select("file_id", "title_id", F.when(covers, F.col("b") - F.col("a") + 1 + over).otherwise(over).cast("double").alias("score"))
    order = W.Window.partitionBy("file_id").orderBy(F.desc("score"), "title_id")
    best = met.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("r = 1")
    clear = F.col("second").isNull() | (F.col("score") > 1.5 * F.col("second"))
    out = files.select("file_id").join(best, "file_id", "left")
    status = F.when(F.col("title_id").isNull(), "unresolved").when(clear, "resolved").otherwise("ambiguous")
    return out.select("file_id", status.alias("status"), F.when(status == "resolved", F.col("title_id")).alias("title_id"), F.when(F.col("title_id").isNotNull(), F.round("score", 6)).alias("score"))


def resolve_titles(files: DataFrame, by_path: DataFrame, by_name: DataFrame, by_range: DataFrame) -> DataFrame:
    """The title of a file by its path, else by its name, else by its time range, with its source; missing ones fall back to the first user turn, then the name."""
    out = files.join(by_path.select("path", F.col("title").alias("_p")), "path", "left").join(by_name.select("name", F.col("title").alias("_n")), "name", "left").join(by_range.select("file_id", F.col("title").alias("_r")), "file_id", "left")
    title = F.coalesce("_p", "_n", "_r")
    source = F.when(F.col("_p").isNotNull(), "path").when(F.col("_n").isNotNull(), "name").when(F.col("_r").isNotNull(), "range").otherwise("missing")
    return out.select("file_id", title.alias("original_title"), source.alias("title_source"), F.coalesce(title, F.nullif(F.trim("first_user_turn"), F.lit("")), "name").alias("display_title"))


def session_detail(found: DataFrame, linked: DataFrame, memories: DataFrame, links: DataFrame) -> DataFrame:
    """Episodes of each session with the number of their turns, memories and evidence turns; each is counted on its own side first."""
    keys = ["session_id", "episode_no"]
    n_turns = linked.groupBy(*keys).agg(F.count("*").alias("turns"))
    proof = links.groupBy("memory_id").agg(F.count("*").alias("_e"))
    n_memories = memories.join(proof, "memory_id", "left").groupBy("episode_id").agg(F.count("*").alias("memories"), F.sum(F.coalesce("_e", F.lit(0))).alias("evidence"))
    return found.select(*keys, "episode_id", "title").join(n_turns, keys, "left").join(n_memories, "episode_id", "left").fillna(0, ["turns", "memories", "evidence"])


def source_backfill(memories: DataFrame, known: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Source rows of sessions that have none: session_id, message_count, content_hash over their ids in order, first and last time.

    Ids are numbered by ranges and hashed in chunks of `chunk`, and the hashes of a session's chunks are hashed again; so no row holds all
    ids of a session.
    """
    new = memories.join(known.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "created_at", "id")
    ids = numbered(new, ["session_id"], ["created_at", "id"], "id").withColumn("_c", F.floor((F.col("k") - 1) / chunk))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["v"]), "|")
    chunks = ids.groupBy("session_id", "_c").agg(F.sha2(joined(["k", F.col("id").cast("string").alias("v")]), 256).alias("h"), F.count("*").alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    return chunks.groupBy("session_id").agg(F.sum("n").alias("message_count"), F.sha2(joined(["_c", F.col("h").alias("v")]), 256).alias("content_hash"), F.min("a").alias("started_at"), F.max("b").alias("ended_at"))


def source_memories(memories: DataFrame, sources: DataFrame) -> DataFrame:
    """session_id, memory_id of memories in sessions that have a source row: the link table of a backfill."""
    return memories.join(sources.select("session_id"), "session_id", "left_semi").select("session_id", F.col("id").alias("memory_id"))


def uncovered(sessions: DataFrame, memories: DataFrame, candidate_sources: DataFrame, least: int = 1) -> DataFrame:
    """session_id, n_memories of sessions with enough live memories that no candidate (candidate_sources: session_id) names."""
    n = memories.where(~F.col("status").isin("deleted", "wrong", "muted")).groupBy("session_id").agg(F.count("*").alias("n_memories")).where(F.col("n_memories") >= least)
    return sessions.select("session_id").join(n, "session_id").join(candidate_sources.select("session_id"), "session_id", "left_anti")
