"""Spaces: clusters of work, found in texts, counted, profiled, suggested and bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.functions.text import normalize_conversation
from recallspark.operators.retrieval import tokens, vector_topk
from recallspark.sources.scratch import saved
from recallspark.sources.sinks import insert_ignore


#: Characters of the names that one automaton holds; it takes some 50 bytes a character.
AUTOMATON = 1 << 20


def names_in(texts: DataFrame, names: DataFrame, characters: int = AUTOMATON) -> DataFrame:
    """id, name: the names (name) that stand in each text (id, text), once each; upper and lower case differ.

    The names are put into an Aho-Corasick automaton, which finds them all in one pass over a text.  Their length is summed first: names of up to
    `characters` are sent to the tasks together, more of them in parts of that size, each of which is one more pass over the texts.  A name that is longer is a part of its own.
    """
    own = names.where("name is not null and name <> ''").distinct()
    own = saved(own.withColumn("_row", F.monotonically_increasing_id()), "names")
    total = own.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // characters) if total > characters else 1)
    own = own.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    schema = T.StructType([texts.schema["id"], T.StructField("name", T.StringType())])
    arrow = to_arrow_schema(schema)

    def pass_over(words: list[str]) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k, word in enumerate(sent.value):
                automaton.add_word(word, k)
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch["text"]):
                    if text.is_valid:
                        for k in sorted({k for _, k in automaton.iter(text.as_py())}):
                            rows.append(row)
                            found.append(sent.value[k])
                        if len(rows) > 100_000:
                            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), pa.array(found, pa.string())], schema=arrow)
                            rows, found = [], []
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], schema=arrow)

        return texts.select("id", "text").mapInArrow(run, schema)

    found = []
    for part in range(parts):
        words = [r.name for r in own.where(F.col("_part") == part).select("name").collect()]
        if words:
            found.append(pass_over(words))
    return reduce(DataFrame.union, found) if found else texts.sparkSession.createDataFrame([], schema)


def detect(texts: DataFrame, spaces: DataFrame, k: int = 3, similarity: DataFrame | None = None) -> DataFrame:
    """id, space_id, score, rank: spaces whose name (0.45) or an alias (0.35) stands in a text, and how near its centre is (to 0.35).

    texts: id, text; spaces: space_id, name, aliases; similarity: id, space_id, sim.  All names and aliases are looked for in one pass over each
    text (see names_in), whatever case they stand in; empty names stand in no text.
    """
    names = spaces.select("space_id", F.explode(F.concat(F.array(F.struct(F.col("name").alias("n"), F.lit(True).alias("own"))), F.transform("aliases", lambda a: F.struct(a.alias("n"), F.lit(False).alias("own"))))).alias("x")).select("space_id", F.lower("x.n").alias("n"), "x.own").where("n <> ''")
    names = saved(names.distinct(), "names")
    hits = names_in(texts.select("id", F.lower("text").alias("text")), names.select(F.col("n").alias("name"))).withColumnRenamed("name", "n").join(names, "n")
    hits = hits.groupBy("id", "space_id").agg(F.max(F.when(F.col("own"), 0.45).otherwise(0.0)).alias("by_name"), F.max(F.when(~F.col("own"), 0.35).otherwise(0.0)).alias("by_alias"))
    score = F.col("by_name") + F.col("by_alias")
    if similarity is not None:
        near = similarity.select("id", "space_id", F.least(F.greatest((F.col("sim") - 0.35) * 0.7, F.lit(0.0)), F.lit(0.35)).alias("by_sim"))
        hits = hits.join(near, ["id", "space_id"], "full").fillna(0.0)
        score = score + F.col("by_sim")
    hits = hits.select("id", "space_id", F.round(F.least(score, F.lit(1.0)), 3).alias("score")).where("score > 0")
    return hits.withColumn("rank", F.row_number().over(W.Window.partitionBy("id").orderBy(F.desc("score"), "space_id"))).where(F.col("rank") <= k)


def bind(found: DataFrame, bound: DataFrame, auto: float = 0.8, ask: float = 0.25) -> DataFrame:
    """id, space_id, score, decision of the two best spaces of each text that is bound to none: bind from auto on, queue from ask on."""
    own = found.where((F.col("rank") <= 2) & (F.col("score") >= ask)).join(bound.select("id"), "id", "left_anti")
    return own.select("id", "space_id", "score", F.when(F.col("score") >= auto, "bind").otherwise("queue").alias("decision"))


def pending(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue (id, space_id, score) with what was found for it and it lacks, the surest first."""
    return insert_ignore(queue, found.where("decision = 'queue'").select("id", "space_id", "score"), ["id", "space_id"]).orderBy(F.desc("score"), "id", "space_id")


def resolve(references: DataFrame, spaces: DataFrame) -> DataFrame:
    """ref, space_id: a reference as an id, else a name, else an alias."""
    ids = spaces.select(F.col("space_id").alias("ref"), F.col("space_id").alias("_i"))
    names = spaces.groupBy(F.lower("name").alias("low")).agg(F.min("space_id").alias("_n"))
    aliases = spaces.select("space_id", F.explode("aliases").alias("low")).groupBy(F.lower("low").alias("low")).agg(F.min("space_id").alias("_a"))
    own = references.withColumn("low", F.lower("ref")).join(ids, "ref", "left").join(names, "low", "left").join(aliases, "low", "left")
    return own.select("ref", F.coalesce("_i", "_n", "_a").alias("space_id"))


def duplicates(spaces: DataFrame, new: DataFrame) -> DataFrame:
    """new_name, space_id: existing spaces with the name or an alias of a new one, by letters and digits."""
    have = spaces.select("space_id", F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("n")).select("space_id", letters(F.col("n")).alias("key"))
    return new.select(F.col("name").alias("new_name"), letters(F.col("name")).alias("key")).join(have, "key").select("new_name", "space_id").distinct()


def nearest_space(spaces: DataFrame, new: DataFrame, least: float = 0.88, kinds: tuple[str, ...] = ()) -> DataFrame:
    """qid, id, score: the existing space (id, vec, type) that a new one (qid, vec, type) is a duplicate of by its vector, with 0.04 more for the same type.

    The type is written behind the vectors, so that one search finds the best by both.
    """
    mark = F.array(*[F.when(F.col("type") == k, 0.2).otherwise(0.0) for k in kinds])
    typed = lambda df, key: df.select(key, F.concat(F.col("vec").cast("array<double>"), mark).alias("vec"))
    return vector_topk(typed(new, "qid"), typed(spaces, "id"), 1).where(F.col("score") >= least).select("qid", "id", "score")


def counts(spaces: DataFrame, **facts: DataFrame) -> DataFrame:
    """Spaces with the number of rows of each fact table (space_id)."""
    for name, df in facts.items():
        spaces = spaces.join(df.groupBy("space_id").agg(F.count("*").alias(name)), "space_id", "left").fillna(0, [name])
    return spaces


# The lines of a digest.
DIGEST = {
    "head": "{} · {} 简报", "goal": "目标：{}", "tags": "关键词：{}", "decisions": "近期决策：{}", "todos": "待办：{} 项进行中，其中高优 {} 项。", "next": "下一步：{}",
    "no_todos": "下一步：暂无 Space 待办，可根据最近记忆补充行动项。", "nothing": "当前空间资料较少，建议先绑定相关记忆或建立待办。", "risk": "风险关注：{}", "no_risk": "暂无明显高优/截止日期风险。",
    "handoff": "交接要点：先看近期决策，再处理高优待办，最后补齐缺失背景。", "weekly": "本周脉络：最近记录 {} 条，决策 {} 条。",
}


def _first(df: DataFrame, order: list[Column], n: int, value: Column, name: str) -> DataFrame:
    """space_id and an array of the first n values of each space."""
    own = df.withColumn("_r", F.row_number().over(W.Window.partitionBy("space_id").orderBy(*order))).where(F.col("_r") <= n)
    return own.groupBy("space_id").agg(F.array_sort(F.collect_list(F.struct("_r", value.alias("v")))).alias("x")).select("space_id", F.transform("x", lambda x: x["v"]).alias(name))


def _line(text: str, *values: Column) -> Column:
    return F.format_string(text.replace("{}", "%s"), *values)


def profile(spaces: DataFrame, memories: DataFrame, tasks: DataFrame, mentions: DataFrame, mode: str = "brief") -> DataFrame:
    """space_id, n_memories, memories (12), decisions (6), todos (10), tags (10) and digest of each space (space_id, name, goal).

    memories: space_id, id, title, memory_type, created_at, status, is_superseded; tasks: space_id, id, title, priority, status, due; mentions:
    space_id, tag.  Counts cover all; lists hold the newest, the most urgent and the most frequent.  mode is brief, risk, handoff or weekly.
    """
    live = memories.where(~F.col("is_superseded"))
    newest = [F.desc("created_at"), F.desc("id")]
    shown = live.where(~F.col("status").isin("wrong", "deleted", "muted"))
    todo = tasks.where(F.col("status").isin("todo", "doing"))
    rank = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    often = mentions.groupBy("space_id", "tag").agg(F.count("*").alias("c"))
    parts = [
        shown.groupBy("space_id").agg(F.count("*").alias("n_memories")), _first(shown, newest, 12, F.col("title"), "memories"), _first(live.where("memory_type = 'DECISION'"), newest, 6, F.col("title"), "decisions"),
        _first(todo, [rank, F.asc_nulls_first("due"), F.asc("id")], 10, F.struct("title", "priority", F.col("due").isNotNull().alias("due")), "todos"), _first(often, [F.desc("c"), F.asc("tag")], 10, F.col("tag"), "tags"),
    ]
    own = reduce(lambda a, b: a.join(b, "space_id", "left"), parts, spaces.select("space_id", "name", "goal")).fillna(0, ["n_memories"])
    empty = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("memories", "decisions", "tags")}
    own = own.withColumns(empty | {"todos": F.coalesce("todos", F.array().cast("array<struct<title:string,priority:string,due:boolean>>"))})
    first = lambda c, n, sep: F.array_join(F.slice(c, 1, n), sep)
    titles = F.transform("todos", lambda x: x["title"])
    high = F.size(F.filter("todos", lambda x: x["priority"] == "high"))
    risky = F.transform(F.filter("todos", lambda x: (x["priority"] == "high") | x["due"]), lambda x: x["title"])
    busy, some = F.size("todos") > 0, lambda c: F.size(c) > 0
    lines = [
        _line(DIGEST["head"], F.col("name"), F.lit(mode)), F.when(F.coalesce("goal", F.lit("")) != "", _line(DIGEST["goal"], F.col("goal"))), F.when(some("tags"), _line(DIGEST["tags"], first(F.col("tags"), 6, "、"))),
        F.when(some("decisions"), _line(DIGEST["decisions"], first(F.col("decisions"), 3, "；"))), F.when(busy, _line(DIGEST["todos"], F.size("todos").cast("string"), high.cast("string"))),
        F.when(busy, _line(DIGEST["next"], first(titles, 3, "；"))).when(some("memories"), DIGEST["no_todos"]).otherwise(DIGEST["nothing"]),
    ]
    lines += {
        "risk": [_line(DIGEST["risk"], F.when(F.size(risky) > 0, first(risky, 4, "；")).otherwise(DIGEST["no_risk"]))], "handoff": [F.lit(DIGEST["handoff"])],
        "weekly": [_line(DIGEST["weekly"], F.size("memories").cast("string"), F.size("decisions").cast("string"))],
    }.get(mode, [])
    return own.select("space_id", "n_memories", "memories", "decisions", titles.alias("todos"), "tags", F.concat_ws("\n", *lines).alias("digest"))


def candidates(memories: DataFrame, mentions: DataFrame, tasks: DataFrame | None = None, titles: DataFrame | None = None, least: int = 2, n_tags: int = 8) -> tuple[DataFrame, DataFrame]:
    """Sessions that look like a space of their own, grouped by the letters of their name; and their sources.

    First: candidate_key, name, description, sessions, n_memories, n_tasks, confidence, aliases.  Second: candidate_key, session_id, a row for each session, from
    which memories and tasks follow by joins.  memories: id, session_id, title, created_at; mentions: memory_id, tag, relevance; tasks: session_id; titles:
    session_id, title.  A session is named by its own title, unless that is blank or only its id, else by its newest memory's, else by its first tags.
    """
    newest = F.struct("created_at", "id")
    per = memories.groupBy("session_id").agg(F.count("*").alias("m"), F.max_by(F.nullif(F.trim(F.col("title")), F.lit("")), newest).alias("_memory")).where(F.col("m") >= least)
    tag = mentions.join(memories.select(F.col("id").alias("memory_id"), "session_id"), "memory_id").groupBy("session_id", "tag").agg(F.count("*").alias("c"), F.max("relevance").alias("x"))
    top = W.Window.partitionBy("session_id").orderBy(F.desc("c"), F.desc("x"), "tag")
    tags = tag.withColumn("r", F.row_number().over(top)).where(F.col("r") <= n_tags).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("r", "tag"))).alias("t")).select("session_id", F.transform("t", lambda x: x["tag"]).alias("tags"))
    per = per.join(tags, "session_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    per = per.join(tasks.groupBy("session_id").agg(F.count("*").alias("t")), "session_id", "left").fillna(0, ["t"]) if tasks is not None else per.withColumn("t", F.lit(0))
    per = per.join(titles.select("session_id", F.nullif(F.trim("title"), F.lit("")).alias("_own")), "session_id", "left") if titles is not None else per.withColumn("_own", F.lit(None).cast("string"))
    own = F.when(F.col("_own") != F.col("session_id").cast("string"), F.col("_own"))
    per = per.withColumn("name", F.coalesce(own, "_memory", F.array_join(F.slice("tags", 1, 3), " ")))
    per = saved(per.withColumn("candidate_key", letters(F.col("name"))), "candidates")
    score = F.least(F.lit(0.92), 0.48 + 0.04 * F.col("m") + 0.08 * F.col("t") + 0.02 * F.size("tags"))
    named = per.select("candidate_key", F.explode(F.concat(F.array("name"), F.slice("tags", 1, 6))).alias("a")).groupBy("candidate_key").agg(F.sort_array(F.collect_set("a")).alias("aliases"))
    text = F.concat_ws("; ", F.concat(F.lit("memories: "), F.col("m").cast("string")), F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join(F.slice("tags", 1, 5), ", "))))
    out = per.groupBy("candidate_key").agg(F.min("name").alias("name"), F.min_by(text, "session_id").alias("description"), F.count("*").alias("sessions"), F.sum("m").alias("n_memories"), F.sum("t").alias("n_tasks"), F.round(F.max(score), 6).alias("confidence"))
    return out.join(named, "candidate_key"), per.select("candidate_key", "session_id")


def letters(c: Column) -> Column:
    """The letters and digits of a name, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def unbound(memories: DataFrame, bound: DataFrame) -> DataFrame:
    return memories.join(bound.select("id"), "id", "left_anti")


def lookup_prefix(ids: DataFrame, memories: DataFrame, n: int = 8) -> DataFrame:
    """prefix, id: memories whose id starts with a short id, by an equality join on the first characters."""
    return ids.join(memories.select("id", F.substring(F.col("id").cast("string"), 1, n).alias("prefix")), "prefix")


def cleanup(memories: DataFrame, mentions: DataFrame, marks: Column) -> tuple[DataFrame, DataFrame]:
    """Memories and mentions without those of memories that mention a marked tag."""
    gone = mentions.where(marks).select("memory_id").distinct()
    return memories.join(gone, F.col("id") == F.col("memory_id"), "left_anti"), mentions.join(gone, "memory_id", "left_anti")


def holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """text_id, term: which terms stand anywhere in which texts (text_id, text; term), by an equality join of a term's first three characters.

    Only texts that hold these characters meet the term, and each such pair is tested; texts and terms are names, not documents.
    """
    n = 3
    spots = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - k + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(k)))
    grams = texts.where("text <> ''").select("text_id", "text", F.explode(F.array_distinct(F.flatten(F.array(*[spots(k) for k in range(1, n + 1)])))).alias("g"))
    heads = terms.where("term <> ''").select("term", F.substring("term", 1, n).alias("g")).distinct()
    return grams.join(heads, "g").where(F.contains("text", "term")).select("text_id", "term").distinct()


def suggest(candidates_: DataFrame, spaces: DataFrame, least: float = 0.45) -> DataFrame:
    """candidate_key, space_id, score: the existing space that fits best, by name (1), alias (0.9), the share of the candidate's tags that stand in its texts, or 0.72 if one's texts hold the other's.

    candidates_: candidate_key, name, tags; spaces: space_id, name, aliases, terms.
    """
    named = spaces.select("space_id", letters(F.col("name")).alias("k"), F.lit(1.0).alias("score")).union(spaces.select("space_id", F.explode("aliases").alias("a")).select("space_id", letters(F.col("a")), F.lit(0.9)))
    by_name = candidates_.select("candidate_key", letters(F.col("name")).alias("k")).join(named, "k").select("candidate_key", "space_id", "score")
    whole = lambda c: normalize_conversation(c)
    body = spaces.select(F.col("space_id").alias("text_id"), whole(F.concat_ws(" ", "name", F.array_join("aliases", " "), F.array_join("terms", " "))).alias("text"))
    own = candidates_.select("candidate_key", F.size(F.array_distinct("tags")).alias("n"), F.explode(F.array_distinct("tags")).alias("t")).withColumn("term", whole(F.col("t"))).where("term <> ''")
    by_tag = own.join(holding(body, own.select("term")), "term").groupBy("candidate_key", F.col("text_id").alias("space_id")).agg((F.count_distinct("t") / F.max("n")).alias("score"))
    wide = candidates_.select("candidate_key", whole(F.concat_ws(" ", "name", F.array_join("tags", " "))).alias("term"))
    inside = holding(body, wide.select("term")).join(wide, "term").select("candidate_key", F.col("text_id").alias("space_id"))
    around = holding(wide.select(F.col("candidate_key").alias("text_id"), F.col("term").alias("text")), body.select(F.col("text").alias("term")))
    around = around.join(body.select(F.col("text").alias("term"), F.col("text_id").alias("space_id")), "term").select(F.col("text_id").alias("candidate_key"), "space_id")
    by_text = inside.union(around).distinct().withColumn("score", F.lit(0.72))
    best = by_name.union(by_tag).union(by_text).groupBy("candidate_key", "space_id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    order = W.Window.partitionBy("candidate_key").orderBy(F.desc("score"), "space_id")
    return best.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def merge_suggestions(candidates_: DataFrame, k: int = 3) -> DataFrame:
    """a, b, n, score, rank: for each candidate (candidate_key, terms) the others that share most of its terms, 0.55 + 0.12 for each, 0.95 at most.

    A term is shared if it stands in a term of the other or holds one.  Pairs of terms are found once for all candidates; candidates with the same
    terms are compared once.  Pairs of candidates grow with the square of those that share a term, as the best of all of them are wanted.
    """
    own = candidates_.select("candidate_key", F.sort_array(F.array_distinct("terms")).alias("terms"))
    groups = own.groupBy("terms").agg(F.min("candidate_key").alias("g"))
    members = saved(own.join(groups, "terms").select("candidate_key", "g"), "members")
    rows = saved(groups.select("g", F.explode("terms").alias("t")).where("t <> ''"), "terms")
    names = rows.select(F.col("t").alias("term")).distinct()
    related = holding(names.select(F.col("term").alias("text_id"), F.col("term").alias("text")), names)
    related = saved(related.select(F.col("text_id").alias("t"), F.col("term").alias("o")).union(related.select("term", "text_id")).distinct(), "related")
    met = rows.join(related, "t").join(rows.select(F.col("g").alias("h"), F.col("t").alias("o")), "o").groupBy("g", "h").agg(F.count_distinct("t").alias("n"))
    # Of each group only the first k + 1 members can be among the k best of anything.
    first = members.withColumn("r", F.row_number().over(W.Window.partitionBy("g").orderBy("candidate_key"))).where(F.col("r") <= k + 1)
    near = met.join(first.select(F.col("g").alias("h"), F.col("candidate_key").alias("b")), "h")
    best_of_group = W.Window.partitionBy("g").orderBy(F.desc("n"), "b")
    near = near.withColumn("r", F.row_number().over(best_of_group)).where(F.col("r") <= k + 1).select("g", "b", "n")
    both = members.select("g", F.col("candidate_key").alias("a")).join(near, "g").where("a <> b")
    order = W.Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "n", F.round(F.least(F.lit(0.95), 0.55 + 0.12 * F.col("n")), 6).alias("score"), "rank")


def decide(candidates_: DataFrame, sources: DataFrame, decisions: DataFrame, memories: DataFrame, tasks: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """What decisions (candidate_key, decision, space_id) bring: spaces, bindings, tasks, sessions, aliases and statuses.

    candidates_: candidate_key, name, confidence, aliases; sources: candidate_key, session_id; memories: id, session_id; tasks and sessions have session_id
    and space_id.  accept and new_space make a space of the candidate's name with its aliases; merge binds to an existing one, whose alias
    the name becomes; reject and ignore bind nothing.  Bound memories have the candidate's confidence as relevance, tasks move to the space,
    sessions only if they have none; a session that two decisions name goes to the smaller space.
    """
    own = saved(candidates_.join(decisions, "candidate_key"), "decided")
    bound = own.where(F.col("decision").isin("accept", "new_space", "merge"))
    made = bound.where(F.col("decision") != "merge").select("space_id", "name").distinct()
    named = bound.select("space_id", F.explode(F.when(F.col("decision") == "merge", F.array("name")).otherwise(F.col("aliases"))).alias("alias")).where("alias <> ''").distinct()
    by_session = sources.join(bound.select("candidate_key", "space_id", "confidence"), "candidate_key").groupBy("session_id", "space_id").agg(F.max("confidence").alias("relevance"))
    by_session = saved(by_session, "bound")
    first = by_session.groupBy("session_id").agg(F.min("space_id").alias("_space"))
    status = F.when(F.col("decision").isin("accept", "new_space"), "accepted").when(F.col("decision") == "merge", "merged_to_existing").otherwise("ignored")
    return {
        "spaces": made,
        "bindings": memories.select(F.col("id").alias("memory_id"), "session_id").join(by_session, "session_id").select("memory_id", "space_id", "relevance"),
        "tasks": tasks.join(first, "session_id", "left").withColumn("space_id", F.coalesce("_space", "space_id")).drop("_space"),
        "sessions": sessions.join(first, "session_id", "left").withColumn("space_id", F.coalesce("space_id", "_space")).drop("_space"),
        "aliases": named,
        "statuses": own.select("candidate_key", status.alias("status")),
    }
