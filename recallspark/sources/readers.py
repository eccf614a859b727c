"""Transcripts of agents as turns: JSON lines in four shapes, plain text, and an inbox of whole conversations.

Files are split by byte ranges as any text is; a line's place is the start of its split and its number there, so a file of any size is
read by many tasks, and what depends on the order of its lines is worked out range by range.  All is built-in expressions.  Turns:
path, session_id, turn_index, role, content, is_tool_call, is_tool_result, is_final_answer, tool_name, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.operators.ranges import numbered, running
from recallspark.sources.scratch import saved

TASKS = 8
PARTS = "array<struct<type:string,text:string,name:string,tool_name:string>>"
TOOL_CALLS, TOOL_RESULTS, TEXTS = ("tool_use", "function_call"), ("tool_result", "function_call_result"), ("text", "input_text", "output_text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, line of all files; blank lines are dropped.  pos orders the lines of a file: where their split begins, and their order in it.

    Very many small files, of which Spark would give each task a few, are read by TASKS tasks for each core; more bytes than fill the splits of these have more tasks.
    """
    pos = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    text = spark.read.text(path, lineSep="\n")
    size = int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as the files were listed
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, -(-size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    whole = text.select(F.col("_metadata.file_path").alias("path"), pos.alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))
    return whole.where(F.trim("line") != "").coalesce(tasks)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines that are JSON objects; others are skipped."""
    return lines(spark, path).where(F.try_parse_json("line").isNotNull() & F.col("line").rlike(r"^\s*\{"))


def flatten_content(c: Column) -> Column:
    """Struct of text, is_tool_call, is_tool_result and tool_name of a message content: a string, a list of parts or one object."""
    s = F.coalesce(c, F.lit(""))
    parts = F.when(s.rlike(r"^\s*\["), F.from_json(s, PARTS)).when(s.rlike(r"^\s*\{"), F.from_json(F.concat(F.lit("["), s, F.lit("]")), PARTS))
    plain = F.filter(F.when(s.rlike(r"^\s*\["), F.from_json(s, "array<string>")), lambda x: ~x.rlike(r"^\s*[\{\[]"))
    texts = F.filter(F.transform(F.filter(parts, lambda p: p["type"].isin(*TEXTS) | p["type"].isNull()), lambda p: F.trim(F.coalesce(p["text"], F.lit("")))), lambda t: t != "")
    texts = F.concat(F.coalesce(texts, F.array().cast("array<string>")), F.coalesce(plain, F.array().cast("array<string>")))
    is_list = parts.isNotNull() | (F.size(plain) > 0)  # of objects, which a list of strings alone is not read as
    call = F.coalesce(F.exists(parts, lambda p: p["type"].isin(*TOOL_CALLS)), F.lit(False))
    result = F.coalesce(F.exists(parts, lambda p: p["type"].isin(*TOOL_RESULTS)), F.lit(False))
    named = F.filter(F.transform(parts, lambda p: F.coalesce(p["name"], p["tool_name"])), lambda n: n.isNotNull())
    name = F.when(F.size(named) > 0, F.element_at(named, -1)).otherwise("")
    return F.struct(F.when(is_list, F.array_join(texts, " ")).otherwise(F.trim(s)).alias("text"), call.alias("is_tool_call"), result.alias("is_tool_result"), F.coalesce(name, F.lit("")).alias("tool_name"))


def _field(*paths: str) -> Column:
    """The first of some JSON paths of a line that holds something."""
    return F.coalesce(*[F.nullif(F.get_json_object("line", p), F.lit("")) for p in paths])


def _turns(df: DataFrame, session: Column, role: Column, content: Column, ts: Column, keep: Column) -> DataFrame:
    flat = df.select("path", "pos", session.alias("_s"), role.alias("role"), flatten_content(content).alias("_c"), ts.alias("_ts"), keep.alias("_k"))
    # Backwards, so that the row before one is the turn that follows it.
    flat = saved(flat, "lines")
    said = F.when((F.col("role") == "assistant") & (F.col("_c.text") != "") & F.col("_k"), F.col("pos"))
    files = flat.groupBy("path").agg(F.max("_s").alias("_named"), F.sum(F.col("_k").cast("long")).alias("_n"), F.max(said).alias("_last"))
    flat = numbered(flat.where("_k"), ["path"], [F.desc("pos")], "role").join(files, "path")
    flat = flat.withColumn("session_id", F.coalesce("_named", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))).withColumn("turn_index", (F.col("_n") - F.col("k")).cast("int"))
    nxt = F.when(F.col("k") > 1, F.coalesce("before", F.lit("")))
    final = (F.col("role") == "assistant") & (F.col("_c.text") != "") & (nxt.isNull() | (nxt == "user") | ((nxt == "tool") & (F.col("_last") == F.col("pos"))))
    return flat.select("path", "session_id", "turn_index", "role", F.col("_c.text").alias("content"), F.col("_c.is_tool_call").alias("is_tool_call"), F.col("_c.is_tool_result").alias("is_tool_result"), final.alias("is_final_answer"), F.col("_c.tool_name").alias("tool_name"), F.coalesce(F.try_to_timestamp("_ts"), F.lit(None).cast("timestamp")).alias("ts"))


def read_session_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of type message with a message object; a line of type session names the session."""
    df = json_lines(spark, path)
    session = F.when(_field("$.type") == "session", _field("$.id", "$.session_id", "$.sessionId"))
    role = F.when(_field("$.message.role").isin("toolResult", "tool"), "tool").otherwise(_field("$.message.role"))
    return _turns(df, session, role, _field("$.message.content"), _field("$.timestamp", "$.message.timestamp"), _field("$.message.role").isNotNull())


def read_nested_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Content at the top or in message; reasoning counts as the assistant's, snapshots and titles as the system's."""
    df = json_lines(spark, path)
    kind = F.coalesce(_field("$.type"), F.lit(""))
    role = F.when(kind == "reasoning", "assistant").when(kind.rlike("snapshot|title"), "system").when(kind.isin(*TOOL_CALLS, *TOOL_RESULTS), "tool").otherwise(F.coalesce(_field("$.role", "$.message.role"), F.lit("unknown")))
    return _turns(df, _field("$.sessionId", "$.session_id"), role, _field("$.content", "$.message.content", "$.text"), _field("$.timestamp"), F.lit(True))


def read_payload_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines that wrap a payload: session_meta names the session; the role follows from both types; the text from the first field that has one."""
    df = json_lines(spark, path)
    outer, inner = F.coalesce(_field("$.type"), F.lit("")), F.coalesce(_field("$.payload.type"), F.lit(""))
    session = F.when(outer == "session_meta", _field("$.payload.id", "$.payload.session_id"))
    role = F.when(inner.rlike("^(function_call|custom_tool_call|tool)"), "tool").when(inner == "user_message", "user").when(inner.isin("agent_message", "agent_reasoning", "reasoning"), "assistant").otherwise(F.coalesce(_field("$.payload.role"), F.lit("system")))
    text = _field("$.payload.content", "$.payload.message", "$.payload.text", "$.payload.output", "$.payload.input", "$.payload.summary", "$.payload.arguments")
    return _turns(df, session, role, text, _field("$.timestamp"), (outer != "session_meta") & (inner != ""))


def read_generic_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines with role and content; human counts as user, and lines that name a tool call or result as tool."""
    df = json_lines(spark, path)
    low, said = F.lower("line"), F.lower(F.coalesce(_field("$.role", "$.type"), F.lit("unknown")))
    tool = low.contains("tool_use") | low.contains("function_call") | low.contains("tool_result")
    role = F.when(tool, "tool").when(said == "human", "user").otherwise(said)
    return _turns(df, _field("$.session_id", "$.sessionId"), role, _field("$.content", "$.text", "$.message"), _field("$.timestamp", "$.ts"), F.lit(True))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Lines that start with User:, Human:, Assistant:, AI: or Tool: begin a turn; the others belong to the turn before."""
    df = lines(spark, path)
    who = F.lower(F.regexp_extract("line", r"(?i)^\s*(user|human|assistant|ai|tool)\s*[:：]", 1))
    df = running(df.withColumn("who", who), ["path"], ["pos"], F.when(F.col("who") != "", 1).otherwise(0), "turn").where("turn > 0")
    text = F.trim(F.regexp_replace("line", r"(?i)^\s*(user|human|assistant|ai|tool)\s*[:：]", ""))
    rows = F.array_sort(F.collect_list(F.struct("pos", text.alias("t"), "who")))
    out = df.groupBy("path", "turn").agg(rows.alias("r"))
    name = F.element_at("r", 1)["who"]
    role = F.when(name.isin("user", "human"), "user").when(name == "tool", "tool").otherwise("assistant")
    return out.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("session_id"), (F.col("turn") - 1).cast("int").alias("turn_index"), role.alias("role"), F.trim(F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("content"))


def profile_jsonl(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """path, valid, invalid and the n most frequent types and roles of each file."""
    ok = F.try_parse_json("line").isNotNull()
    fields = {"types": _field("$.type"), "roles": _field("$.role", "$.message.role", "$.payload.role")}
    own = lines(spark, path).select("path", ok.alias("ok"), *[F.when(ok, v).alias(name) for name, v in fields.items()])
    own = saved(own.groupBy("path", "ok", *fields).agg(F.count("*").alias("n")), "profiles")  # files are read once
    total = own.groupBy("path").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("valid"), F.sum(F.when(F.col("ok"), 0).otherwise(F.col("n"))).alias("invalid"))
    for name in fields:
        count = own.where(F.col(name).isNotNull()).groupBy("path", F.col(name).alias("v")).agg(F.sum("n").alias("n"))
        best = count.withColumn("r", F.row_number().over(W.Window.partitionBy("path").orderBy(F.desc("n"), "v"))).where(F.col("r") <= n)
        total = total.join(best.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name)), "path", "left")
    return total


BRIDGE = "exported_at string, agent string, conversation string, metadata map<string,string>"


def read_bridge(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """Conversations of an inbox that are long enough."""
    return spark.read.schema(BRIDGE).json(path).where(F.length(F.trim("conversation")) >= least)


def newest_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n files that changed last."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path").limit(n)


def time_ranges(turns: DataFrame) -> DataFrame:
    """path, n, start, end of each transcript, in seconds."""
    return turns.groupBy("path").agg(F.count("ts").alias("n"), F.min(F.unix_timestamp("ts")).alias("start"), F.max(F.unix_timestamp("ts")).alias("end"))
