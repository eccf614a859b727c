"""Queries over files and streams that Spark first writes from the given tables."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallspark.plans import views as V
from recallspark.sources import readers, sinks
from recallspark.sources.scratch import scratch_path
from recallspark.streaming import ingest


def _written(s, d, line, kind="transcripts"):
    """A file for each conversation, with a line for each turn."""
    path = scratch_path(s, kind)
    own = V.turns(s, d).withColumn("value", line).where("value is not null")
    # Turns of one conversation meet in one task and are written in order, a file for each.
    own.select("value", "turn_index", F.col("session_id").alias("file")).repartition("file").sortWithinPartitions("file", "turn_index").select("value", "file").write.partitionBy("file").text(path)
    return f"{path}/*/*"


def _number():
    return F.col("turn_index")


def _stamp():
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("session_id") * 3600 + F.col("turn_index") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _name():
    return F.concat(F.lit("s"), F.col("session_id").cast("string"))


def _json(**fields):
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))


def _transcripts(s, d):
    """Lines of the generic shape; those of the system are not JSON."""
    line = _json(type="message", role=F.when(F.col("role") == "user", "human").otherwise(F.col("role")), content=F.col("content"), session_id=_name())
    return _written(s, d, F.when(F.col("role") == "system", F.concat(F.lit("{broken "), F.substring(F.regexp_replace("content", "\\s+", " "), 1, 20))).otherwise(line))


def _parts(*extra):
    """Content as a list of parts: the text, then what else is there."""
    return F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("name")), *extra)


def _session_lines(s, d):
    """The first line names the session, answers are lists of parts with a tool call, others strings."""
    call = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("shell").alias("name"))
    said = F.when(F.col("role") == "assistant", _json(type="message", message=F.struct(F.col("role"), _parts(call).alias("content")), timestamp=_stamp())).otherwise(_json(type="message", message=F.struct(F.when(F.col("role") == "system", "toolResult").otherwise(F.col("role")).alias("role"), F.col("content").alias("content")), timestamp=_stamp()))
    head = _json(type="session", id=F.concat(F.lit("x"), F.col("session_id").cast("string")))
    return readers.read_session_jsonl(s, _written(s, d, F.when(_number() == 0, F.concat(head, F.lit("\n"), said)).otherwise(said)))


def _nested_lines(s, d):
    """Content at the top of users' lines and in message of others; the system's come as snapshots."""
    said = F.when(F.col("role") == "user", _json(type="message", role=F.col("role"), content=F.col("content"), sessionId=_name())).when(F.col("role") == "assistant", _json(type="reasoning", message=F.struct(F.col("content")), sessionId=_name())).otherwise(_json(type="file-snapshot", content=F.col("content"), sessionId=_name()))
    return readers.read_nested_jsonl(s, _written(s, d, said))


def _payload_lines(s, d):
    """Events of users, messages of assistants, and outputs of tools in payloads, behind a line that names the session."""
    user = _json(timestamp=_stamp(), type="event_msg", payload=F.struct(F.lit("user_message").alias("type"), F.col("content").alias("message")))
    answer = _json(timestamp=_stamp(), type="response_item", payload=F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), F.col("content").alias("text"))).alias("content")))
    tool = _json(timestamp=_stamp(), type="response_item", payload=F.struct(F.lit("function_call_output").alias("type"), F.col("content").alias("output")))
    said = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", answer).otherwise(tool)
    head = _json(timestamp=_stamp(), type="session_meta", payload=F.struct(_name().alias("id")))
    return readers.read_payload_jsonl(s, _written(s, d, F.when(_number() == 0, F.concat(head, F.lit("\n"), said)).otherwise(said)))


def _plain_lines(s, d):
    """Prefixes start a turn; texts go on over lines."""
    who = F.when(F.col("role") == "user", F.when(_number() % 2 == 0, "User: ").otherwise("human：")).when(F.col("role") == "assistant", F.when(_number() % 2 == 0, "AI: ").otherwise("Assistant:")).otherwise("Tool: ")
    return readers.read_plain(s, _written(s, d, F.concat(who, F.col("content"))))


def _told(turns):
    """What the readers found, without paths."""
    return turns.select("session_id", F.col("turn_index").cast("long"), "role", F.sha2("content", 256).alias("h"), "is_tool_call", "is_tool_result", "is_final_answer", "tool_name", "ts")


def _newest(s, d):
    """The last three of seven files that are written one after the other, a file for each seventh of the conversations, and the last written one first."""
    path = scratch_path(s, "written")
    t = V.turns(s, d)
    for k in range(7):
        t.where(F.col("session_id") % 7 == k).select("content").coalesce(1).write.mode("append").option("maxRecordsPerFile", 0).text(f"{path}/{k}")
        time.sleep(1.1)  # times of files may be whole seconds
    found = readers.newest_files(s, f"{path}/*/*.txt", 3)
    place = F.row_number().over(W.Window.orderBy(F.desc("modificationTime"), "path"))  # three rows
    return found.select(place.alias("place"), F.regexp_extract("path", r"/([0-9])/[^/]*$", 1).cast("int").alias("file"), "length")


def _generic(s, d):
    return _told(readers.read_generic_jsonl(s, _transcripts(s, d))).drop("ts", "tool_name", "is_tool_result")


def _profile(s, d):
    p = readers.profile_jsonl(s, _transcripts(s, d))
    return p.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("session_id"), "valid", "invalid", F.coalesce(F.col("types")["message"], F.lit(0)).alias("messages"), F.coalesce(F.col("roles")["human"], F.lit(0)).alias("humans"))


def _inbox(s, d):
    path = scratch_path(s, "inbox")
    t = V.turns(s, d).select(F.lit("2024-01-01").alias("exported_at"), F.concat(F.lit("a"), F.col("agent").cast("string")).alias("agent"), F.col("content").alias("conversation"), F.create_map(F.lit("turn"), F.col("turn_index").cast("string")).alias("metadata"))
    sinks.write_bridge(t, path)
    return path


def _bridge(s, d):
    return readers.read_bridge(s, _inbox(s, d)).groupBy("agent").agg(F.count("*").alias("n"), F.sum(F.length("conversation")).alias("chars"))


def _streamed(s, d):
    """The inbox as a stream, taken in once by the gate, then read as a table."""
    out, check = scratch_path(s, "taken"), scratch_path(s, "state")
    ingest.run_once(ingest.gated(ingest.inbox(s, _inbox(s, d))).select("agent", "conversation", "gate"), out, check).awaitTermination()
    return s.read.parquet(out).groupBy("gate").agg(F.count("*").alias("n"), F.count_distinct("conversation").alias("texts"))


def _late(s, d):
    """Three batches of texts an hour apart through the gate with event times.

    Each batch has its third of the conversations, a copy of each of its rows ten seconds later, the third of the batch before once more, which is still known, and rows that are later than
    the watermark.  The last batch has the first third again, which is new then, as its state went with the watermark.
    """
    path, out, check = (scratch_path(s, k) for k in ("late", "taken", "state"))
    t = V.turns(s, d).withColumn("third", F.col("session_id") % 3)
    at = lambda b, seconds: F.timestamp_seconds(F.lit(1704067200 + 3600 * b + seconds))
    for b in range(3):
        now = t.where(F.col("third") == b)
        parts = [now.select("content", at(b, 0).alias("at")), now.select("content", at(b, 10).alias("at")), t.where(F.col("third") == b - 1).select("content", at(b, 5).alias("at"))]
        if b == 2:
            parts.append(t.where("third = 0").select("content", at(b, 20).alias("at")))
        if b:
            parts.append(t.where(F.col("third") == (b + 1) % 3).select("content", at(b - 1, -1800).alias("at")))
        reduce(DataFrame.union, parts).repartition(s.sparkContext.defaultParallelism).write.parquet(f"{path}/{b}")  # files of all tasks, or few would read and gate the batch
        time.sleep(1.1)
        # Each call takes in what is new as one batch, and the watermark of the batches before holds.
        stream = s.readStream.schema("content string, at timestamp").parquet(f"{path}/*")
        ingest.run_once(ingest.gated(stream, "content", "at").select("content", "at", "gate"), out, check).awaitTermination()
    return s.read.parquet(out).groupBy(F.date_trunc("hour", "at").alias("hour"), "gate").agg(F.count("*").alias("n"))


def _idle(s, d):
    """Turns in two batches a day apart, watched by event time: sessions that wait for an hour at most are forgotten between them."""
    path, out, check = (scratch_path(s, k) for k in ("turns", "answers", "state"))
    t = V.turns(s, d).where(F.col("role").isin("user", "assistant"))
    for b, part in enumerate((t.where("turn_index % 4 < 2"), s.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(0).cast("long").alias("turn_index"), F.lit("user").alias("role"), F.lit("tick").alias("content"), F.lit(0).alias("agent")), t.where("turn_index % 4 >= 2"))):
        part.select("session_id", F.col("turn_index").cast("long"), "role", "content", F.timestamp_seconds(F.lit(1704067200 + 86_400 * b)).alias("at")).repartition(s.sparkContext.defaultParallelism).write.parquet(f"{path}/{b}")
        stream = s.readStream.schema("session_id long, turn_index long, role string, content string, at timestamp").parquet(f"{path}/*")
        ingest.run_once(ingest.watched(stream, at="at", idle=3600).withColumn("batch", F.lit(b)), out, check).awaitTermination()
    return s.read.parquet(out).select("session_id", "turn_index", F.when(F.col("batch") == 2, 1).otherwise(F.col("batch")).alias("batch"), F.sha2("conversation", 256).alias("h"))


QUERIES = {
    "s1_session_jsonl": lambda s, d: _told(_session_lines(s, d)),
    "s2_nested_jsonl": lambda s, d: _told(_nested_lines(s, d)).drop("ts"),
    "s3_payload_jsonl": lambda s, d: _told(_payload_lines(s, d)),
    "s5_plain": lambda s, d: _plain_lines(s, d).select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("session_id"), F.col("turn_index").cast("long"), "role", F.sha2("content", 256).alias("h")),
    "s7_newest_files": _newest,
    "j4_time_ranges": lambda s, d: readers.time_ranges(_payload_lines(s, d)).select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("session_id"), "n", "start", "end"),
    "s4_generic_jsonl": _generic, "s8_profile_jsonl": _profile, "s10_bridge": _bridge, "x3_gated_stream": _streamed,
    "x3_late_rows": _late, "x1_forgotten": _idle,
}
_GATE = "CASE WHEN length(trim(text)) > 500 THEN 'write' ELSE 'skip' END"
_FILES = "WITH t AS (SELECT * FROM conversations)"
_FINAL = """n AS (SELECT *, row_number() OVER w - 1 AS turn_index, lead(role) OVER w AS nxt FROM {rows} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  l AS (SELECT *, max(turn_index) FILTER (role = 'assistant' AND trim(text) <> '') OVER (PARTITION BY conv_id) AS last FROM n),
  fin AS (SELECT *, role = 'assistant' AND trim(text) <> '' AND (nxt IS NULL OR nxt = 'user' OR (nxt = 'tool' AND last = turn_index)) AS is_final_answer FROM l)"""
_AT = "TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn)"
ORACLES = {
    "s4_generic_jsonl": f"{_FILES}, g AS (SELECT * REPLACE (CASE role WHEN 'human' THEN 'user' ELSE role END AS role) FROM t WHERE role <> 'system'), {_FINAL.format(rows='g')} SELECT 's' || conv_id::VARCHAR AS session_id, turn_index, role, sha256(trim(text)) AS h, false AS is_tool_call, is_final_answer FROM fin",
    "s8_profile_jsonl": "SELECT conv_id AS session_id, count(*) FILTER (role <> 'system') AS valid, count(*) FILTER (role = 'system') AS invalid, count(*) FILTER (role <> 'system') AS messages, count(*) FILTER (role = 'user') AS humans FROM conversations GROUP BY conv_id",
    "s1_session_jsonl": f"{_FILES}, g AS (SELECT * REPLACE (CASE role WHEN 'system' THEN 'tool' ELSE role END AS role) FROM t), {_FINAL.format(rows='g')} SELECT CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) THEN 'x' || conv_id::VARCHAR ELSE '?' END AS session_id, turn_index, role, sha256(trim(text)) AS h, role = 'assistant' AS is_tool_call, false AS is_tool_result, is_final_answer, CASE role WHEN 'assistant' THEN 'shell' ELSE '' END AS tool_name, {_AT} AS ts FROM fin",
    "s2_nested_jsonl": f"{_FILES}, {_FINAL.format(rows='t')} SELECT 's' || conv_id::VARCHAR AS session_id, turn_index, role, sha256(trim(text)) AS h, false AS is_tool_call, false AS is_tool_result, is_final_answer, '' AS tool_name FROM fin",
    "s3_payload_jsonl": f"{_FILES}, g AS (SELECT * REPLACE (CASE role WHEN 'system' THEN 'tool' ELSE role END AS role) FROM t), {_FINAL.format(rows='g')} SELECT 's' || conv_id::VARCHAR AS session_id, turn_index, role, sha256(trim(text)) AS h, false AS is_tool_call, false AS is_tool_result, is_final_answer, '' AS tool_name, {_AT} AS ts FROM fin",
    "s5_plain": f"{_FILES} SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS h FROM t",
    "s7_newest_files": "SELECT CAST(7 - conv_id % 7 AS INT) AS place, CAST(conv_id % 7 AS INT) AS file, CAST(sum(strlen(text) + 1) AS BIGINT) AS length FROM conversations WHERE conv_id % 7 >= 4 GROUP BY conv_id % 7",
    "x1_forgotten": """WITH m AS (SELECT conv_id AS session_id, turn AS turn_index, role, trim(coalesce(text, '')) AS c, CASE WHEN turn % 4 < 2 THEN 0 ELSE 1 END AS batch FROM conversations WHERE role IN ('user', 'assistant')),
        w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, batch ORDER BY turn_index DESC) <= 10), a AS (SELECT session_id, batch FROM m WHERE role = 'assistant' AND length(c) >= 30 GROUP BY ALL),
        l AS (SELECT session_id, batch, max(turn_index) AS turn_index, list('User: ' || c ORDER BY turn_index) FILTER (role = 'user' AND length(c) >= 30) AS u, list('Assistant: ' || c ORDER BY turn_index) FILTER (role = 'assistant' AND length(c) >= 30) AS v FROM w JOIN a USING (session_id, batch) GROUP BY ALL),
        n AS (SELECT *, greatest(coalesce(len(u), 0), coalesce(len(v), 0)) AS n FROM l)
        SELECT session_id, turn_index, CAST(batch AS INT) AS batch, sha256(CASE WHEN n > 1 THEN concat_ws(chr(10), u[n - 1], v[n - 1], u[n], v[n]) ELSE concat_ws(chr(10), u[n], v[n]) END) AS h FROM n""",
    "x3_late_rows": f"""WITH n AS (SELECT conv_id % 3 AS third, {V.normalized_sql('text')} AS t FROM conversations WHERE {_GATE} = 'write'), a AS (SELECT DISTINCT third, t FROM n), one AS (SELECT t FROM a WHERE third = 1 AND t NOT IN (SELECT t FROM a WHERE third = 0)),
          b AS (SELECT 0 AS hour, t FROM a WHERE third = 0 UNION SELECT 1, t FROM one UNION SELECT 2, t FROM a WHERE third <> 1 AND t NOT IN (SELECT t FROM one))
        SELECT TIMESTAMP '2024-01-01' + to_hours(hour) AS hour, 'write' AS gate, count(*) AS n FROM b GROUP BY hour""",
    "j4_time_ranges": "SELECT conv_id AS session_id, count(*) AS n, 1704067200 + conv_id * 3600 + min(turn) * 60 AS start, 1704067200 + conv_id * 3600 + max(turn) * 60 AS end FROM conversations GROUP BY conv_id",
    "s10_bridge": "SELECT 'a' || (conv_id % 3)::VARCHAR AS agent, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE length(trim(text)) >= 30 GROUP BY 1",
    "x3_gated_stream": f"WITH n AS (SELECT text, {V.normalized_sql('text')} AS t FROM conversations WHERE {_GATE} = 'write') SELECT 'write' AS gate, count(DISTINCT t) AS n, count(DISTINCT t) AS texts FROM n",
}
