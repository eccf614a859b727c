import json

from recallspark.sources import readers, sinks
from recallspark.streaming import ingest


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(folder)


def test_generic_lines_of_two_talks(spark, tmp_path):
    folder = write(tmp_path / "talks", "north.jsonl", [
        "{\"role\": \"assistant\", \"content\": ", {"role": "assistant", "text": "  ready when you are "}, {"role": "HUMAN", "content": ["first part", "second part"], "ts": "2024-03-05T10:00:00Z"},
        {"type": "note", "content": {"type": "function_call", "name": "grep"}}, {"role": "assistant", "content": []}, {"role": "assistant", "content": [{"type": "input_text", "text": "found it"}]},
        {"content": [{"type": "tool_result", "tool_name": "grep"}, {"type": "text", "text": "3 lines"}]}, {"role": "assistant", "content": None, "message": "that is all"}, "[1, 2]", "   ",
    ])
    write(tmp_path / "talks", "south.jsonl", [{"role": "user", "content": "ping", "sessionId": "s-7"}, {"role": "assistant", "content": "pong"}, {"role": "user", "content": ""}])
    got = {}
    for x in readers.read_generic_jsonl(spark, folder).collect():
        got.setdefault(x.session_id, []).append((x.turn_index, x.role, x.content, x.is_tool_call, x.is_tool_result, x.is_final_answer, x.tool_name))
    assert sorted(got["north"]) == [
        (0, "assistant", "ready when you are", False, False, True, ""), (1, "user", "first part second part", False, False, False, ""), (2, "tool", "", True, False, False, "grep"),
        (3, "assistant", "", False, False, False, ""), (4, "assistant", "found it", False, False, False, ""), (5, "tool", "3 lines", False, True, False, "grep"), (6, "assistant", "that is all", False, False, True, ""),
    ]
    assert [x[1:3] for x in sorted(got["s-7"])] == [("user", "ping"), ("assistant", "pong"), ("user", "")] and sorted(got["s-7"])[1][5]


def test_payloads_in_any_order(spark, tmp_path):
    path = write(tmp_path / "wrapped", "run.jsonl", [
        {"type": "response_item", "timestamp": "2024-02-02T08:00:09Z", "payload": {"type": "function_call_output", "output": "exit 0"}},
        {"type": "response_item", "timestamp": "2024-02-02T08:00:03Z", "payload": {"type": "custom_tool_call", "input": "make"}}, {"type": "response_item", "payload": {}}, {"type": "event_msg", "payload": None},
        {"type": "event_msg", "timestamp": "not a time", "payload": {"type": "agent_reasoning", "text": "think first"}}, {"type": "turn_context", "payload": {"type": "other", "summary": "a summary"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}, {"type": "input_text", "text": "on"}]}},
        {"type": "session_meta", "payload": {"session_id": "late-name"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "done"}},
    ])
    t = readers.read_payload_jsonl(spark, path).orderBy("turn_index").collect()
    assert [(x.role, x.content) for x in t] == [("tool", "exit 0"), ("tool", "make"), ("assistant", "think first"), ("system", "a summary"), ("user", "go on"), ("assistant", "done")]
    assert {x.session_id for x in t} == {"late-name"} and t[2].ts is None and t[5].is_final_answer and not t[2].is_final_answer
    assert [tuple(r)[1:] for r in readers.time_ranges(readers.read_payload_jsonl(spark, path)).collect()] == [(2, 1706860803, 1706860809)]


def test_a_file_of_many_splits(spark, tmp_path):
    import random

    r = random.Random(4)
    rows = [{"role": r.choice(["user", "assistant", "tool"]), "content": f"{k} " + "é" * r.randrange(0, 90)} for k in range(3000)]
    path = write(tmp_path / "big", "big.jsonl", [*rows[:1500], {"role": "system", "content": "", "session_id": "named"}, *rows[1500:]])
    plain = write(tmp_path / "plain", "big.txt", ["lost", *[("User: " if k % 3 == 0 else "Assistant: " if k % 3 == 1 else "") + f"line {k} " + "x" * r.randrange(0, 60) + ("\r" if k % 2 else "") for k in range(3000)]])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def read():
        turns = readers.read_generic_jsonl(spark, path)
        return sorted((x.turn_index, x.session_id, x.role, x.content, x.is_final_answer) for x in turns.collect()), sorted((x.turn_index, x.role, x.content) for x in readers.read_plain(spark, plain).collect()), readers.lines(spark, path).rdd.getNumPartitions()

    whole = read()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert split[2] > 40 and split[:2] == whole[:2]
    assert [x[3] for x in split[0]] == [x["content"].strip() for x in [*rows[:1500], {"content": ""}, *rows[1500:]]] and {x[1] for x in split[0]} == {"named"}
    assert len(split[1]) == 2000 and split[1][1][2].split("\n")[1].startswith("line 2 ")


def test_session_and_nested(spark, tmp_path):
    path = write(tmp_path / "s", "a.jsonl", [{"type": "session", "id": "s9"}, {"type": "message", "message": {"role": "user", "content": "x"}}, {"type": "message", "message": {"role": "toolResult", "content": "y"}}])
    t = readers.read_session_jsonl(spark, path).orderBy("turn_index").collect()
    assert [(x.session_id, x.role, x.content) for x in t] == [("s9", "user", "x"), ("s9", "tool", "y")]
    path = write(tmp_path / "n", "b.jsonl", [{"type": "message", "role": "user", "content": "q", "sessionId": "n1"}, {"type": "reasoning", "message": {"content": "think"}}, {"type": "file-snapshot", "content": ""}])
    t = readers.read_nested_jsonl(spark, path).orderBy("turn_index").collect()
    assert [(x.role, x.content) for x in t] == [("user", "q"), ("assistant", "think"), ("system", "")]


def test_plain_and_profile(spark, tmp_path):
    path = write(tmp_path / "t", "talk.txt", ["intro", "User: one", "more", "Assistant: two", "AI: three", "Tool: four"])
    t = readers.read_plain(spark, path).orderBy("turn_index").collect()
    assert [(x.role, x.content) for x in t] == [("user", "one\nmore"), ("assistant", "two"), ("assistant", "three"), ("tool", "four")]
    path = write(tmp_path / "q", "f.jsonl", [{"type": "a", "role": "user"}, {"type": "a"}, {"type": "b"}, "{bad"])
    p = readers.profile_jsonl(spark, path).first()
    assert (p.valid, p.invalid, p.types, p.roles) == (3, 1, {"a": 2, "b": 1}, {"user": 1})
    assert readers.newest_files(spark, path, 5).count() == 1


def test_inbox_in_batch_and_as_a_stream(spark, tmp_path):
    long = "this conversation is long enough to be taken in " * 12
    df = spark.createDataFrame([("t", "a", "short"), ("t", "a", long), ("t", "b", long.upper()), ("t", "b", long + "more")], "exported_at string, agent string, conversation string")
    sinks.write_bridge(df.selectExpr("*", "map('k', 'v') AS metadata"), str(tmp_path / "in"))
    assert readers.read_bridge(spark, str(tmp_path / "in")).count() == 3
    for more, want in ((None, 2), ("another long conversation that nobody has seen " * 12, 3)):
        if more:
            sinks.write_bridge(spark.createDataFrame([("t", "a", more), ("t", "a", long)], "exported_at string, agent string, conversation string").selectExpr("*", "map('k', 'v') AS metadata"), str(tmp_path / "in"))
        ingest.run_once(ingest.gated(ingest.inbox(spark, str(tmp_path / "in"))).select("agent", "conversation"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_watching_turns_over_batches(spark, tmp_path):
    seen = []
    schema = "session_id string, turn_index long, role string, content string"
    said = lambda k: f"message number {k} that is long enough to count"
    source, put = str(tmp_path / "turns"), lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "turns"))
    put([("s", 0, "user", said(0)), ("q", 0, "user", said(9)), ("x", 0, "assistant", "short")])
    q = ingest.watch(spark.readStream.schema(schema).json(source), lambda df: seen.extend(df.collect()), str(tmp_path / "c"), seconds=1)
    q.processAllAvailable()
    assert seen == []  # questions alone give nothing
    put([("s", 1, "assistant", said(1)), ("s", 2, "system", said(2)), ("s", 3, "user", said(3))])
    q.processAllAvailable()
    put([("s", 4, "assistant", said(4)), ("s", 5, "user", "tiny"), ("s", 6, "user", said(6)), ("s", 7, "assistant", said(7)), ("x", 1, "assistant", None)])
    q.processAllAvailable()
    q.stop()
    assert sorted((r.session_id, r.turn_index, r.conversation) for r in seen) == [
        ("s", 3, f"User: {said(0)}\nAssistant: {said(1)}\nUser: {said(3)}"),
        ("s", 7, f"User: {said(3)}\nAssistant: {said(4)}\nUser: {said(6)}\nAssistant: {said(7)}"),
    ]


def test_due_jobs(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    at = lambda day, hour: datetime(2024, 1, day, hour)
    rows = [("refresh", at(2, 0), 43200, None), ("late", at(1, 23), 43200, None), ("never", None, 5, None), ("risk", at(1, 23), 0, 10), ("risk done", at(2, 10), 0, 10), ("risk later", at(1, 9), 0, 13)]
    got = {r.job: r.due for r in ingest.due_jobs(spark.createDataFrame(rows, "job string, last_run timestamp, every long, hour int"), F.lit("2024-01-02 11:30:00").cast("timestamp")).collect()}
    assert got == {"refresh": False, "late": True, "never": True, "risk": True, "risk done": False, "risk later": False}


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k % 50}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 50}" / f"{k}.jsonl").write_text('{"type": "message", "role": "user"}\n{broken\n')
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        own = readers.lines(spark, f"{tmp_path}/*/*")
        assert own.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism  # 300 before
        assert own.count() == own.select("path", "pos").distinct().count() == 600
        p = readers.profile_jsonl(spark, f"{tmp_path}/*/*").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(p) == 300 and {(r.valid, r.invalid, r.types["message"], r.roles["user"]) for r in p} == {(1, 1, 1, 1)}


def test_batches_of_streams_are_files_of_many_tasks(spark, tmp_path, monkeypatch):
    from recallspark.plans import files

    for k, run in enumerate((files._late, files._idle)):
        monkeypatch.setattr(files, "scratch_path", lambda s, name, k=k: f"{tmp_path}/{k}/{name}")
        run(spark, "/root/testdata/sf0.001")
    for name in ("0/late/0", "0/late/2", "1/turns/0"):
        assert len(list(tmp_path.glob(f"{name}/*.parquet"))) > 1, name  # one file before, which one task read
