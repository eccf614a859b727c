"""Column functions over text against literal results."""

import hashlib

from pyspark.sql import functions as F

from recallspark.functions import text as X

NORMALISED = [
    ('2026年7月1日 done', '2026 07 01 done'),
    ('2026/2/30 stays', '2026/2/30 stays'),
    ('2024.02.29x', '2024 02 29x'),
    ('2023-02-29', '2023 02 29'),
    ('on 2026/12/31, 2026-1-5日', 'on 2026 12 31 2026 01 05'),
    ('2026/7/1日和2025年11月30日', '2026 07 01和2025 11 30'),
    ('a <Mood>x\ny</mood> b', 'a b'),
    ('id 123e4567-e89b-12d3-a456-426614174000!', 'id <id'),
    ('see `1a2b3c4d...` ok', 'see <id ok'),
    ('提取方式：llm 冲突: 3 条 状态：done', ''),
    ('ID: `abcdef12-3456`', ''),
    ('**Bold** _x_ # h > q - z', 'bold x h q z'),
    ('，。！？「x」 A\u3000B', '「x」 a b'),
    ('\r\nLINE\rtwo', 'line two'),
    ('', ''),
    ('2026年7月', '2026年7月'),
    ('12026/1/2', '12026 01 02'),
    ('2026/7/123 x', '2026 07 123 x'),
    ('2026/1/32 x', '2026/1/32 x'),
    ('2024-2-30', '2024 2 30'),
]


def test_normalisation(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(NORMALISED)] + [(99, None)], "k int, t string")
    got = {r.k: r.n for r in df.select("k", X.normalize_conversation("t").alias("n")).collect()}
    assert [got[k] for k in range(len(NORMALISED))] == [n for _, n in NORMALISED]
    assert got[99] == ""


def test_gate_with_external_scores(spark):
    rows = [("x" * 600, [3, 3, 2, 1]), ("x" * 600, [9, 9, 9, 9]), ("x" * 40, [0, -5, 0, 0]), ("x" * 600, None), ("short", [5, 5, 5, 5]), ("x" * 40, [4, 3, None, None])]
    df = spark.createDataFrame(rows, "t string, s array<int>").select(X.value_gate("t", F.col("s")).alias("g"))
    assert [(r.g.total, r.g.verdict, r.g.reason) for r in df.collect()] == [(2.45, "skip", "scored"), (5.0, "write", "scored"), (1.0, "skip", "scored"), (3.3, "write", "length"), (0.0, "skip", "short"), (2.5, "gray", "scored")]


def test_action_keys(spark):
    rows = ["添加了一个测试待办“买牛奶和面包”", "切换 space 空间：工作台 现在", "nothing here", "标记这条记忆 123e4567-e89b-12d3-a456-426614174000", ""]
    got = [r.k for r in spark.createDataFrame([(t,) for t in rows], "t string").select(X.action_keys("t").alias("k")).collect()]
    assert [k.action_key.split(":")[0] for k in got] == ["todo_add", "space_activate", "", "memory_govern", ""]
    assert got[0].entity_key == "买牛奶和面包"
    assert got[3].entity_key == "123e4567-e89b-12d3-a456-426614174000"
    assert got[2].fact_key == hashlib.sha256(b"nothing here").hexdigest()[:16]


def test_subjects_titles_gates_and_dates(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    assert one(X.is_memory_subject_text("t"), "please keep in mind that the build needs java") is True
    assert one(X.is_memory_subject_text("t"), "<system-reminder> " + "x" * 50) is False
    assert one(X.is_memory_subject_text("t"), "short") is False
    assert one(X.auto_title("t"), "  First line\nsecond. third") == "First line"
    assert one(X.auto_title("t"), "一句。二句\nx") == "一句"
    assert one(X.auto_title("t"), "a" * 90) == "a" * 80 + "..."
    assert one(X.compact_display_title("t", F.lit("file"), 10)["title"], "User:  hello there you") == "hello ther…"
    assert one(X.compact_display_title("t", F.lit("file"), 10)["title_source"], " \n") == "file_name"
    assert one(X.value_gate("t")["verdict"], "x" * 501) == "write"
    assert one(X.value_gate("t")["reason"], "https://example.com/some/long/path/here") == "url"
    assert [one(X.due_date("t")["ok"], t) for t in ("", "2026-02-28T10:30", "2026-02-30T10:30", "2026-02-28", "2026-02-28T10:30:00")] == [True, True, False, False, False]
    assert one(X.redact_home("t", "/home/me"), "/Home/me/x") == "~/x"
    assert one(X.content_length("t", F.lit("abc")), '{"content_length": 10}') == 10
    assert one(X.content_length("t", F.lit("abc")), "{}") == 3
    assert one(X.title_key("t"), "A b-C! 中文é") == "abc中文é"
    assert one(X.quality_flags("t", F.lit("")), "my API key sk-1") == ["pollution:api key", "pollution:sk-"]


def test_a_record_is_of_the_task_that_its_text_names(spark):
    from recallspark.operators import dedupe

    said = "添加了一个测试待办“买牛奶 3 号”。 "
    rows = [(1, said + "one", "t", "s", 0), (2, said + 'two. key = "49c25cfcc734f18e"', 'two. key = "49c25cfcc734f18e"', 'two. key = "49c25cfcc734f18e"', 60), (3, "添加了一个测试待办 three", "u “买牛奶 3 号”", "v", 90)]
    df = spark.createDataFrame(rows, "id long, raw_text string, title string, summary string, s long").selectExpr("*", "timestamp_seconds(s) AS created_at")
    assert {r.id: r.reason for r in dedupe.records(df).collect()} == {1: None, 2: "action_duplicate", 3: "action_duplicate"}


def test_titles_and_summaries_of_long_and_blank_texts(spark):
    odd = [None, "", " ", "\n", "  a. \n ", " x y　", "a" * 300, " " * 700 + "b c " * 100, "b " * 120, "b " * 121, "b  " * 160 + " ", "x. ", "x\n", "  Ab。\n", "a" + " " * 500 + "b" * 300, "ab " * 79 + "abc" + "  " * 200, "😀 " * 400]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, t string")
    squeezed = F.trim(F.regexp_replace(X.text_of("t"), X.BLANK, " "))
    bare = F.regexp_replace(X.text_of("t"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    first = F.when(bare.contains("。"), F.substring_index(bare, "。", 1)).when(bare.contains("\n"), F.substring_index(bare, "\n", 1)).when(bare.contains(". "), F.substring_index(bare, ". ", 1)).otherwise(bare)
    for n in (3, 240):
        assert df.where(~X.compact("t", n).eqNullSafe(X.cut(squeezed, n, "..."))).count() == 0
    assert df.where(~X.auto_title("t").eqNullSafe(X.cut(first, 80, "..."))).count() == 0
