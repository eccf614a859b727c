"""The store's tables as views of the driver's tables, in Spark and as common table expressions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions import text as X
from recallspark.sources.scratch import saved

TYPES = ("FACT", "EVENT", "DECISION", "PREFERENCE", "REASONING")
AS_OF = "2001-06-01 12:00:00"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def turns(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"), (F.col("conv_id") % 3).alias("agent"))


TURNS = "turns AS (SELECT conv_id AS session_id, turn AS turn_index, role, text AS content, conv_id % 3 AS agent FROM conversations)"


def sourced_turns(spark, sf) -> DataFrame:
    """turns of which some are tool calls and results, and some have no content stored but its length."""
    t, k = turns(spark, sf), F.col("session_id") + F.col("turn_index")
    answer = F.col("role") == "assistant"
    return t.withColumns({"content_length": F.length("content"), "is_tool_call": answer & (k % 7 == 0), "is_tool_result": answer & (k % 7 == 1), "content": F.when(k % 11 == 0, "").otherwise(F.col("content"))})


SOURCED = """turns AS (SELECT conv_id AS session_id, turn AS turn_index, role, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS content, conv_id % 3 AS agent, CAST(length(text) AS INT) AS content_length,
  role = 'assistant' AND (conv_id + turn) % 7 = 0 AS is_tool_call, role = 'assistant' AND (conv_id + turn) % 7 = 1 AS is_tool_result FROM conversations)"""


def source_sessions(spark, sf) -> DataFrame:
    """Sessions of the turns, some of which have no title of their own."""
    k = F.col("session_id")
    t = turns(spark, sf).groupBy("session_id", "agent").agg(F.max("turn_index").alias("_last"))
    return t.select("session_id", F.concat(F.lit("agent "), F.col("agent").cast("string")).alias("agent"), F.when(k % 4 != 0, F.concat(F.lit("Talk "), k.cast("string"))).alias("original_title"), F.when(k % 4 != 0, F.concat(F.lit("Talk "), k.cast("string"))).otherwise(F.concat(F.lit("file "), k.cast("string"))).alias("display_title"), F.when(k % 4 == 0, "missing").when(k % 2 == 0, "index").otherwise("agent").alias("title_source"), F.when(k % 4 == 0, "file_name").when(k % 5 == 0, "first_user_turn").otherwise("agent_original").alias("display_title_source"), F.timestamp_seconds(F.lit(1704067200) + (k % 50) * 3600 + F.col("_last")).alias("updated_at"))


SESSIONS = """src AS (SELECT conv_id AS session_id, 'agent ' || (conv_id % 3)::VARCHAR AS agent, CASE WHEN conv_id % 4 <> 0 THEN 'Talk ' || conv_id::VARCHAR END AS original_title, CASE WHEN conv_id % 4 <> 0 THEN 'Talk ' ELSE 'file ' END || conv_id::VARCHAR AS display_title,
  CASE WHEN conv_id % 4 = 0 THEN 'missing' WHEN conv_id % 2 = 0 THEN 'index' ELSE 'agent' END AS title_source, CASE WHEN conv_id % 4 = 0 THEN 'file_name' WHEN conv_id % 5 = 0 THEN 'first_user_turn' ELSE 'agent_original' END AS display_title_source,
  TIMESTAMP '2024-01-01' + to_hours(conv_id % 50) + to_seconds(max(turn)) AS updated_at FROM conversations GROUP BY conv_id)"""


def memories(spark, sf) -> DataFrame:
    d, k = read(spark, sf, "documents"), F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + k * 60)
    return d.select(
        k.alias("id"), F.col("source").alias("session_id"), F.col("text").alias("raw_text"), X.auto_title("text").alias("title"), X.compact("text", 240).alias("summary"),
        at.alias("created_at"), at.alias("valid_from"), F.when(k % 7 == 0, F.timestamp_seconds(F.lit(1704067200) + k * 60 + 2592000)).alias("valid_until"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 5 + 1).cast("int")).alias("memory_type"),
        F.when(k % 17 == 0, "muted").when(k % 19 == 0, "deleted").otherwise("active").alias("status"),
        (0.5 + (k % 10) / 20.0).alias("confidence"), (k % 3).cast("int").alias("signal_level"), (k % 23 == 0).alias("is_superseded"),
        (k % 31 == 0).alias("pinned"), (1.0 + (k % 3) / 10.0).alias("user_weight"), F.col("lang").alias("space_id"),
    )


_TRIMMED = r"regexp_replace(coalesce(text,''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_FIRST = "CASE WHEN contains(s,'。') THEN split_part(s,'。',1) WHEN contains(s,chr(10)) THEN split_part(s,chr(10),1) WHEN contains(s,'. ') THEN split_part(s,'. ',1) ELSE s END"
_SQUEEZED = r"trim(regexp_replace(coalesce(text,''), '[\s\p{Z}]+', ' ', 'g'))"
MEMORIES = f"""mem AS (SELECT doc_id AS id, source AS session_id, text AS raw_text,
  left({_FIRST}, 80) || CASE WHEN length({_FIRST}) > 80 THEN '...' ELSE '' END AS title,
  left(q, 240) || CASE WHEN length(q) > 240 THEN '...' ELSE '' END AS summary,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS valid_from,
  CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-31' + to_minutes(doc_id) END AS valid_until,
  list_extract(['FACT','EVENT','DECISION','PREFERENCE','REASONING'], CAST(doc_id % 5 + 1 AS INT)) AS memory_type,
  CASE WHEN doc_id % 17 = 0 THEN 'muted' WHEN doc_id % 19 = 0 THEN 'deleted' ELSE 'active' END AS status,
  0.5::DOUBLE + (doc_id % 10) / 20.0::DOUBLE AS confidence, CAST(doc_id % 3 AS INT) AS signal_level, doc_id % 23 = 0 AS is_superseded,
  doc_id % 31 = 0 AS pinned, 1.0::DOUBLE + (doc_id % 3) / 10.0::DOUBLE AS user_weight, lang AS space_id
  FROM (SELECT *, {_TRIMMED} AS s, {_SQUEEZED} AS q FROM documents))"""


def normalized_sql(c: str) -> str:
    """The SQL of normalize_conversation for texts without dates."""
    out = f"coalesce({c}, '')"
    for pattern, to, flags in [
        ("<mood>.*?</mood>", " ", "gis"),
        (X.UUID, "<id>", "gi"),
        (X.SHORT_ID, "<id>", "gi"),
        *[(p, " ", "gi") for p in X.BOILERPLATE],
        ("\r", "\n", "g"),
        (X.MARKDOWN, " ", "g"),
        (X.PUNCTUATION, " ", "g"),
        (X.BLANK, " ", "g"),
    ]:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', '{flags}')"
    return f"lower(trim({out}))"


#: Texts that say what was done, by the last digit of an id; {} stands for the id.
SAID = [
    "添加了一个测试待办“买牛奶 {} 号”。", "已完成 待办 {}，npm run build 通过。", "创建 space 空间：工作台 {} 号，", "标记这条记忆 123e4567-e89b-12d3-a456-426614174000 为重要。", "更新待办 项目 {}; 状态: done",
    "<mood>calm</mood>2026年7月1日 ID: `abcdef12-3456` 我喜欢 {} 这种方式", "git push origin; see `1a2b3c4d...` {}", "激活 空间 研究 {}", "提取方式: llm 冲突: 3 条 {}", "",
]
DATED = "replace({}, '2026年7月1日', '2026-07-01')"
SPACE_SQL = r"(?:空间|space)[：: ]*([\p{L}\p{M}\p{N}_\- ]{2,60})"
ACTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(joined, '{pattern}', 'i') THEN '{name}'" for name, pattern in X.ACTIONS) + " ELSE '' END"


def operational(spark, sf) -> DataFrame:
    """memories whose texts begin with something that was done."""
    m, k = memories(spark, sf), F.col("id").cast("string")
    said = [F.concat(*[x for part in t.split("{}") for x in (F.lit(part), k)][:-1]) for t in SAID]
    return m.withColumn("raw_text", F.concat(F.element_at(F.array(*said), (F.col("id") % len(SAID) + 1).cast("int")), F.coalesce("raw_text", F.lit(""))))


OPERATIONAL = f"""{MEMORIES}, oper AS (SELECT * REPLACE (replace({SAID}[id % {len(SAID)} + 1], '{{}}', id::VARCHAR) || coalesce(raw_text, '') AS raw_text) FROM mem)"""


def subject_sql(c: str) -> str:
    squeezed = rf"trim(regexp_replace(coalesce({c},''), '[\s\p{{Z}}]+', ' ', 'g'))"
    head = f"lower(left({squeezed}, 240))"
    blocked = " OR ".join([*(f"starts_with({head}, '{p}')" for p in X.BLOCKED_STARTS), *(f"contains({head}, '{p}')" for p in X.BLOCKED_FRAGMENTS)])
    return f"(length({squeezed}) >= 30 AND NOT ({blocked}))"


def baskets(spark, sf) -> DataFrame:
    """memory_id, session_id, ts, tags: the brands of an order, in the order of its lines."""
    line = read(spark, sf, "lineitem").join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    tags = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_brand"))), lambda x: x["p_brand"])
    own = line.groupBy("l_orderkey").agg(tags.alias("tags"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("ts"))
    return own.join(o, "l_orderkey").select(F.col("l_orderkey").alias("memory_id"), "session_id", "ts", "tags")


BASKETS = """baskets AS (SELECT l_orderkey AS memory_id, any_value(o_custkey) AS session_id, any_value(o_orderdate) AS ts,
  list(p_brand ORDER BY l_linenumber, l_partkey, p_brand) AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
uniq AS (SELECT memory_id, session_id, ts, list_transform(list_sort(list_transform(list_distinct(tags), lambda t: {'i': list_position(tags, t), 't': t})), lambda x: x.t) AS tags FROM baskets),
pairs AS (SELECT memory_id, session_id, ts, tags[i] AS source_tag, tags[j] AS target_tag
  FROM uniq, unnest(range(1, len(tags) + 1)) AS a(i), unnest(range(1, len(tags) + 1)) AS b(j) WHERE i < j)"""


def pairs(spark, sf, known: DataFrame | None = None) -> DataFrame:
    from recallspark.operators.tags import cooccurrences

    return cooccurrences(baskets(spark, sf) if known is None else known).withColumn("relation_type", F.lit("CO_OCCUR")).withColumn("id", F.col("memory_id")).withColumn("sim", (F.lit(3) + F.col("memory_id") % 7) / 10.0)


def edges(spark, sf, known: DataFrame | None = None) -> DataFrame:
    from recallspark.operators.tags import hebbian

    return hebbian(pairs(spark, sf, known))


RELATIONS = ("CO_OCCUR", "DERIVED", "CAUSAL", "TEMPORAL", "CONTRADICT", "REFINES", "SUPERSEDES", "OTHER")


def typed_edges(spark, sf, known: DataFrame | None = None) -> DataFrame:
    """edges, of all kinds of relations in turn by their counts; written once, as a query looks at them more than once."""
    own = edges(spark, sf, known)
    kinds = F.array(*[F.lit(r) for r in RELATIONS])
    return saved(own.withColumn("relation_type", F.element_at(kinds, (F.col("co_activation_count") % len(RELATIONS) + 1).cast("int"))), "edges")


TYPED = f"typed AS (SELECT * REPLACE ({list(RELATIONS)}[co_activation_count % {len(RELATIONS)} + 1] AS relation_type) FROM edges)"
STEPS = """steps AS (SELECT source_tag, target_tag, memory_id, session_id, ts, greatest((3 + memory_id % 7) / 10.0::DOUBLE, 0.1) AS s,
  row_number() OVER w AS k, session_id = lag(session_id) OVER w AS same FROM pairs WINDOW w AS (PARTITION BY source_tag, target_tag ORDER BY ts, memory_id)),
edges AS (SELECT source_tag, target_tag, 'CO_OCCUR' AS relation_type,
  least(1.0, 1 - product(1 - CASE WHEN k = 1 THEN 0.05 * s ELSE 0.05 * s * least(k / 10.0::DOUBLE, 2.0) * CASE WHEN coalesce(same, false) THEN 1 + 0.5 * least(k / 5.0::DOUBLE, 1.0) ELSE 1.0 END END)) AS hebbian_weight,
  count(*) AS co_activation_count, min(ts) AS first_at, max(ts) AS last_at, arg_max(session_id, (ts, memory_id)) AS last_session_id, list(memory_id ORDER BY k) FILTER (k <= 3) AS contexts
  FROM steps GROUP BY source_tag, target_tag)"""
EDGES = f"{BASKETS},\n{STEPS}"


def tags(spark, sf) -> DataFrame:
    """tag_id, name, strengths and activity of the brands."""
    p = read(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("tag_id"))
    return p.select(
        "tag_id", "name", F.least(F.lit(1.0), F.col("n") / 1000.0).alias("storage_strength"), (0.04 + (F.col("n") % 10) / 20.0).alias("retrieval_strength"),
        (F.col("n") % 4).alias("total_activations"), (F.col("n") % 5).cast("int").alias("cooldown_days"), F.when(F.col("n") % 3 == 0, F.lit("1995-01-01").cast("timestamp")).alias("last_activated_at"), (F.col("n") % 11 == 0).alias("is_dormant"),
    )


TAGS = """tags AS (SELECT tag_id, name, least(1.0, n / 1000.0::DOUBLE) AS storage_strength, 0.04::DOUBLE + (n % 10) / 20.0::DOUBLE AS retrieval_strength,
  n % 4 AS total_activations, CAST(n % 5 AS INT) AS cooldown_days, CASE WHEN n % 3 = 0 THEN TIMESTAMP '1995-01-01' END AS last_activated_at, n % 11 = 0 AS is_dormant
  FROM (SELECT p_brand AS name, count(*) AS n, min(p_partkey) AS tag_id FROM part GROUP BY p_brand))"""


def tasks(spark, sf) -> DataFrame:
    """Orders as tasks: id, title, priority, status, due, created_at, space_id."""
    o = read(spark, sf, "orders")
    rank = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), (F.col("o_orderkey") % 997).cast("string")).alias("title"),
        F.when(rank.isin("1", "2"), "high").when(rank == "3", "medium").otherwise("low").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "doing").otherwise("todo").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("o_orderdate")).alias("due"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") - (F.col("o_orderkey") % 20) * 86400).alias("created_at"), (F.col("o_custkey") % 25).alias("space_id"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS id, 'Order ' || (o_orderkey % 997)::VARCHAR AS title,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'high' WHEN left(o_orderpriority, 1) = '3' THEN 'medium' ELSE 'low' END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'doing' ELSE 'todo' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS due, o_orderdate - to_days(CAST(o_orderkey % 20 AS INT)) AS created_at, o_custkey % 25 AS space_id FROM orders)"""


def vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def near_vectors(spark, sf) -> DataFrame:
    """Every vector and two damped ones of it: without its first component, and without its first twelve."""
    v = vectors(spark, sf).select("id", "vec", (F.col("id") % 23 == 0).alias("is_superseded"))
    damped = lambda n: F.concat(F.array_repeat(F.lit(0.0).cast("float"), n), F.slice("vec", n + 1, F.size("vec")))
    copies = [v.select((F.col("id") + 1_000_000 * k).alias("id"), damped(n).alias("vec"), "is_superseded") for k, n in ((1, 1), (2, 12))]
    return v.union(copies[0]).union(copies[1])


NEAR = """near AS (SELECT vec_id + 1000000 * k AS id, CASE k WHEN 0 THEN embedding WHEN 1 THEN list_concat([0.0::FLOAT], embedding[2:]) ELSE list_concat([0.0::FLOAT for x in range(12)], embedding[13:]) END AS vec
  FROM embeddings, range(3) AS t(k) WHERE vec_id % 23 <> 0)"""


def remembered(spark, sf) -> DataFrame:
    """memories with their vector, where there is one, and their tags in order."""
    m, k = memories(spark, sf), F.col("id")
    tags = F.array_compact(F.array(F.col("session_id"), F.concat(F.lit("type "), F.col("memory_type")), F.concat(F.lit("topic "), (k % 9).cast("string"))))
    return m.join(vectors(spark, sf).select("id", "vec"), "id", "left").withColumn("tags", tags)


REMEMBERED = f"""{MEMORIES}, rem AS (SELECT mem.*, embedding AS vec, list_filter([session_id, 'type ' || memory_type, 'topic ' || (id % 9)::VARCHAR], lambda x: x IS NOT NULL) AS tags FROM mem LEFT JOIN embeddings ON vec_id = id)"""
