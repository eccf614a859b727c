"""Column functions over conversation text: normalisation, fingerprints, titles, gates and flags.

All are built-in expressions, so they stay inside generated code and are pushed where Catalyst wants them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}]+"
#: All characters that BLANK matches.
BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Boilerplate, actions and hints that texts are searched for.
BOILERPLATE = [
    r"提取方式[:：]\s*\w+",
    r"冲突[:：]\s*\d+\s*条",
    r"ID[:：]\s*`?[0-9a-f\-]{8,}`?",
    r"状态[:：]\s*(doing|todo|done|进行中|已完成)",
]
ACTIONS = [
    ("todo_add", r"(添加|创建|新增|加一条).{0,12}(测试)?待办|todo_add"),
    ("todo_close", r"(完成|关闭|办结).{0,12}待办|todo_close"),
    ("todo_update", r"(更新|修改|编辑).{0,12}待办|todo_update"),
    ("space_create", r"(创建|新增).{0,12}(space|空间)|space_create"),
    ("space_activate", r"(激活|切换).{0,12}(space|空间)|space_activate"),
    ("memory_govern", r"(标记|置顶|删除|恢复).{0,12}记忆|memory_govern"),
]
QUOTED = r"[“\"]([^”\"]{3,80})[”\"]"
SPACE_NAME = r"(?:空间|space)[：: ]*([\w\u4e00-\u9fff\- ]{2,60})"
OPERATIONAL = r"(测试|创建成功|添加成功|已添加|拉取完成|构建通过|验证通过|npm run build|test\.bat|git pull|git push)"
PERSONA = r"(偏好|习惯|价值观|反感|喜欢|倾向|决定|决策|沟通风格|审美|工作方式|适合|情绪|敏感|底线|认为)"
MARKDOWN = r"[`*_#>\-]+"
PUNCTUATION = r"[，。！？；：、,.!?;:()（）\[\]【】\"'“”‘’]+"
UUID = r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b"
SHORT_ID = r"`?[0-9a-f]{8}\.\.\.?`?"
TODO_NOISE = r"[\s\t\r\n，。！？、；：,.!?;:（）()【】\[\]{}《》<>\"'“”‘’`~@#$%^&*_+=|\\/-]+"
# Starts and fragments of texts that no user wrote, and tokens that mark polluted or passing memories.
BLOCKED_STARTS = (
    "<system-reminder", "<command-name", "<local-command", "<local-command-stdout", "<local-command-stderr", "<tool-call", "<tool-result", "[system",
    "[hana_reminder", "[use skill:", "[sessionfile]", "<environment_context", "<recommended_plugins", "the following is the codex agent history", "system:",
)
BLOCKED_FRAGMENTS = ('data-role="command-caveat"', 'data-role="user-context"', "</local-command-stdout>", "</local-command-stderr>")
POLLUTION = (
    "<system-reminder", "<command-name>", "<local-command-", "[hana_reminder", "[use skill:", "[sessionfile]", "c:\\users\\pc>", "tool_call", "tool_result",
    "command-caveat", "user-context", "secret key", "api key", "sk-", "successfully updated", "<environment_context", "<recommended_plugins",
    "the following is the codex agent history",
)
TEMPORARY = ("帮我安装", "打开", "访问", "检查一下", "跑一下", "修一下", "这个路径", "这个文件", "当前这个项目")
# The weights of the four scores, and the texts that explain why a memory takes part.
WEIGHTS = (0.30, 0.30, 0.25, 0.15)
EXPLAINED = {
    "tags": "它和这些关键词相关：", "judgement": "它记录的是判断、偏好或推理，比普通流水信息更适合作为参考", "pinned": "你已经把它标为重要，所以系统会更优先保留它", "active": "它当前处于可引用状态",
    "expired": "它已被标记为过期，仍可参考，但会被明显降权", "wrong": "它已被标记为错误，默认不会再参与召回", "muted": "它已被设置为不再引用，默认不会参与召回", "deleted": "它已被软删除，默认不会参与召回",
    "raised": "你提高过它的权重，因此它会更容易被想起", "lowered": "你降低过它的权重，因此它只会谨慎参与参考", "plain": "它目前没有特殊治理标记，按普通长期记忆处理",
}
GREETINGS = ("嗯", "好的", "好", "ok", "OK", "行", "可以", "对", "是的", "谢谢", "不客气", "再见", "拜拜", "bye", "hi", "hello", "你好", "收到", "明白", "知道了", "了解")


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def squeeze(c: Column) -> Column:
    """Runs of blanks become one; ends are trimmed."""
    return F.trim(F.regexp_replace(c, BLANK, " "))


def iso_dates(c: Column) -> Column:
    """2026年7月1日, 2026/7/1, 2026.07.01 and the like become 2026-07-01 where that day exists; others stay as they are."""
    one = "0[1-9]|[1-9](?![0-9])"  # a day has two digits where two are there, as the reading is greedy
    day31, day30, day29, day28 = f"3[01]|[12][0-9]|{one}", f"30|[12][0-9]|{one}", f"[12][0-9]|{one}", f"1[0-9]|2[0-8]|{one}"
    leap = "20(?:[02468][048]|[13579][26])"
    rules = [
        ("20[0-9]{2}", "1[02]|0?[13578]", day31),
        ("20[0-9]{2}", "11|0?[469]", day30),
        (leap, "0?2", day29),
        ("20[0-9]{2}", "0?2", day28),
    ]
    for year, month, day in rules:
        c = F.regexp_replace(c, f"({year})[年/\\-.]({month})[月/\\-.]({day})日?", "$1-\u0001$2-\u0001$3\u0002")
    c = F.regexp_replace(c, "\u0001([0-9])(?![0-9])", "0$1")
    return F.regexp_replace(c, "[\u0001\u0002]", "")


def normalize_conversation(c: Column | str) -> Column:
    """Text for comparing conversations: no mood blocks, ISO dates, ids as <id>, no boilerplate or punctuation, lower case.

    Most texts hold none of the rarer things, so each is looked for by a plain search before its pattern runs.
    """
    swap = lambda pattern, to: lambda s: F.regexp_replace(s, pattern, to)
    steps = [
        (("<",), swap(r"(?is)<mood>.*?</mood>", " ")),
        (("20",), iso_dates),
        (("-",), swap("(?i)" + UUID, "<id>")),
        (("..",), swap("(?i)" + SHORT_ID, "<id>")),
        *((marks, swap("(?iU)" + pattern, " ")) for marks, pattern in zip((("提取方式",), ("冲突",), (":", "："), ("状态",)), BOILERPLATE, strict=True)),
    ]
    s = text_of(c)
    for marks, step in steps:
        s = let(s, _guarded(marks, step))
    s = F.regexp_replace(F.replace(s, F.lit("\r"), F.lit("\n")), MARKDOWN, " ")
    return F.lower(squeeze(F.regexp_replace(s, PUNCTUATION, " ")))


def _guarded(marks: tuple[str, ...], step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks]), step(x)).otherwise(x)


def stable_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def compact_key(c: Column | str, limit: int = 120) -> Column:
    return let(normalize_conversation(c), lambda norm: F.when(norm == "", "").otherwise(F.sha2(F.substring(norm, 1, limit), 256)))


def joined_text(text: Column | str, title: Column | str, summary: Column | str) -> Column:
    return F.concat_ws("\n", text_of(title), text_of(summary), text_of(text))


def action_of(joined: Column) -> Column:
    """The first action that a text names, or ""."""
    return reduce(lambda rest, a: F.when(joined.rlike("(?i)" + a[1]), a[0]).otherwise(rest), reversed(ACTIONS), F.lit(""))


def action_keys(text: Column | str, title: Column | str | None = None, summary: Column | str | None = None, by_text: bool = False) -> Column:
    """Struct of action_key, entity_key and fact_key: what was done to which thing, as short hashes.

    The first quotation of title, summary and text names a task; `by_text`: that of the text, if it has one, as titles and summaries may quote what stands further on in it.
    """
    joined = joined_text(text, F.lit("") if title is None else title, F.lit("") if summary is None else summary)
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)

    def entity(x: Column) -> Column:
        joined, action = x["joined"], x["action"]
        uuid = F.lower(F.regexp_extract(joined, "(?i)" + UUID, 0))
        quoted = F.regexp_extract(joined, QUOTED, 1)
        if by_text:
            quoted = F.coalesce(F.nullif(F.regexp_extract(text_of(text), QUOTED, 1), F.lit("")), quoted)
        named = F.regexp_extract(joined, "(?iU)" + SPACE_NAME, 1)
        name = F.when(action.startswith("todo"), quoted).when(action.startswith("space"), named).otherwise("")
        own = F.when(name != "", normalize_conversation(name)).otherwise(F.substring(x["norm"], 1, 80))
        return F.when(uuid != "", uuid).when(action.startswith("todo") | action.startswith("space"), own).otherwise("")

    def keys(x: Column) -> Column:
        action, e = x["action"], x["entity"]
        action_key = F.when((action != "") & (e != ""), F.concat(action, F.lit(":"), short(e))).otherwise("")
        fact_key = F.when(action != "", F.concat(action, F.lit(":"), short(F.substring(x["norm"], 1, 160)))).otherwise(short(F.substring(x["norm"], 1, 180)))
        return F.struct(action_key.alias("action_key"), e.alias("entity_key"), fact_key.alias("fact_key"))

    read = let(joined, lambda t: F.struct(t.alias("joined"), normalize_conversation(t).alias("norm"), action_of(t).alias("action")))
    return let(let(read, lambda x: F.struct(x["norm"].alias("norm"), x["action"].alias("action"), entity(x).alias("entity"))), keys)


def title_summary_key(title: Column | str, summary: Column | str) -> Column:
    return F.concat(F.lit("ts:"), F.substring(F.sha2(normalize_conversation(F.concat_ws("\n", text_of(title), text_of(summary))), 256), 1, 16))


def is_structured_operational(joined: Column) -> Column:
    return (action_keys(joined)["action_key"] != "") | joined.rlike("(?i)" + OPERATIONAL)


def is_persona_relevant(text: Column | str, title: Column | str, summary: Column | str, memory_type: Column, signal_level: Column) -> Column:
    joined, kind = joined_text(text, title, summary), F.upper(F.coalesce(memory_type, F.lit("")))
    return F.when(kind.isin("PREFERENCE", "DECISION", "REASONING"), True).when((kind == "EVENT") & (signal_level <= 0) & is_structured_operational(joined), False).otherwise(joined.rlike(PERSONA))


def trimmed(c: Column) -> Column:
    """No blanks at the ends; a text is only searched where its last character is one."""
    ended = lambda s: F.when(reduce(lambda a, b: a | b, [s.endswith(b) for b in BLANKS]), F.regexp_replace(s, BLANK + "$", "")).otherwise(s)
    return let(F.ltrim(c, F.lit(BLANKS)), ended)


def auto_title(c: Column | str) -> Column:
    """The first sentence by the first separator that is present, cut to 80 characters."""
    first = lambda s: F.when(F.contains(s, F.lit("。")), F.substring_index(s, "。", 1)).when(F.contains(s, F.lit("\n")), F.substring_index(s, "\n", 1)).when(F.contains(s, F.lit(". ")), F.substring_index(s, ". ", 1)).otherwise(s)
    return cut(let(trimmed(text_of(c)), first), 80, "...")


def cut(c: Column, n: int, mark: str) -> Column:
    return let(c, lambda x: F.concat(F.substring(x, 1, n), F.when(F.length(x) > n, mark).otherwise("")))


def compact_display_title(text: Column | str, fallback: Column | str, n: int = 36) -> Column:
    """Struct of title and title_source: the text without its speaker, or the fallback where nothing is left."""
    s = squeeze(text_of(text))
    for prefix in ("User:", "用户：", "用户:", "Human:"):
        s = F.when(s.startswith(prefix), F.trim(F.substring(s, len(prefix) + 1, 1_000_000_000))).otherwise(s)
    return F.struct(F.when(s != "", cut(s, n, "…")).otherwise(cut(text_of(fallback), n, "…")).alias("title"), F.when(s != "", "first_user_turn").otherwise("file_name").alias("title_source"))


def is_memory_subject_text(c: Column | str, least: int = 30) -> Column:
    """A text that a user wrote and that is long enough to be remembered."""
    blocked = lambda head: reduce(lambda a, b: a | b, [*(head.startswith(p) for p in BLOCKED_STARTS), *(head.contains(p) for p in BLOCKED_FRAGMENTS)])
    return let(squeeze(text_of(c)), lambda s: (F.length(s) >= least) & ~let(F.lower(F.substring(s, 1, 240)), blocked))


def title_key(c: Column | str) -> Column:
    """Letters and digits of a title in lower case, cut to 80."""
    return F.substring(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}]", ""), 1, 80)


def quality_flags(title: Column | str, summary: Column | str) -> Column:
    """pollution: and temporary: tokens that stand in a memory's title or summary."""
    hits = lambda s: F.array_compact(F.array(*[F.when(s.contains(t), f"{kind}:{t}") for kind, tokens in (("pollution", POLLUTION), ("temporary", TEMPORARY)) for t in tokens]))
    return let(F.lower(F.concat_ws("\n", text_of(title), text_of(summary))), hits)


def compact(c: Column | str, n: int) -> Column:
    """The squeezed text, cut to n characters; all of a text is only squeezed where its start does not leave so many."""
    whole = lambda s: lambda head: F.when(F.length(head) > n, F.concat(F.substring(head, 1, n), F.lit("..."))).otherwise(cut(squeeze(s), n, "..."))
    return let(text_of(c), lambda s: let(squeeze(F.substring(s, 1, 2 * n)), whole(s)))


def due_date(c: Column | str) -> Column:
    """Struct of value and ok: empty, or exactly YYYY-MM-DDTHH:MM and a time that exists."""
    s = F.trim(text_of(c))
    good = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$") & F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm")).isNotNull()
    return F.struct(F.when(good, s).otherwise("").alias("value"), (good | (s == "")).alias("ok"))


def todo_title(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text_of(c))), r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?", "<date>")
    return F.regexp_replace(s, TODO_NOISE, "")


def redact_home(c: Column | str, home: str) -> Column:
    """~ for the home folder at the start of a path, whatever its case."""
    s = text_of(c)
    return F.when(F.lower(s).startswith(home.lower()), F.concat(F.lit("~"), F.substring(s, len(home) + 1, 1_000_000_000))).otherwise(s)


def content_length(metadata: Column | str, content: Column | str) -> Column:
    meta = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.coalesce(F.get_json_object(meta, "$.content_length").try_cast("int"), F.length(F.col(content) if isinstance(content, str) else content), F.lit(0))


def embed_text(title: Column | str, summary: Column | str, raw: Column | str) -> Column:
    return F.concat_ws(" ", text_of(title), text_of(summary), F.substring(text_of(raw), 1, 500))


def value_gate(c: Column | str, scores: Column | None = None) -> Column:
    """Struct of total, verdict (write, gray or skip) and reason of the rules that decide whether a text is worth keeping.

    scores, where it is not null, is an array of four external scores, clipped to 1..5, which stand in for those of the length.
    """
    s = F.regexp_replace(text_of(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    n = F.length(s)
    reason = F.when(n < 30, "short").when(s.isin(*GREETINGS), "greeting").when(s.rlike("^https?://") & (n < 80), "url").when(s.startswith("toolCall") | s.startswith("toolResult") | s.startswith("thinking"), "process").otherwise("length")
    bands = [(500, (4, 3, 3, 3)), (200, (3, 2, 2, 2)), (100, (2, 2, 2, 2)), (-1, (2, 1, 1, 1))]
    score = lambda b: round(sum(w * x for w, x in zip(WEIGHTS, b, strict=True)), 2)
    total = reduce(lambda rest, b: F.when(n > b[0], score(b[1])).otherwise(rest), reversed(bands), F.lit(0.0))
    if scores is not None:
        given = reduce(lambda a, b: a + b, [w * F.least(F.greatest(F.coalesce(F.get(scores, F.lit(k)).cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(5.0)) for k, w in enumerate(WEIGHTS)])
        total = F.when(scores.isNull(), total).otherwise(F.round(given, 2))
        reason = F.when((reason == "length") & scores.isNotNull(), "scored").otherwise(reason)
    rated = reason.isin("length", "scored")
    total = F.when(rated, total).otherwise(0.0)
    verdict = F.when(~rated, "skip").when(total >= 3.0, "write").when(total >= 2.5, "gray").otherwise("skip")
    return F.struct(total.alias("total"), verdict.alias("verdict"), reason.alias("reason"))


def derived_fields(verdict: Column, total: Column, manual: Column) -> Column:
    """Struct of confidence and signal_level of a memory that is written."""
    return F.struct(F.when(verdict == "gray", 0.5).otherwise(0.85).alias("confidence"), F.when(manual, 2).when(total >= 4.0, 1).otherwise(0).alias("signal_level"))


def reasons(**tests: Column) -> Column:
    """The texts of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def explanation(tags: Column, memory_type: Column, pinned: Column, status: Column, user_weight: Column) -> Column:
    """Why a memory takes part or not, as an ordered list of texts; tags is an array of names, of which the first five are told."""
    state = F.coalesce(F.nullif(status, F.lit("")), F.lit("active"))
    takes_part, weight = ~state.isin("wrong", "muted", "deleted"), F.coalesce(user_weight, F.lit(1.0))
    own = reasons(**{
        "judgement": F.upper(F.coalesce(memory_type, F.lit(""))).isin("DECISION", "PREFERENCE", "REASONING"), "pinned": F.coalesce(pinned, F.lit(False)),
        **{s: state == s for s in ("active", "expired", "wrong", "muted", "deleted")}, "raised": weight > 1.05, "lowered": (weight < 0.95) & takes_part,
    })
    told = F.transform(own, lambda k: F.create_map(*[F.lit(x) for kv in EXPLAINED.items() for x in kv])[k])
    tagged = F.when(F.size(tags) > 0, F.array(F.concat(F.lit(EXPLAINED["tags"]), F.array_join(F.slice(tags, 1, 5), "、"))))
    out = F.concat(F.coalesce(tagged, F.array().cast("array<string>")), told)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(EXPLAINED["plain"])))
