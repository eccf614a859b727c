"""Chat formatting with minimum-cost role repair.

A conversation is legal if it has at most one system turn, which comes first, then user and assistant turns by turns,
beginning with the user and ending with the assistant.  Dynamic programming over that automaton chooses, for the least
total cost, which turns keep their role, merge into the turn before or take another role, and where empty turns
come in; then the repaired sequence is rendered.

A conversation may hold any number of turns.  Turns are sorted over the whole table by conversation and turn and cut
into segments of bounded size; a segment is a small table of least costs from state to state, such tables are put together for
the few conversations that reach over a border, and every segment is then solved between its two states.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.llm._common import require, saved, table

#: Costs of a repair: another role for a turn, a role for a turn that has none that is known, a merge, an empty turn.
RELABEL, NAME, MERGE, INSERT = 3, 1, 1, 2
#: Turns of a segment, about.
SEGMENT = 10_000
ROLES = ("system", "user", "assistant")
#: Other names of roles, which cost nothing.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40
#: (state, role) -> (next state, cost, inserted roles, merged), the cheapest first.
MOVES: dict[tuple[int, str], list[tuple[int, int, tuple[str, ...], bool]]] = {
    (START, "system"): [(SYSTEM, 0, (), False)],
    (SYSTEM, "system"): [(SYSTEM, MERGE, (), True)],
    (START, "user"): [(USER, 0, (), False)],
    (SYSTEM, "user"): [(USER, 0, (), False)],
    (USER, "user"): [(USER, MERGE, (), True), (USER, INSERT, ("assistant",), False)],
    (ASSISTANT, "user"): [(USER, 0, (), False)],
    (START, "assistant"): [(ASSISTANT, INSERT, ("user",), False)],
    (SYSTEM, "assistant"): [(ASSISTANT, INSERT, ("user",), False)],
    (USER, "assistant"): [(ASSISTANT, 0, (), False)],
    (ASSISTANT, "assistant"): [(ASSISTANT, MERGE, (), True), (ASSISTANT, INSERT, ("user",), False)],
}
#: Empty turns that end a conversation legally, and their cost.
ENDINGS = {SYSTEM: (("user", "assistant"), 2 * INSERT), USER: (("assistant",), INSERT), ASSISTANT: ((), 0)}
END_COST = [INF, *(ENDINGS[s][1] for s in (SYSTEM, USER, ASSISTANT))]


def known_role(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def choices(role: str | None) -> list[list[tuple[int, int, str, tuple[str, ...], bool]]]:
    """For each state: (cost, next state, role, inserted, merged) of every legal way to place a turn, in a fixed order."""
    own = known_role(role)
    label = {q: 0 if q == own else NAME if own is None else RELABEL for q in ROLES}
    out = [[(label[q] + cost, nxt, q, put, merged) for q in ROLES for nxt, cost, put, merged in MOVES.get((s, q), [])] for s in range(4)]
    return [sorted(x, key=lambda c: c[0]) for x in out]


_CHOICES = {role: choices(role) for role in (*ROLES, None)}
_STEP = {role: np.array([[min([c for c, nxt, *_ in own[s] if nxt == t], default=INF) for t in range(4)] for s in range(4)], np.int64) for role, own in _CHOICES.items()}


def least_costs(roles: list[str | None]) -> np.ndarray:
    """Least cost of placing a run of turns, from each state to each state."""
    out = np.where(np.eye(4, dtype=bool), 0, INF)
    for role in roles:
        out = (out[:, :, None] + _STEP[known_role(role)][None]).min(1)
    return np.minimum(out, INF)


def solve(roles: list[str | None], entry: int, final: list[int]) -> list[tuple[str, tuple[str, ...], bool]]:
    """(role, inserted, merged) of each turn on a path of least cost from entry, with `final` the cost of each end state."""
    after = [list(final)]
    for role in reversed(roles):
        own, ahead = _CHOICES[known_role(role)], after[-1]
        after.append([min((c + ahead[nxt] for c, nxt, *_ in own[s]), default=INF) for s in range(4)])
    after.reverse()
    out, state = [], entry
    for k, role in enumerate(roles):
        cost, nxt, q, put, merged = min(_CHOICES[known_role(role)][state], key=lambda c: c[0] + after[k + 1][c[1]])
        out.append((q, put, merged))
        state = nxt
    return out


_MARK, _ESCAPED = re.compile(r"<(\\*)\|im_(start|end)\|>"), re.compile(r"<\\(\\*)\|im_(start|end)\|>")


def escaped(text: str | None) -> str:
    """A text with the marks in it made harmless by a backslash behind <, one more where backslashes stand there already."""
    return _MARK.sub(r"<\\\1|im_\2|>", text or "")


def unescaped(text: str) -> str:
    """The text that was escaped."""
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def block(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


_PIECE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("new_role", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("cost", T.LongType()),
        T.StructField("piece", T.StringType()),
        T.StructField("place", T.LongType()),
    ]
)
_TABLE = T.StructType([T.StructField("seg", T.IntegerType()), T.StructField("conv_id", T.LongType()), T.StructField("least", T.ArrayType(T.LongType()))])
_PLAN = T.StructType([*[T.StructField(c, T.LongType() if c == "conv_id" else T.IntegerType()) for c in ("seg", "conv_id", "entry", "exit")], T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])


def _runs(ids: list) -> list[tuple[int, int]]:
    """Begin and end of each run of equal ids."""
    cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def segment_costs(part: pa.Table) -> pa.Table:
    """The least-cost tables of the first and the last conversation of a segment, which may reach over its borders."""
    part = part.sort_by("pos")
    ids, roles = part["conv_id"].to_pylist(), part["role"].to_pylist()
    runs = _runs(ids)
    rows = [(part["seg"][0].as_py(), ids[a], least_costs(roles[a:b]).ravel().tolist()) for a, b in {runs[0], runs[-1]}]
    return _table(rows, _TABLE)


def join_segments(part: pa.Table) -> pa.Table:
    """For one conversation in many segments: the states between which each segment is to be solved, and which are its first and last."""
    part = part.sort_by("seg")
    tables = [np.array(x, np.int64).reshape(4, 4) for x in part["least"].to_pylist()]
    after = [np.array(END_COST, np.int64)]
    for t in reversed(tables):
        after.append(np.minimum((t + after[-1][None]).min(1), INF))
    after.reverse()
    state, rows = START, []
    for k, (seg, conv) in enumerate(zip(part["seg"].to_pylist(), part["conv_id"].to_pylist(), strict=True)):
        nxt = int((tables[k][state] + after[k + 1]).argmin())
        rows.append((seg, conv, state, nxt, k == 0, k == len(tables) - 1))
        state = nxt
    return _table(rows, _PLAN)


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def render_segment(turns: pa.Table, plan: pa.Table) -> pa.Table:
    """Every turn of a segment as its piece of the rendered conversation."""
    if not turns.num_rows:
        return _table([], _PIECE)
    turns = turns.sort_by("pos")
    ids, numbers, roles, texts, places = (turns[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "pos"))
    planned = {r["conv_id"]: r for r in plan.to_pylist()}
    rows: list[tuple] = []
    for a, b in _runs(ids):
        own = planned.get(ids[a], {"entry": START, "exit": None, "first": True, "last": True})
        entry = own["entry"]
        final = END_COST if own["exit"] is None else [0 if s == own["exit"] else INF for s in range(4)]
        steps = solve(roles[a:b], entry, final)
        for k, (role, put, merged) in enumerate(steps, a):
            piece = "" if k == a and own["first"] else "\n" if merged else "<|im_end|>\n"
            piece += "".join(block(q, "") for q in put)
            piece += ("" if merged else f"<|im_start|>{role}\n") + escaped(texts[k])
            cost = INSERT * len(put) + MERGE * merged + (0 if role == known_role(roles[k]) else NAME if known_role(roles[k]) is None else RELABEL)
            action = "+".join([*(["insert"] * bool(put)), "merge" if merged else "keep" if role == known_role(roles[k]) else "relabel", *(["relabel"] * (merged and role != known_role(roles[k])))])
            if k == b - 1 and own["last"]:
                ending, extra = ENDINGS[{"system": SYSTEM, "user": USER, "assistant": ASSISTANT}[role]]
                piece += "<|im_end|>\n" + "".join(block(q, "") for q in ending)
                cost, action = cost + extra, action + "+close" * bool(ending)
            rows.append((ids[k], numbers[k], roles[k], role, action, cost, piece, places[k]))
    return _table(rows, _PIECE)


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """The turns with seg, a run of about `segment` of them in the order of the whole table, and pos, their place in it."""
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parts = max(1, -(-own.count() // segment))
    order = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
    keyed = own.withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("pos"))


def format_turns(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Repair and render conversations (conv_id, turn, role, text); one row for each turn.

    new_role is the role that the turn is rendered with, action what was done (keep, relabel, merge, insert for empty turns
    before it, close for empty turns behind the last), cost its part of the conversation's least total, and piece its part
    of the rendered text: the pieces of a conversation put together by place, their order in the whole table, are the
    conversation.  Marks inside texts are escaped, so that no text can begin or end a turn; `unescaped` gives them back.

    Turns are ordered by number, then role, then the first 64 characters of the text, nulls first, then a hash of the text and the
    place in the table; so repeated rows, which are turns of their own, can be parted as well.  A null text is
    empty; a null or unknown role may become any; turns with a null conv_id are one conversation.  Rows of one conversation
    may be any number: no task holds more than about `segment` turns.  Other columns are left out; an empty table gives no rows.
    """
    require(turns, "conv_id", "turn", "role", "text")
    placed = saved(segments(turns, segment), "turns")
    wide = placed.groupBy("conv_id").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).where("a < b").select(F.col("conv_id").alias("_c"))
    tables = placed.select("seg", "pos", "conv_id", "role").groupBy("seg").applyInArrow(segment_costs, _TABLE)
    plan = tables.join(wide, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").groupBy("conv_id").applyInArrow(join_segments, _PLAN)
    return placed.groupBy("seg").cogroup(plan.groupBy("seg")).applyInArrow(render_segment, _PIECE)


def conversations(pieces: DataFrame) -> DataFrame:
    """conv_id, text and cost of each conversation, for conversations that fit a row."""
    one = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"), F.sum("cost").alias("cost"))
    return one.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), "cost")


def op10_chat_repair(spark, sf_dir: str) -> DataFrame:
    return format_turns(table(spark, sf_dir, "conversations")).drop("place")


QUERIES = {"op10_chat_repair": op10_chat_repair}
ORACLES: dict[str, str] = {}
