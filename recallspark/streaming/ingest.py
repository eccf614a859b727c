"""Streams: inbox files and transcripts as they grow, gated so that nothing is taken in twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallspark.functions.text import normalize_conversation, value_gate
from recallspark.sources.readers import BRIDGE


def inbox(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """Every new file of an inbox once; the checkpoint of the query remembers which are done."""
    return spark.readStream.schema(BRIDGE).json(path).where(F.length(F.trim("conversation")) >= least)


def gated(stream: DataFrame, text: str = "conversation", at: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Inputs whose normalised text is new.  With an event time, state is dropped after the delay; else it is kept for good."""
    own = stream.withColumn("conversation_hash", F.sha2(normalize_conversation(text), 256)).withColumn("gate", value_gate(text)["verdict"]).where("gate <> 'skip'")
    if at is None:
        return own.dropDuplicates(["conversation_hash"])
    return own.withWatermark(at, delay).dropDuplicatesWithinWatermark(["conversation_hash"])


_SEEN = T.StructType([T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("newest", T.LongType())])


def watched(turns: DataFrame, window: int = 10, last: int = 2, least: int = 30, at: str | None = None, delay: str = "10 minutes", idle: float = 7 * 86_400) -> DataFrame:
    """session_id, turn_index, conversation: where a session gets an answer, its last pairs, as a stream of turns comes in.

    turns: session_id, turn_index, role, content.  The state of a session is its last `window` messages of users and assistants, so a question and its answer
    may come in different micro-batches.  Texts under `least` characters do not count; the i-th question of the window goes with the
    i-th answer, and the last `last` of these are the conversation.  turn_index is that of the newest message.  Within a
    micro-batch messages go by turn_index; what comes later is taken as newer unless its turn_index says otherwise.

    Where `at` names a timestamp of turns, state is bounded: a message later than `delay` behind the newest is dropped, and a session is forgotten when the watermark has
    passed its last message by `idle` seconds.  Without it the state of a session is kept for good.
    """
    session = turns.schema["session_id"]
    out = T.StructType([session, T.StructField("turn_index", T.LongType()), T.StructField("conversation", T.StringType())])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = 0
        kept = list(zip(*state.get[:3], strict=True)) if state.exists else []
        answered = False
        for frame in frames:  # lists, as most sessions have a few rows, for which calls on columns cost more than the rows
            texts = [x.strip() if isinstance(x, str) else "" for x in frame["content"].tolist()]
            roles = frame["role"].tolist()
            if at is not None:
                newest = max(newest, max(frame["_ms"].tolist(), default=0))
            answered |= any(role == "assistant" and len(text) >= least for role, text in zip(roles, texts, strict=True))
            kept += zip(map(int, frame["turn_index"].tolist()), roles, texts, strict=True)
            kept = sorted(kept, key=lambda x: x[0])[-window:]
        state.update((*map(list, zip(*kept, strict=True)), max(newest, state.get[3] if state.exists else 0)))
        if at is not None:
            state.setTimeoutTimestamp(max(state.get[3] + int(idle * 1000), state.getCurrentWatermarkMs() + 1))
        if answered:
            said = {who: [f"{who.capitalize()}: {text}" for _, role, text in kept if role == who and len(text) >= least] for who in ("user", "assistant")}
            pairs = ["\n".join(x for x in pair if x) for pair in zip_longest(said["user"], said["assistant"])]
            if pairs:
                yield pd.DataFrame({session.name: [key[0]], "turn_index": [kept[-1][0]], "conversation": ["\n".join(pairs[-last:])]})

    talk = turns.where(F.col("role").isin("user", "assistant"))
    if at is None:
        timeout, more = GroupStateTimeout.NoTimeout, []
    else:
        talk, timeout, more = talk.withWatermark(at, delay), GroupStateTimeout.EventTimeTimeout, [F.unix_millis(at).alias("_ms"), at]
    talk = talk.select("session_id", F.col("turn_index").cast("long"), "role", "content", *more)
    return talk.groupBy("session_id").applyInPandasWithState(step, out, _SEEN, "append", timeout)


def watch(turns: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, seconds: int = 5, **settings):
    """Follow a stream of turns and hand what `watched` gives to `write`, in each micro-batch."""
    return watched(turns, **settings).writeStream.foreachBatch(lambda df, _: write(df)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def due_jobs(last_runs: DataFrame, as_of: Column) -> DataFrame:
    """job, due: whether periodic work (job, last_run, every: seconds; hour: from when on in a day, may be null) is to run at a time.

    A job with an hour runs once a day from that hour on; others when `every` seconds have passed; what never ran is due.
    """
    passed = F.unix_micros(as_of) - F.unix_micros("last_run") >= F.col("every") * 1_000_000
    daily = (F.hour(as_of) >= F.col("hour")) & (F.col("last_run").isNull() | (F.to_date("last_run") < F.to_date(as_of)))
    return last_runs.select("job", F.when(F.col("hour").isNotNull(), daily).otherwise(F.col("last_run").isNull() | passed).alias("due"))


def run_once(stream: DataFrame, path: str, checkpoint: str):
    """Take in all that is new and stop: for work that is scheduled."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
