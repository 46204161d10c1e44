"""Sessions, feedback and imports as streams, each with the batch form that gives the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelmatch import config as C
from labelmatch.operators.requests import NOTES


def session_numbers(messages: DataFrame, user: str, ts: str, ttl_s: int = C.SESSION_TTL_S) -> DataFrame:
    """``messages`` with ``session``, 0, 1, ... for each user: a gap above ``ttl_s`` seconds begins a new one."""
    order = Window.partitionBy(user).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    return messages.withColumn("session", F.sum(F.when(gap > ttl_s * 1_000_000, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def feedback_exclusions(ratings: DataFrame, session: str = "session", item: str = "wine") -> DataFrame:
    """``(session, excluded)``: what was disliked, sorted; the same for a batch and, in complete or update mode, for a stream."""
    return ratings.where(~F.col("liked")).groupBy(session).agg(F.sort_array(F.collect_set(item)).alias("excluded"))


def _kept(messages: DataFrame, step: Callable[[dict, object], dict], value: list[str], to: str, ttl_s: int) -> DataFrame:
    """``(session_id, to)``: each session's state as JSON after the messages of a batch in order of ``ts``, forgotten ``ttl_s`` after the last of them."""
    import json

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for row in rows[value].itertuples(index=False):
            held = step(held, row)
        state.update((json.dumps(held, sort_keys=True, ensure_ascii=False),))
        state.setTimeoutDuration(ttl_s * 1000)
        yield pd.DataFrame({"session_id": [key[0]], to: [state.get[0]]})

    return messages.groupBy("session_id").applyInPandasWithState(run, f"session_id string, {to} string", f"{to} string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_wishes(messages: DataFrame, ttl_s: int = C.SESSION_TTL_S) -> DataFrame:
    """A stream of ``messages(session_id, ts, wish, value)`` -> each session's latest wishes as JSON, forgotten ``ttl_s`` after the last message.

    A wish ``reset`` empties the session.
    """
    return _kept(messages, lambda held, row: {} if row.wish == "reset" else held | {row.wish: row.value}, ["wish", "value"], "wishes", ttl_s)


def merged_context(held: dict, new: dict) -> dict:
    """The merge of ``merge_contexts`` for one more turn: sets are joined, notes follow each other, of scalars and the dish what is stated stays (not false, not novice)."""
    out = dict(held)
    for name, value in new.items():
        if name == NOTES:
            out[name] = list(dict.fromkeys([*out.get(name, []), *(value or [])]))
        elif isinstance(value, list):
            out[name] = sorted({*(out.get(name) or []), *value})
        elif value not in (None, False, "") and not (name == "experience" and value == "novice"):
            out[name] = value
    return out


def session_contexts(messages: DataFrame, ttl_s: int = C.SESSION_TTL_S) -> DataFrame:
    """A stream of ``messages(session_id, ts, context)``, the context of ``parse_context`` as JSON -> each session's merged context as JSON.

    The state of a session is one merged context, not its turns; a null context empties it. It is forgotten ``ttl_s`` after the last message.
    """
    import json

    return _kept(messages, lambda held, row: merged_context(held, json.loads(row.context)) if isinstance(row.context, str) else {}, ["context"], "context", ttl_s)


def incremental_import(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of what has arrived goes through ``step`` once; ends when all is done."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
