"""Sessions of wishes: the batch form, and a stream that gives each session once it is over, the same rows for any order of arrival.

Messages are ``(session_id string, ts timestamp, wish string, value string)``. A gap above ``ttl_s`` seconds begins a new
session. Of each wish the last value stays (of equal times the greatest, null least); the wish ``reset`` takes away what was
said up to its time. A message without a wish only keeps its session alive. Rows without session_id or ts are left out,
a repeated row is a turn of its own, further columns are not read, and no messages give no sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelmatch import config as C
from labelmatch.streaming.sessions import session_numbers

RESET = "reset"
NEVER = -(2**63)
SESSION = "session_id string, first long, last long, turns long, wishes array<struct<wish:string,value:string>>"
ENTRY = "session_id string, first long, last long, turns long, reset long, wish string, at long, value string"


def _known(messages: DataFrame) -> DataFrame:
    return messages.where("session_id is not null and ts is not null").select("session_id", "ts", F.unix_micros("ts").alias("at"), "wish", "value")


def wish_entries(messages: DataFrame, ttl_s: int = C.SESSION_TTL_S) -> DataFrame:
    """``(session_id, first, last, turns, reset, wish, at, value)``: a row for each wish that stands at the end of its session, one with a null wish where none does; times in microseconds.

    No session is gathered: of each wish and session one row is left by partial aggregation before sessions are put together.
    """
    held = session_numbers(_known(messages), "session_id", "ts", ttl_s)
    by_wish = held.groupBy("session_id", "session", "wish").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("turns"), F.max(F.struct("at", "value")).alias("said"))
    whole = by_wish.groupBy("session_id", "session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("turns").alias("turns"), F.max(F.when(F.col("wish") == RESET, F.col("last"))).alias("reset"))
    wishes = by_wish.where(F.col("wish").isNotNull() & (F.col("wish") != RESET)).select("session_id", "session", "wish", "said.at", "said.value")
    standing = whole.select("session_id", "session", "reset").join(wishes, ["session_id", "session"]).where("reset is null or at > reset").drop("reset")
    return whole.join(standing, ["session_id", "session"], "left").select("session_id", "first", "last", "turns", F.coalesce("reset", F.lit(NEVER)).alias("reset"), "wish", "at", "value")


def _as_times(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns({"first": F.timestamp_micros("first"), "last": F.timestamp_micros("last")})


def wish_sessions(messages: DataFrame, ttl_s: int = C.SESSION_TTL_S) -> DataFrame:
    """``(session_id, first, last, turns, wishes)``: each session with the wishes that stand at its end, by name."""
    stated = F.sort_array(F.collect_list(F.when(F.col("wish").isNotNull(), F.struct("wish", "value")))).alias("wishes")  # distinct wishes only
    return _as_times(wish_entries(messages, ttl_s).groupBy("session_id", "first", "last", "turns").agg(stated))


class WishSessions(StatefulProcessor):
    """The sessions of an id that are not over, each as its ends, its last reset and its wishes: its turns are not held.

    What two messages, or two sessions that a late message joins, leave is a maximum by time, so their order is of no account.
    """

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getMapState("ends", "first long", "last long, turns long, reset long")
        self.wishes = handle.getMapState("wishes", "first long, wish string", "at long, value string")

    def _load(self) -> list[dict]:
        found = {}
        if self.ends.exists():
            found = {first: {"first": first, "last": last, "turns": turns, "reset": reset, "wishes": {}} for (first,), (last, turns, reset) in self.ends.iterator()}
        if self.wishes.exists():
            for (first, wish), (at, value) in self.wishes.iterator():
                found[first]["wishes"][wish] = (at, value)
        return list(found.values())

    def _store(self, before: list[dict], after: list[dict]) -> None:
        """Write what has changed; a timer for each session just after its last moment."""
        kept = {s["first"]: s for s in after}
        for old in before:
            new = kept.get(old["first"])
            if new is None or new["last"] != old["last"]:
                self.handle.deleteTimer(self._over(old))
            for wish in old["wishes"].keys() - (new["wishes"].keys() if new else ()):
                self.wishes.removeKey((old["first"], wish))
            if new is None:
                self.ends.removeKey((old["first"],))
        for new in after:
            self.ends.updateValue((new["first"],), (new["last"], new["turns"], new["reset"]))
            for wish, said in new["wishes"].items():
                self.wishes.updateValue((new["first"], wish), said)
        for new in after:  # after all deletions: two sessions may end at one moment
            self.handle.registerTimer(self._over(new))

    def _over(self, session: dict) -> int:
        return (session["last"] + self.ttl) // 1000 + 1

    @staticmethod
    def _joined(a: dict, b: dict) -> dict:
        reset, wishes = max(a["reset"], b["reset"]), dict(a["wishes"])
        for wish, said in b["wishes"].items():
            wishes[wish] = max(wishes.get(wish, said), said, key=lambda s: (s[0], s[1] is not None, s[1] or ""))
        return {"first": min(a["first"], b["first"]), "last": max(a["last"], b["last"]), "turns": a["turns"] + b["turns"], "reset": reset, "wishes": {w: s for w, s in wishes.items() if s[0] > reset}}

    def _merged(self, sessions: list[dict]) -> list[dict]:
        out = []
        for session in sorted(sessions, key=lambda s: s["first"]):
            if out and session["first"] - out[-1]["last"] <= self.ttl:
                out[-1] = self._joined(out[-1], session)
            else:
                out.append(session)
        return out

    def _pieces(self, rows: pd.DataFrame) -> list[dict]:
        """The sessions of a batch of rows by themselves."""
        rows = rows.sort_values("at", kind="stable")
        number = (rows["at"].diff() > self.ttl).cumsum()
        out = []
        for _, part in rows.groupby(number):
            resets = part.loc[part["wish"] == RESET, "at"]
            reset = int(resets.max()) if len(resets) else NEVER
            said = part[part["wish"].notna() & (part["wish"] != RESET) & (part["at"] > reset)]
            last = said.assign(some=said["value"].notna(), text=said["value"].fillna("")).sort_values(["at", "some", "text"], kind="stable").groupby("wish").tail(1)
            wishes = {r.wish: (int(r.at), r.text if r.some else None) for r in last.itertuples(index=False)}
            out.append({"first": int(part["at"].iloc[0]), "last": int(part["at"].iloc[-1]), "turns": len(part), "reset": reset, "wishes": wishes})
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._load()
        after = [dict(s) for s in before]
        for part in rows:
            after = self._merged([*after, *self._pieces(part)])
        self._store(before, after)
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        before, given = self._load(), {}
        for r in initialState.itertuples(index=False):
            session = given.setdefault(int(r.first), {"first": int(r.first), "last": int(r.last), "turns": int(r.turns), "reset": int(r.reset), "wishes": {}})
            if pd.notna(r.wish):
                session["wishes"][r.wish] = (int(r.at), r.value if pd.notna(r.value) else None)
        self._store(before, self._merged([*before, *given.values()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        over = [s for s in before if self._over(s) <= now]
        for s in over:
            self.ends.removeKey((s["first"],))
            for wish in s["wishes"]:
                self.wishes.removeKey((s["first"], wish))
        for s in over:
            stated = [{"wish": w, "value": v} for w, (_, v) in sorted(s["wishes"].items())]
            yield pd.DataFrame({"session_id": [key[0]], "first": [s["first"]], "last": [s["last"]], "turns": [s["turns"]], "wishes": [stated]})

    def close(self) -> None:
        pass


def stream_wish_sessions(messages: DataFrame, delay: str = "10 minutes", ttl_s: int = C.SESSION_TTL_S, known: DataFrame | None = None) -> DataFrame:
    """The rows of ``wish_sessions`` for a stream of messages, in append mode: each when no message that arrives within ``delay`` can reach it.

    ``known`` is what the stream starts from, ``wish_entries`` of the messages before it. State is held by the RocksDB provider, which the session must name in
    ``spark.sql.streaming.stateStore.providerClass``.
    """
    initial = None if known is None else known.groupBy("session_id")
    rows = _known(messages.withWatermark("ts", delay))
    return _as_times(rows.groupBy("session_id").transformWithStateInPandas(WishSessions(ttl_s), SESSION, "Append", "EventTime", initialState=initial))
