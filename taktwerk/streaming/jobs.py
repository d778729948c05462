"""The operators on streams: conversation state, search against a table, ingestion and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from taktwerk.operators import sessions
from taktwerk.operators.messages import Words, understand
from taktwerk.operators.quality import Rule, violations
from taktwerk.operators.search import matches
from taktwerk.sources.tables import scratch

#: Set this before a stateful stream starts; the default store does not hold such state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PAIR = sessions.PAIR


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in ``STATE_STORE``; the session's own setting comes back afterwards."""
    name, old = STATE_STORE[0], spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


class ConversationState(StatefulProcessor):
    """The filters in force of each conversation.

    Rows of a batch are put in order of their turn over all of its chunks before they count.  A turn that is not
    after the last one seen is passed on with ``late`` set and changes nothing.
    """

    def __init__(self, slots: list[str]):
        self._slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("filters", "turn long, " + ", ".join(f"{s} string" for s in self._slots))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((row for chunk in rows for row in chunk.to_dict("records")), key=lambda r: r["turn"])
        now = dict.fromkeys(self._slots)
        last = -1
        if self._state.exists():
            held = self._state.get()
            last, now = held[0], dict(zip(self._slots, held[1:], strict=True))
        out = []
        for r in new:
            late = r["turn"] <= last
            if not late:
                last = r["turn"]
                own = {s: None if pd.isna(r[s]) else r[s] for s in self._slots}
                if r["new_query"]:
                    now = dict.fromkeys(self._slots)
                for name in () if r["cleared"] is None else r["cleared"]:
                    for s in PAIR if name == "time" else (name,):
                        if s in now:
                            now[s] = None
                if any(own.get(s) is not None for s in PAIR):
                    now |= {s: own.get(s) for s in PAIR if s in now}
                now |= {s: v for s, v in own.items() if v is not None}
            out.append((key[0], r["turn"], late, *[now[s] for s in self._slots]))
        self._state.update((last, *[now[s] for s in self._slots]))
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at : at + 10_000], columns=["conv_id", "turn", "late", *[f"now_{s}" for s in self._slots]])

    def close(self) -> None:
        pass


def conversation_stream(turns: DataFrame, slots: list[str]) -> DataFrame:
    """State over a stream of ``conv_id, turn, new_query, cleared`` and the slots as texts."""
    schema = "conv_id long, turn long, late boolean, " + ", ".join(f"now_{s} string" for s in slots)
    return turns.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=ConversationState(slots), outputStructType=schema, outputMode="Append", timeMode="None")


def _plain(value):
    """A value of a pandas row: arrays as lists, all that stands for null as None."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    return None if pd.isna(value) else value


class SessionState(StatefulProcessor):
    """Sessions on a stream: a state variable each for the place in the chat, the last search, the open question and the paging.

    A chat that stays silent is forgotten by a timer in event time; that leaves a row with the reply ``expired``.
    """

    def __init__(self, slots: list[str], idle: float):
        self._slots, self._idle = slots, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        texts = ", ".join(f"{s} string" for s in self._slots)
        self._place = handle.getValueState("place", "turn long, at double")
        self._last = handle.getValueState("last_search", texts)
        self._asked = handle.getValueState("open_question", texts)
        self._paging = handle.getValueState("paging", "found long, offset long")

    def _filters(self, state) -> sessions.Slots | None:
        if not state.exists():
            return None
        return {s: v for s, v in zip(self._slots, state.get(), strict=True) if v is not None}

    def _load(self) -> sessions.Session:
        """The chat's session.  Each call of a state is a message to the engine and back; a chat without a place has nothing else."""
        self._known = self._place.exists()
        if not self._known:
            self._had = (None, None, None)
            return sessions.Session()
        turn, at = self._place.get()
        found, offset = self._paging.get() if self._paging.exists() else (0, 0)
        last, asked = self._filters(self._last), self._filters(self._asked)
        self._had = tuple(None if f is None else self._values(f) for f in (last, asked)) + ((found, offset) if (found, offset) != (0, 0) else None,)
        return sessions.Session(turn, at, last, asked, found, offset)

    def _values(self, filters: sessions.Slots) -> tuple:
        return tuple(filters.get(s) for s in self._slots)

    def _save(self, session: sessions.Session) -> None:
        """Write the place, and of the rest what differs from what was loaded."""
        self._place.update((session.turn, session.at))
        now = [None if f is None else self._values(f) for f in (session.last, session.asked)]
        now.append((session.found, session.offset) if session.paging else None)
        for state, before, held in zip((self._last, self._asked, self._paging), self._had, now, strict=True):
            if held is None and before is not None:
                state.clear()
            elif held is not None and held != before:
                state.update(held)

    def _shown(self, rows: list[tuple]) -> pd.DataFrame:
        # Plain objects, which Arrow takes by the schema: a frame of typed columns for each chat costs more than the chat.
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in sessions.output(self._slots).split(", ")], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [{c: _plain(v) for c, v in row.items()} for chunk in rows for row in chunk.to_dict("records")]
        far = float("-inf")
        new.sort(key=lambda r: (far if r["turn"] is None else r["turn"], far if r["seconds"] is None else r["seconds"]))
        session, out = self._load(), []
        for row in new:
            # Pandas makes whole numbers with gaps to floating ones.
            row |= {c: None if row[c] is None else int(row[c]) for c in ("turn", "results")}
            m = sessions.message(row, self._slots)
            out.append(sessions.replied(key[0], m, sessions.step(session, m, self._idle), session, self._slots))
        self._save(session)
        if session.at is not None:
            for timer in self._handle.listTimers() if self._known else ():
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(int((session.at + self._idle) * 1000) + 1)
        for at in range(0, len(out), 10_000):
            yield self._shown(out[at : at + 10_000])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = self._load()
        # The place stays, so that turns that come again are late; what the chat remembered goes.
        session.forget()
        self._save(session)
        yield self._shown([sessions.replied(key[0], {"turn": session.turn}, sessions.Reply("expired"), session, self._slots)])

    def close(self) -> None:
        pass


def session_stream(messages: DataFrame, slots: list[str], idle: float = sessions.IDLE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """:func:`taktwerk.operators.sessions.session_replies` on a stream of the same columns."""
    return sessions.timed(messages, slots).withWatermark("at", delay).groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=SessionState(slots, idle), outputStructType=sessions.output(slots), outputMode="Append", timeMode="EventTime"
    )


def understand_stream(messages: DataFrame, words: Words | None = None) -> DataFrame:
    """The message rules need no state: the same columns on a stream."""
    return understand(messages, words)


def search_stream(activities: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on a stream of requests: each batch meets the table by the keys of :func:`taktwerk.operators.search.matches`.

    A batch's finds go to a folder of their own below ``out``, which a batch that is run again replaces.
    """

    def run(requests: DataFrame, number: int) -> None:
        with scratch(requests.sparkSession):
            matches(activities, requests).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return run


def ingest_stream(records: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Records without repeats of their keys that arrive within the delay; the first to arrive stays."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_by_order_stream(records: DataFrame, keys: list[str], order: str, time: str, gap: str, delay: str) -> DataFrame:
    """Of records with equal keys the one with the least ``order``, in whatever order they arrive; ``order`` tells the records of a key apart.

    Records of a key that come no more than ``gap`` apart in event time are one group; it comes out once, when the watermark
    (``delay`` behind the latest event) has passed its end.  A key that is seen again later makes a new group.
    """
    payload = F.struct(*[c for c in records.columns if c not in keys])
    least = records.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.min_by(payload, F.col(order)).alias("_first"))
    return least.select(*keys, "_first.*")


def validate_stream(records: DataFrame, row_rules: list[Rule], keep: list[str]) -> DataFrame:
    """Broken rules of a stream's rows."""
    return violations(records, row_rules, keep)
