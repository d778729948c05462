"""Sessions: what a chat remembers from message to message.

A session remembers its last search, a question that it has asked back, and how far its results have been shown.  Each
message moves all three, by rules that are one small function (:func:`step`); a table of messages and a stream of them go
through the same function.  On a table, messages are dealt by conversation, sorted by turn and folded as they pass, so a task
holds the state of one conversation and nothing of its messages.

``messages`` has ``conv_id, turn, at`` (a timestamp), ``label`` (see :func:`taktwerk.operators.conversation.label`), ``more``
and ``no_more`` (what the text asks for while results are being shown), ``may_follow`` (whether the text can continue a
search), ``action`` (what a classifier took the message for, if there is one), the message's own slots as texts, ``cleared``
(names of slots it clears), and what a search with the merged slots would give: ``intent``, ``clarify`` (it has to ask back)
and ``results`` (rows found).

A message whose turn is null or not after the last one of its conversation is passed on as ``late`` and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results that are shown at once, and the seconds after which a silent chat is forgotten.
PAGE, IDLE_SECONDS = 5, 1800
#: Slots that are one pair: either one set replaces both, and ``time`` clears both.
PAIR = ("start_after", "start_before")
#: Columns of a message besides its slots.
INPUT = ("conv_id", "turn", "at", "label", "more", "no_more", "may_follow", "action", "cleared", "intent", "clarify", "results")

Slots = dict[str, str]


@dataclass
class Session:
    """The memory of one chat.  ``last`` and ``asked`` are the slots of the last search and of the one that asked back."""

    turn: int | None = None
    at: float | None = None
    last: Slots | None = None
    asked: Slots | None = None
    found: int = 0
    offset: int = 0

    def forget(self) -> None:
        self.last = self.asked = None
        self.found = self.offset = 0

    @property
    def paging(self) -> bool:
        return self.found > 0


@dataclass
class Reply:
    """What a message leads to; ``base`` tells where the slots of its search began: own, last or asked."""

    kind: str
    base: str | None = None
    slots: Slots = field(default_factory=dict)
    shown_from: int = 0
    shown: int = 0
    has_more: bool = False


def merged(base: Slots, own: Slots, cleared: list[str] | None) -> Slots:
    """Slots of a search that goes on: fields that are cleared go, own ones come or replace."""
    gone = set(cleared or ())
    if "time" in gone or any(s in own for s in PAIR):
        gone |= set(PAIR)
    return {s: v for s, v in base.items() if s not in gone} | own


def _asked_for(session: Session, m: dict) -> tuple[str, str | None, Slots]:
    """Reply, base and slots of a message that is no page, thanks or greeting by its text."""
    own, action = m["slots"], m["action"]
    if session.asked is not None:
        if action in ("greeting", "thanks"):
            return action, None, {}
        if action == "use_known_filters":
            return ("search", "asked", session.asked) if session.asked else ("ask", None, {})
        if action == "new_query":
            session.asked = None
            return "search", "own", own
        return "search", "asked", merged(session.asked, own, m["cleared"])
    if session.last is not None and m["may_follow"]:
        if action in ("greeting", "thanks"):
            return action, None, {}
        if action == "follow_up":
            return "search", "last", merged(session.last, own, m["cleared"])
    return "search", "own", own


def step(session: Session, m: dict, idle: float = IDLE_SECONDS) -> Reply:
    """Move the session by one message."""
    if m["turn"] is None or session.turn is not None and m["turn"] <= session.turn:
        return Reply("late")
    if None not in (m["at"], session.at) and m["at"] - session.at > idle:
        session.forget()
    session.turn, session.at = m["turn"], m["at"] if m["at"] is not None else session.at
    label, action = m["label"], m["action"]
    if label in ("symbols", "greeting"):
        return Reply("ignored" if label == "symbols" else label)
    if label == "thanks" or label == "stop" and action in ("stop", "thanks"):
        session.found = session.offset = 0
        return Reply("thanks")
    if session.paging:
        asked = "more" if m["more"] else "stop" if m["no_more"] else action
        if asked == "more":
            shown_from, found = session.offset, session.found
            session.offset = min(shown_from + PAGE, found)
            if session.offset >= found:
                session.found = session.offset = 0
            return Reply("page", None, {}, shown_from, min(PAGE, found - shown_from), session.paging)
        if asked == "greeting":
            return Reply("greeting")
        session.found = session.offset = 0
        if asked in ("stop", "thanks"):
            return Reply("stopped" if asked == "stop" else "thanks")
    kind, base, slots = _asked_for(session, m)
    if kind != "search":
        return Reply(kind)
    session.found = session.offset = 0
    if m["clarify"]:
        session.asked = slots
        return Reply("clarify", base, slots)
    session.asked = None
    if m["intent"] == "activity":
        session.last = slots
    found = m["results"] or 0
    if found > PAGE:
        session.found, session.offset = found, PAGE
    return Reply("search", base, slots, 0, min(PAGE, found), found > PAGE)


def output(slots: list[str]) -> str:
    """The columns of a reply, as a schema."""
    now = "".join(f", now_{s} string" for s in slots)
    return f"conv_id long, turn long, reply string, base string{now}, shown_from long, shown long, has_more boolean, asking boolean, has_last boolean"


def replied(conv: int | None, m: dict, r: Reply, session: Session, slots: list[str]) -> tuple:
    return (conv, m["turn"], r.kind, r.base, *[r.slots.get(s) for s in slots], r.shown_from, r.shown, r.has_more, session.asked is not None, session.last is not None)


def message(row: dict, slots: list[str]) -> dict:
    """A row as :func:`step` takes it; a blank label is an ignored message, a slot that is null is not set."""
    own = {s: row[s] for s in slots if row[s] is not None}
    return row | {"slots": own, "label": row["label"] or "symbols", "at": row["seconds"]}


def _folded(batches: Iterator[pa.RecordBatch], slots: list[str], idle: float) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in output(slots).split(", "))])
    session, now, begun = Session(), None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != now:
                session, now, begun = Session(), row["conv_id"], True
            m = message(row, slots)
            out.append(replied(now, m, step(session, m, idle), session, slots))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def timed(messages: DataFrame, slots: list[str]) -> DataFrame:
    """The columns that are used, and the time of each message in seconds, which no time zone changes."""
    return messages.select(*INPUT, *slots, F.col("at").cast("double").alias("seconds"))


def session_replies(messages: DataFrame, slots: list[str], idle: float = IDLE_SECONDS) -> DataFrame:
    """One row per message: the reply, the slots of its search (``now_*``), the rows shown, and what the chat remembers after it.

    ``asking``: it has asked back; ``has_last``: it remembers a search; ``shown_from, shown, has_more``: the results shown.
    """
    rows = timed(messages, slots).drop("at").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "seconds")
    return rows.mapInArrow(partial(_folded, slots=slots, idle=idle), output(slots))
