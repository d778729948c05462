"""Sessions: the rules one by one, the table against the stream, restarts, silent chats."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import sessions
from taktwerk.plans import chats, common
from taktwerk.streaming import jobs

SLOTS = common.SLOTS


def msg(turn, at=0.0, **own):
    base = {"turn": turn, "at": at, "label": "message", "more": False, "no_more": False, "may_follow": False, "action": None, "cleared": None, "intent": "activity", "clarify": False, "results": 0, "slots": {}}
    return base | own


def run(*messages, idle=1800):
    s = sessions.Session()
    return s, [sessions.step(s, m, idle) for m in messages]


def test_paging_goes_to_the_end_and_then_means_a_search():
    s, out = run(msg(0, results=12), msg(1, more=True), msg(2, more=True), msg(3, more=True, results=2))
    assert [(r.kind, r.shown_from, r.shown, r.has_more) for r in out] == [("search", 0, 5, True), ("page", 5, 5, True), ("page", 10, 2, False), ("search", 0, 2, False)]
    assert not s.paging


@pytest.mark.parametrize(
    ("second", "kind", "paging"),
    [({"no_more": True}, "stopped", False), ({"action": "stop"}, "stopped", False), ({"action": "thanks"}, "thanks", False), ({"action": "greeting"}, "greeting", True),
     ({"label": "greeting"}, "greeting", True), ({"label": "symbols"}, "ignored", True), ({"label": "thanks"}, "thanks", False), ({"label": "stop", "action": "stop"}, "thanks", False),
     ({"label": "stop", "action": "other", "results": 1}, "search", False), ({"results": 7}, "search", True)],
)
def test_what_ends_the_paging(second, kind, paging):
    s, out = run(msg(0, results=9), msg(1, **second))
    assert (out[1].kind, s.paging) == (kind, paging)


def test_a_question_asked_back():
    ask = msg(0, clarify=True, slots={"day": "mon"})
    s, out = run(ask, msg(1, slots={"category": "yoga"}, cleared=["day"]))
    assert (out[0].kind, out[1].base, out[1].slots, s.asked, s.last) == ("clarify", "asked", {"category": "yoga"}, None, {"category": "yoga"})
    s, out = run(ask, msg(1, action="use_known_filters"))
    assert (out[1].kind, out[1].slots) == ("search", {"day": "mon"})
    s, out = run(msg(0, clarify=True), msg(1, action="use_known_filters"), msg(2, action="thanks"))
    assert [r.kind for r in out] == ["clarify", "ask", "thanks"] and s.asked == {}
    s, out = run(ask, msg(1, action="new_query", slots={"category": "c"}))
    assert (out[1].base, out[1].slots, s.asked) == ("own", {"category": "c"}, None)


def test_the_last_search_is_kept_for_activities_only():
    s, _ = run(msg(0, slots={"day": "mon"}), msg(1, intent="other", slots={"day": "tue"}))
    assert s.last == {"day": "mon"}
    s, out = run(msg(0, slots={"day": "mon", "start_after": "9"}), msg(1, may_follow=True, action="follow_up", slots={"start_before": "5"}))
    assert (out[1].base, out[1].slots) == ("last", {"day": "mon", "start_before": "5"})
    s, out = run(msg(0, slots={"day": "mon"}), msg(1, may_follow=False, action="follow_up", slots={"category": "c"}))
    assert (out[1].base, out[1].slots) == ("own", {"category": "c"})


def test_merged_slots():
    base = {"day": "d", "start_after": "1", "start_before": "2"}
    assert sessions.merged(base, {}, ["time"]) == {"day": "d"}
    assert sessions.merged(base, {"start_after": "3"}, None) == {"day": "d", "start_after": "3"}
    assert sessions.merged(base, {"day": "e"}, ["day"]) == {"day": "e", "start_after": "1", "start_before": "2"}


def test_late_and_idle():
    s, out = run(msg(5, at=0.0, results=9), msg(5, at=1.0), msg(None), msg(6, at=5000.0, more=True, results=1))
    assert [r.kind for r in out] == ["search", "late", "late", "search"] and not s.paging


SCHEMA = f"conv_id long, turn long, at timestamp, label string, more boolean, no_more boolean, may_follow boolean, action string, cleared array<string>, intent string, clarify boolean, results long, {', '.join(f'{s} string' for s in SLOTS)}"


def table(spark, rows):
    when = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    full = [(c, t, when + dt.timedelta(seconds=at), "message", more, False, True, "follow_up", None, "activity", False, found, day, None, None, None) for c, t, at, more, found, day in rows]
    return spark.createDataFrame(full, SCHEMA)


def run_stream(spark, path, out, state):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.session_stream(source, SLOTS, delay="1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_stream_over_restarts_equals_the_table(spark):
    """Files come one by one, the stream stops and starts in between; a silent chat leaves an expired row and forgets."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parts = [
        [(1, 0, 0, False, 12, "mon"), (2, 0, 10, False, 3, "tue"), (1, 1, 20, True, 0, None)],
        [(1, 3, 60, False, 2, None), (1, 2, 40, True, 0, None), (2, 1, 70, False, 1, None)],
        [(3, 0, 20_000, False, 8, "wed"), (2, 2, 20_001, False, 1, None)],
        [(3, 1, 20_010, True, 0, None), (3, 0, 20_011, True, 0, None)],
    ]
    with jobs.state_store(spark):
        for part in parts:
            table(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in")
            got = run_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    want = sessions.session_replies(table(spark, [r for p in parts for r in p if p is not parts[3]] + parts[3][:1]), SLOTS)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert plain(got.where("reply NOT IN ('expired', 'late')")) == plain(want)
    assert {(r.conv_id, r.turn) for r in got.where("reply = 'late'").collect()} == {(3, 0)}
    gone = {(r.conv_id, r.has_last, r.asking) for r in got.where("reply = 'expired'").collect()}
    assert (1, False, False) in gone and (3, False, False) not in gone
    assert want.where("conv_id = 2 AND turn = 2").first().base == "own" and want.where("conv_id = 2 AND turn = 1").first().base == "last"


def test_odd_messages(spark):
    odd = [(None, 1, 0, False, 1, "a"), (None, 2, 0, False, 1, None), (4, None, 0, False, 1, "b"), (4, 1, 0, False, None, "b"), (4, 1, 0, False, 6, "b")]
    df = table(spark, odd).withColumns({"label": F.when(F.col("conv_id").isNotNull(), F.col("label")), "at": F.lit(None).cast("timestamp"), "extra": F.lit("x")})
    got = {(r.conv_id, r.turn, r.reply) for r in sessions.session_replies(df, SLOTS).collect()}
    assert got == {(None, 1, "ignored"), (None, 2, "ignored"), (4, None, "late"), (4, 1, "search"), (4, 1, "late")}
    assert sessions.session_replies(table(spark, []), SLOTS).count() == 0


def test_query_of_the_plans(spark, sf_dir):
    assert {r.reply for r in chats.chat_sessions(spark, sf_dir).select("reply").distinct().collect()} >= {"search", "clarify", "page", "thanks", "greeting", "ignored"}


class _Calls:
    """A handle that holds values in memory and counts the messages that a real one would exchange."""

    def __init__(self):
        self.n, self.held = 0, {}

    def getValueState(self, name, schema):
        outer = self

        class State:
            def exists(self):
                outer.n += 1
                return name in outer.held

            def get(self):
                outer.n += 1
                return outer.held.get(name)

            def update(self, value):
                outer.n += 1
                outer.held[name] = value

            def clear(self):
                outer.n += 1
                outer.held.pop(name)

        return State()

    def listTimers(self):
        self.n += 1
        return iter(())

    def registerTimer(self, at):
        self.n += 1


def test_a_new_chat_costs_few_calls_of_its_state():
    import pandas as pd

    handle, own = _Calls(), jobs.SessionState(SLOTS, 1800)
    own.init(handle)
    row = {"turn": 1, "seconds": 5.0, "label": "message", "more": False, "no_more": False, "may_follow": False, "action": None, "cleared": None, "intent": "other", "clarify": False, "results": 2} | dict.fromkeys(SLOTS)
    (shown,) = own.handleInputRows((4,), iter([pd.DataFrame([row])]), None)
    assert shown["reply"].tolist() == ["search"] and handle.held == {"place": (1, 5.0)}
    # Whether it is known, its place, and its timer.
    assert handle.n == 3
