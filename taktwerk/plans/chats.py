"""Queries over chats: sessions on the table and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions import text as tx
from taktwerk.operators import conversation, sessions
from taktwerk.plans.common import CLEAR, SLOTS, slots_of, streamed, table
from taktwerk.streaming import jobs

ACTIONS = (None, "follow_up", "new_query", "use_known_filters", "stop", "thanks", "greeting", "more", "other")
KINDS = {0: "greeting", 1: "thanks", 2: "stop", 3: "symbols"}


def _messages(rows: DataFrame) -> DataFrame:
    """Messages with what a classifier and a search would say of each, from the conversation's and the turn's numbers."""
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = (conv * 7 + turn * 3) % 13
    label = F.lit("message")
    for n, name in KINDS.items():
        label = F.when(kind == n, name).otherwise(label)
    return rows.select(
        "conv_id", "turn", F.timestamp_seconds(F.lit(1_700_000_000) + conv % 7 * 10 + turn * 60 + F.floor(turn / 5) * 7200).alias("at"), label.alias("label"),
        ((conv + turn * 2) % 5 < 2).alias("more"), ((conv + turn) % 7 == 3).alias("no_more"), (turn % 3 != 0).alias("may_follow"),
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), ((conv * 5 + turn * 3) % len(ACTIONS) + 1).cast("int")).alias("action"),
        conversation.cleared_fields(F.col("text"), CLEAR).alias("cleared"), F.when((conv + turn) % 4 != 0, "activity").otherwise("other").alias("intent"),
        ((conv * 3 + turn) % 6 == 0).alias("clarify"), (F.length("text") % 23).cast("long").alias("results"), *slots_of(tx.search_form(F.col("text"))),
    )


def chat_sessions(spark, sf):
    return sessions.session_replies(_messages(table(spark, sf, "conversations")), SLOTS)


def stream_sessions(spark, sf):
    """The same replies from a stream; rows of chats that were forgotten afterwards are left out."""
    with jobs.state_store(spark):
        return streamed(spark, sf, "conversations", lambda source: jobs.session_stream(_messages(source), SLOTS)).where("reply <> 'expired'")


_NOW = ("day", "category", "sa", "sb")


def _merge(base: str) -> str:
    """Slots of a search that goes on from ``base``, as a struct."""
    pair = "(x.no_time OR x.sa IS NOT NULL OR x.sb IS NOT NULL)"
    one = lambda s, gone: f"'{s}': coalesce(x.{s}, CASE WHEN NOT ({gone}) THEN {base}.{s} END)"
    return "{" + ", ".join([one("day", "x.no_day"), one("category", "x.no_cat"), *[f"'{s}': CASE WHEN {pair} THEN x.{s} ELSE {base}.{s} END" for s in ("sa", "sb")]]) + "}"


_OWN = "{'day': x.day, 'category': x.category, 'sa': x.sa, 'sb': x.sb}"


def sessions_sql(turns: str) -> str:
    """One step of the session per row, by recursion over the turns; ``turns`` is the SQL of the messages' own slots."""
    label = "CASE (conv_id * 7 + turn * 3) % 13 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in KINDS.items()) + " ELSE 'message' END"
    action = f"[{', '.join('NULL' if a is None else repr(a) for a in ACTIONS)}][(conv_id * 5 + turn * 3) % {len(ACTIONS)} + 1]"
    keep = "r.found > 0 AND NOT x.idle"
    asked, last = "CASE WHEN NOT x.idle THEN r.asked END", "CASE WHEN NOT x.idle THEN r.last END"
    return f"""
WITH RECURSIVE {turns},
x AS (SELECT *, {label} AS label, (conv_id + turn * 2) % 5 < 2 AS more, (conv_id + turn) % 7 = 3 AS no_more, turn % 3 <> 0 AS may, {action} AS action,
             (conv_id + turn) % 4 <> 0 AS activity, (conv_id * 3 + turn) % 6 = 0 AS clarify, len % 23 AS results, row_number() OVER w AS k,
             coalesce(turn * 60 + turn // 5 * 7200 - lag(turn * 60 + turn // 5 * 7200) OVER w > 1800, false) AS idle
      FROM t1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (
    SELECT conv_id, 0::bigint AS k, 0::bigint AS turn, NULL::varchar AS reply, NULL::varchar AS base, NULL::struct(day varchar, category varchar, sa varchar, sb varchar) AS now,
           0::bigint AS shown_from, 0::bigint AS shown, false AS has_more, 0::bigint AS found, 0::bigint AS "offset",
           NULL::struct(day varchar, category varchar, sa varchar, sb varchar) AS asked, NULL::struct(day varchar, category varchar, sa varchar, sb varchar) AS last
    FROM (SELECT DISTINCT conv_id FROM x)
    UNION ALL
    SELECT conv_id, k, turn, reply, CASE WHEN runs THEN base END, CASE WHEN runs THEN now END,
           CASE WHEN reply = 'page' THEN off0 ELSE 0 END, CASE WHEN reply = 'page' THEN least(5, found0 - off0) WHEN reply = 'search' THEN least(5, results) ELSE 0 END,
           CASE WHEN reply = 'page' THEN off0 + 5 < found0 ELSE reply = 'search' AND results > 5 END,
           CASE WHEN reply = 'page' THEN CASE WHEN off0 + 5 < found0 THEN found0 ELSE 0 END WHEN reply = 'search' THEN CASE WHEN results > 5 THEN results ELSE 0 END WHEN holds THEN found0 ELSE 0 END,
           CASE WHEN reply = 'page' THEN CASE WHEN off0 + 5 < found0 THEN off0 + 5 ELSE 0 END WHEN reply = 'search' THEN CASE WHEN results > 5 THEN 5 ELSE 0 END WHEN holds THEN off0 ELSE 0 END,
           CASE WHEN reply = 'clarify' THEN now WHEN reply = 'search' THEN NULL ELSE asked0 END, CASE WHEN reply = 'search' AND activity THEN now ELSE last0 END
    FROM (SELECT *, kind = 'run' AS runs, CASE WHEN kind = 'run' THEN CASE WHEN clarify THEN 'clarify' ELSE 'search' END ELSE kind END AS reply,
                 kind IN ('ignored', 'greeting') AND (label IN ('symbols', 'greeting') OR paging) OR NOT paging AND false AS holds
          FROM (SELECT *, CASE WHEN label = 'symbols' THEN 'ignored' WHEN label = 'greeting' THEN 'greeting' WHEN label = 'thanks' OR label = 'stop' AND action IN ('stop', 'thanks') THEN 'thanks'
                               WHEN paging AND d = 'more' THEN 'page' WHEN paging AND d = 'stop' THEN 'stopped' WHEN paging AND d IN ('greeting', 'thanks') THEN d
                               WHEN asked0 IS NOT NULL AND action IN ('greeting', 'thanks') THEN action
                               WHEN asked0 IS NOT NULL AND action = 'use_known_filters' AND coalesce(asked0.day, asked0.category, asked0.sa, asked0.sb) IS NULL THEN 'ask'
                               WHEN asked0 IS NULL AND last0 IS NOT NULL AND may AND action IN ('greeting', 'thanks') THEN action ELSE 'run' END AS kind,
                       CASE WHEN asked0 IS NOT NULL THEN CASE WHEN action = 'new_query' THEN 'own' ELSE 'asked' END WHEN last0 IS NOT NULL AND may AND action = 'follow_up' THEN 'last' ELSE 'own' END AS base,
                       CASE WHEN asked0 IS NOT NULL THEN CASE WHEN action = 'use_known_filters' THEN asked0 WHEN action = 'new_query' THEN own ELSE onto_asked END
                            WHEN last0 IS NOT NULL AND may AND action = 'follow_up' THEN onto_last ELSE own END AS now
                FROM (SELECT x.*, {asked} AS asked0, {last} AS last0, CASE WHEN x.idle THEN 0 ELSE r.found END AS found0, CASE WHEN x.idle THEN 0 ELSE r."offset" END AS off0, {keep} AS paging,
                             CASE WHEN x.more THEN 'more' WHEN x.no_more THEN 'stop' ELSE x.action END AS d, {_OWN} AS own, {_merge('r.asked')} AS onto_asked, {_merge('r.last')} AS onto_last
                      FROM r JOIN x ON x.conv_id = r.conv_id AND x.k = r.k + 1)))
)
SELECT conv_id, turn, reply, base, now.day AS now_day, now.category AS now_category, now.sa AS now_start_after, now.sb AS now_start_before,
       shown_from, shown, has_more, asked IS NOT NULL AS asking, last IS NOT NULL AS has_last FROM r WHERE k > 0"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (chat_sessions, stream_sessions)}
