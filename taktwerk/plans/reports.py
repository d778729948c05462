"""Queries over reports, intervals, rules and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import intervals, lexicon, reports, rows
from taktwerk.plans.common import eval_cases, order_rows, shared_folder, streamed, table
from taktwerk.streaming import jobs


def duplicate_rows(spark, sf):
    """A row for every document that has a twin."""
    docs = table(spark, sf, "documents")
    found = reports.duplicate_members(docs, [F.col("source"), F.lower(F.substring("text", 1, 12))], F.col("lang"), "doc_id")
    return found.select(F.col("first").alias("first_doc"), "n", F.col("ord").alias("doc_id"), "label")


def first_mismatches(spark, sf):
    """The first twenty orders of each customer segment, and how many more there are."""
    o = table(spark, sf, "orders").select("o_orderpriority", F.col("o_custkey").cast("string").alias("customer"), "o_orderkey")
    return reports.first_of(o, ["o_orderpriority"], ["customer", "o_orderkey"]).select("o_orderpriority", "customer", "o_orderkey", F.col("place").cast("long").alias("place"), "more")


def interval_join(spark, sf):
    """Events by the intervals of a table that overlap, some of them empty."""
    n = F.col("n_nationkey")
    spans = table(spark, sf, "nation").select(n.cast("long").alias("span"), (n * 3000).alias("low"), F.when(n % 7 != 0, n * 3000 + (n % 5) * 4000 - 1000).alias("high"), (n % 2).alias("side"))
    ev = table(spark, sf, "events").select("event_id", F.col("ts"), (F.col("user_id") % 2).alias("parity"))
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    met = intervals.in_intervals(ev, second, spans, "low", "high", 3600, {"parity": "side"})
    return met.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


def rule_join(spark, sf):
    """Orders by the first of some hundred rules with open keys."""
    c = table(spark, sf, "customer").where("c_custkey % 3 = 0")
    k = F.col("c_custkey")
    rule = c.select(
        F.when(k % 2 == 0, F.concat((k % 5 + 1).cast("string"), F.lit("-"))).alias("kind"), F.when(k % 4 != 0, F.substring(F.lit("FOP"), (k % 3 + 1).cast("int"), F.lit(1))).alias("state"),
        F.when(k % 5 == 0, k % 11).alias("digit"), (k % 17).alias("priority"), F.when(k % 13 != 0, k).alias("minutes"),
    )
    o = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 2).alias("kind"), F.col("o_orderstatus").alias("state"), (F.col("o_custkey") % 11).alias("digit"))
    return intervals.first_rule(o, rule, ["kind", "state", "digit"], "priority", "minutes", "minutes").select("o_orderkey", "minutes")


def lexicon_mentions(spark, sf):
    """Names with prefixes before them and letters off; letters beyond ASCII as one sign, as SQL counts their bytes."""
    words = ("the", "and", "that", "der", "que", "control", "les", "und", "with", "of the", "and the", "in the thing", "ation", "eaux", "ichte")
    names = F.array(*[F.lit(w) for w in words])
    lex = table(spark, sf, "nation").select((F.col("n_nationkey") % 4).cast("string").alias("slot"), F.element_at(names, (F.col("n_nationkey") % len(words) + 1).cast("int")).alias("variant"))
    plain = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "q"))
    found = lexicon.mentions(plain, ["conv_id", "turn"], lex.distinct().withColumn("canonical", F.upper("variant")), True, "aes")
    return found.select("conv_id", "turn", "slot", "canonical", F.col("off").cast("long").alias("off"), F.col("cut").cast("long").alias("cut"))


def _orders(spark, sf):
    return order_rows(spark, sf).withColumn("branch", F.lit(None).cast("string")).withColumn("target_audience", F.lit("x"))


def report_summary(spark, sf):
    return reports.validate(_orders(spark, sf), shared_folder(spark, "report")).part("summary")


def report_shown(spark, sf):
    shown = reports.validate(_orders(spark, sf), shared_folder(spark, "report")).shown()
    return shown.select("severity", "ord", "rule", F.col("place").cast("long").alias("place"), "more")


def _cases(spark, sf):
    k = F.col("id")
    done = eval_cases(spark, sf).withColumn("query", F.concat(F.lit("case "), k.cast("string"))).withColumn("duration", (k % 7) / 8.0)
    return done.withColumn("failures", F.sequence(F.lit(1), F.greatest(F.col("n_failures"), F.lit(1)))).withColumn("observed", F.struct(F.lit("activity").alias("intent")))


def case_report(spark, sf):
    return reports.case_rows(_cases(spark, sf), reports.OBSERVED).select("id", "query", "passed", "duration", F.col("observed.intent").alias("intent"), F.col("observed.day").alias("day"), F.col("observed.result_count").alias("result_count"))


def case_summary(spark, sf):
    return reports.case_summary(_cases(spark, sf))


def stream_first(spark, sf):
    """Of the events of a user and a kind the one with the least value, of equal ones that with the least number; the last event closes the stream."""
    def make(source):
        closing = F.col("event_id") == 0
        at = F.when(closing, F.lit("2100-01-01").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
        own = source.select(F.when(~closing, F.col("user_id")).alias("user_id"), "event_type", F.struct(F.col("event_id") * 7919 % 10_007, "event_id").alias("rank"), "event_id", at.alias("at"))
        return jobs.first_by_order_stream(own, ["user_id", "event_type"], "rank", "at", "2000 days", "1 day")

    return streamed(spark, sf, "events", make).where("user_id IS NOT NULL").select("user_id", "event_type", "event_id")


_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(text, '[^\x00-\x7F]', 'q', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def sql(oracle: dict[str, str]) -> dict[str, str]:
    """``oracle``: the orders' rule violations and the evaluated cases as common table expressions."""
    return {
        "duplicate_rows": """WITH k AS (SELECT doc_id, lang, source, lower(substr(text, 1, 12)) AS t FROM documents), g AS (SELECT source, t, count(*) AS n, min(doc_id) AS first_doc FROM k GROUP BY ALL HAVING count(*) > 1)
            SELECT first_doc, n, doc_id, lang AS label FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source AND k.t IS NOT DISTINCT FROM g.t""",
        "first_mismatches": """SELECT o_orderpriority, o_custkey::varchar AS customer, o_orderkey, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY o_orderpriority) - 20, 0) AS more
            FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey::varchar, o_orderkey) QUALIFY place <= 20""",
        "interval_join": """WITH s AS (SELECT n_nationkey::bigint AS span, n_nationkey * 3000 AS low, n_nationkey * 3000 + (n_nationkey % 5) * 4000 - 1000 AS high, n_nationkey % 2 AS side FROM nation WHERE n_nationkey % 7 <> 0)
            SELECT span, count(*) AS n, sum(event_id)::bigint AS total FROM events JOIN s ON user_id % 2 = side AND hour(ts) * 3600 + minute(ts) * 60 + second(ts) BETWEEN low AND high GROUP BY 1""",
        "rule_join": """WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 5 + 1) || '-' END AS kind, CASE WHEN c_custkey % 4 <> 0 THEN substr('FOP', (c_custkey % 3 + 1)::int, 1) END AS state,
                CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 11 END AS digit, c_custkey % 17 AS priority, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS minutes FROM customer WHERE c_custkey % 3 = 0),
            u AS (SELECT kind, state, digit, priority, minutes FROM r QUALIFY row_number() OVER (PARTITION BY kind, state, digit ORDER BY priority, minutes NULLS FIRST) = 1)
            SELECT o_orderkey, minutes FROM orders LEFT JOIN u ON (kind IS NULL OR kind = substr(o_orderpriority, 1, 2)) AND (state IS NULL OR state = o_orderstatus) AND (digit IS NULL OR digit = o_custkey % 11)
            QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority NULLS LAST, minutes NULLS FIRST) = 1""",
        "lexicon_mentions": rf"""WITH lex AS (SELECT DISTINCT (n_nationkey % 4)::varchar AS slot, ['the', 'and', 'that', 'der', 'que', 'control', 'les', 'und', 'with', 'of the', 'and the', 'in the thing', 'ation', 'eaux', 'ichte'][n_nationkey % 15 + 1] AS variant FROM nation),
            w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
            tok AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS token FROM w, (VALUES (1), (2), (3), (4)) t(k)),
            cut AS (SELECT conv_id, turn, substr(token, c + 1) AS token, c FROM tok, (VALUES (0), (1), (2), (3)) t(c) WHERE c < instr(token || ' ', ' ') - 1 AND regexp_full_match(left(token, c), '[aes]*')),
            hit AS (SELECT conv_id, turn, slot, variant, levenshtein(token, variant) AS off, c FROM cut JOIN lex ON abs(length(token) - length(variant)) <= 1 AND levenshtein(token, variant) <= CASE WHEN length(variant) >= 4 THEN 1 ELSE 0 END)
            SELECT conv_id, turn, slot, upper(variant) AS canonical, off::bigint AS "off", c::bigint AS cut FROM hit
            QUALIFY row_number() OVER (PARTITION BY conv_id, turn, slot ORDER BY off, c, length(variant) DESC, variant DESC) = 1""",
        "report_summary": f"""WITH {oracle['orders']}, n AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM w),
            d AS (SELECT count(*) AS g FROM (SELECT 1 FROM orders GROUP BY {oracle['same']} HAVING count(*) > 1))
            SELECT (SELECT count(*) FROM orders) AS total_activities, e AS critical_errors, w AS warnings, g AS duplicate_groups, CASE WHEN e = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n, d""",
        "report_shown": f"""WITH {oracle['orders']} SELECT severity, k AS ord, rule, row_number() OVER x AS place, greatest(count(*) OVER (PARTITION BY severity) - 20, 0) AS more FROM w
            WINDOW x AS (PARTITION BY severity ORDER BY k, rule) QUALIFY place <= 20""",
        "case_report": f"{oracle['cases']} SELECT id, 'case ' || id AS query, n_failures = 0 AS passed, (id % 7) / 8.0::double AS duration, 'activity' AS intent, NULL::varchar AS day, result_count FROM e",
        "case_summary": f"""{oracle['cases']} SELECT count(*) FILTER (n_failures = 0) AS passed, count(*) FILTER (n_failures > 0) AS failed, count(*) AS total,
            round(100.0::double * count(*) FILTER (n_failures = 0) / count(*), 2) AS score, sum((id % 7) / 8.0::double) AS total_duration FROM e""",
        "stream_first": "SELECT user_id, event_type, min({'rank': event_id * 7919 % 10007, 'event_id': event_id})['event_id'] AS event_id FROM events WHERE event_id <> 0 GROUP BY 1, 2",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (duplicate_rows, first_mismatches, interval_join, rule_join, lexicon_mentions, report_summary, report_shown, case_report, case_summary, stream_first)
    return {f.__name__: f for f in found}
