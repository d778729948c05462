"""The operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions import text as tx
from taktwerk.functions import timeofday as td
from taktwerk.functions.ages import age_bound, age_status, certainty, strict_int
from taktwerk.operators import conversation, evalcases, extract, messages, quality, ranking, rows, search
from taktwerk.plans import chats, layouts, lookups, reports, stores
from taktwerk.plans.common import CLEAR, STOP, shared_folder, slots_of
from taktwerk.plans.common import SLOTS as _SLOTS
from taktwerk.plans.common import eval_cases
from taktwerk.plans.common import order_rows as _order_rows
from taktwerk.plans.common import parts_as_activities as _parts_as_activities
from taktwerk.plans.common import requests as _requests
from taktwerk.plans.common import streamed as _stream
from taktwerk.plans.common import table as _table
from taktwerk.sources.documents import lines_of
from taktwerk.streaming import jobs

#: Words of the given texts in place of the Hebrew ones.
WORDS = messages.Words(
    activity=["thing", "tion "], vague=["the", "der", "la"], generic=["of", "que", "die"], clues=["and", "eau", "ung"], relative=("that", "und", "les"),
    weekdays=["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"], day_variants={"Mon": ["on"], "Tue": ["er"], "Wed": ["en"]}, at=["at"], after="after", before="before",
    dayparts=[("morning", ["ered"], ["with"]), ("noon", ["ande"], ["de", "von"]), ("evening", ["ment"], ["un"]), ("night", ["keit"], ["ist"])],
    audiences=[("mixed", ["schen"]), ("women", ["elle"]), ("families", ["esth"])], no_centers=["the", "la"], branch="in",
)


def _clock(ts) -> object:
    return F.date_format(ts, "HH:mm")


def norm_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.md5(tx.search_form(F.col("text"))).alias("norm_md5"))


def clean_placeholders(spark, sf):
    lines = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", F.col("n").cast("long").alias("n"), tx.clean_text(F.col("line"), ["The.", "Of.", "Is."]).alias("line"), tx.is_blank(F.col("line")).alias("blank"))


def tolerant_search(spark, sf):
    part = _table(spark, sf, "part")
    found = part.where(tx.tolerant_match(F.col("p_name"), F.lit(" Red  Widget ")) | tx.tolerant_match(F.col("p_type"), F.lit("econ")))
    return found.select("p_partkey", "p_name", "p_type")


def batch_search(spark, sf):
    found = search.search_many(_parts_as_activities(spark, sf), _requests(spark, sf), first=search.PAGE)
    return found.select("request_id", "ord", "name", "age_match", F.col("place").cast("long").alias("place"), "total")


def answer_text(spark, sf):
    ranked = search.search_many(_parts_as_activities(spark, sf), _requests(spark, sf), first=search.PAGE)
    line = search.display_line({c: F.col(c) for c in ("name", "day", "start_time", "center_name", "min_age", "max_age", "age_match")})
    return search.answers(ranked, line)


def age_summaries(spark, sf):
    return search.age_summary(search.matches(_parts_as_activities(spark, sf), _requests(spark, sf)))


def all_places(spark, sf):
    """Every match of every request with its place, counted over ranges; a request that most rows fit fills many of them."""
    found = search.search_many(_parts_as_activities(spark, sf), _requests(spark, sf))
    return found.select("request_id", "ord", "age_match", "place", "total")


def deep_page(spark, sf):
    """The page of each kind of event behind its first thousand."""
    events = _table(spark, sf, "events").select("event_type", "ts", "event_id")
    places = ranking.kept_in_order(ranking.ranked(events, ["event_type"], ["ts", "event_id"], descending=("ts",)), ["event_type"])
    return ranking.page_at(places, 1000, 50).select("event_type", "event_id", "place", "total", "next_offset", "has_more")


def next_page(spark, sf):
    """The rows that follow a row by its own values, with nothing counted before it."""
    orders = _table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return ranking.page_after(orders, ["o_orderpriority", "o_totalprice", "o_orderkey"], ["3-MEDIUM", 100_000.0, 0], 200)


def single_search(spark, sf):
    found = search.search(_parts_as_activities(spark, sf), day="medium", start_after="10:00", age=20)
    return found.select("ord", "age_match")


def time_window(spark, sf):
    ev = _table(spark, sf, "events")
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.where(td.at_or_after(t, F.lit("8:30")) & td.at_or_before(t, F.lit("17:00:00"))).select("event_id", td.seconds_of(t).cast("long").alias("second"))


def daypart_join(spark, sf):
    ev = _table(spark, sf, "events")
    return rows.with_dayparts(ev, _clock("ts")).groupBy("daypart", "event_type").agg(F.count(F.lit(1)).alias("n"))


def weekday_name(spark, sf):
    names = [d[:3] for d in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")]
    return _table(spark, sf, "orders").groupBy(td.weekday_of(F.col("o_orderdate"), names).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def add_minutes(spark, sf):
    ev = _table(spark, sf, "events")
    return ev.select("event_id", td.add_minutes(_clock("ts"), (F.col("user_id") % 180).cast("int")).alias("end_time"))


def time_forms(spark, sf):
    ev = _table(spark, sf, "events")
    h, m = F.hour("ts"), F.minute("ts")
    form = (
        F.when(F.col("event_id") % 4 == 0, F.format_string("%d.%02d", h, m)).when(F.col("event_id") % 4 == 1, F.format_string("%d:%02d PM", h % 12, m))
        .when(F.col("event_id") % 4 == 2, F.format_string("at %d:%02d!", h + 3, m)).otherwise(F.format_string("%d:%02d-%d:%02d", h, m, h, m))
    )
    span = td.time_range(form)
    return ev.select("event_id", span["start"].alias("start_time"), span["end"].alias("end_time"), td.canonical_time(form).alias("time"))


def infer_end(spark, sf):
    ev = _table(spark, sf, "events")
    table = ev.select("event_id", F.col("event_type").alias("source_file"), F.date_format("ts", "E").alias("day"), _clock("ts").alias("start_time"), (F.col("user_id") % 3).cast("string").alias("name"), F.when(F.col("event_id") % 10 == 0, "12:00").alias("end_time"))
    rule = [("click", None, None, None, 55, 2), ("click", None, None, "1", 45, 1), ("view", "Mon", None, "2", None, 1), ("view", "Mon", None, None, 30, 2), ("error", "Tue", None, "0", 60, 1)]
    return rows.infer_end(table, rows.duration_rules(spark, rule)).select("event_id", "end_inferred", "end_time_source")


def range_status(spark, sf):
    part = _table(spark, sf, "part")
    low = F.when(F.col("p_size") % 5 != 0, F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").when(F.col("p_partkey") % 11 == 0, ".5").otherwise("")))
    high = F.when(F.col("p_size") % 3 == 0, (F.col("p_size") + 10).cast("string"))
    return part.select("p_partkey", age_status(low, high, F.lit(25)).alias("age_match"), age_bound(low).cast("long").alias("low"), strict_int(low).cast("long").alias("strict_low"))


def certainty_rank(spark, sf):
    part = _parts_as_activities(spark, sf).withColumn("age_match", age_status(F.col("min_age"), F.col("max_age"), F.lit(25)))
    ranked = search.top(part, ["center_name"], [certainty(F.col("age_match")), F.col("ord")])
    return ranked.select("center_name", "ord", "age_match", F.col("place").cast("long").alias("place"))


def page(spark, sf):
    got = search.page(_table(spark, sf, "events"), ["user_id"], [F.col("event_id")], 5)
    return got.select("user_id", "event_id", F.col("place").cast("long").alias("place"), F.col("next_offset").cast("long").alias("next_offset"), "has_more")


def dedup_first(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.md5(tx.search_form(F.col("text"))).alias("key"))
    return rows.keep_first(docs, ["key"], "doc_id").select("doc_id", "key")


def dedup_last(spark, sf):
    return rows.keep_last(_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "o_orderkey")


def dup_groups(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "source", F.md5(tx.search_form(F.col("text"))).alias("key"))
    found = rows.duplicate_groups(docs, [F.col("key")], F.col("ord").cast("string"))
    return found.select(F.col("first").alias("first_doc"), "n", F.array_join("members", ",").alias("members"))


def profile(spark, sf):
    cust = _table(spark, sf, "customer").withColumn("segment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 20 == 0, " ")))
    return quality.profile(cust, {"segment": "missing", "c_nationkey": None}, {"segment": tx.is_blank(F.col("segment"))})


def _order_rules():
    c = {x: F.col(x) for x in ("name", "center_name", "day", "start_time", "end_time", "min_age", "max_age", "status", "instructor", "location")}
    return quality.activity_row_rules(c)


def violations(spark, sf):
    found = quality.violations(_order_rows(spark, sf), _order_rules(), ["ord"])
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.sum("ord").alias("total"))


def verdict(spark, sf):
    return quality.verdict(quality.violations(_order_rows(spark, sf), _order_rules(), ["ord"]))


def source_summary(spark, sf):
    o = _table(spark, sf, "orders")
    table = o.select(F.col("o_orderpriority").alias("source_file"), F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "P", "tbd").alias("status"), F.when(F.col("o_custkey") % 4 != 0, "x").alias("instructor"), F.when(F.col("o_custkey") % 5 != 0, " ").otherwise("y").alias("location"))
    return quality.source_summary(table)


def _versions(spark, sf):
    c = _table(spark, sf, "customer").withColumn("ord", F.col("c_custkey"))
    base = c.select("ord", F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("source_file"), F.col("c_mktsegment").alias("a"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias("b"))
    expected = base.where("k % 7 <> 0")
    actual = base.where("k % 11 <> 0").withColumn("a", F.when(F.col("k") % 5 == 0, F.lower("a")).otherwise(F.col("a"))).withColumn("b", F.when(F.col("k") % 4 == 0, F.lit(None)).otherwise(F.col("b")))
    return expected, actual


def key_diff(spark, sf):
    labels, docs = _table(spark, sf, "labels").withColumn("ord", F.col("doc_id")), _table(spark, sf, "documents").withColumn("ord", F.col("doc_id"))
    return rows.compared(labels, docs, ["doc_id"], []).select("side", "doc_id")


def precision_recall(spark, sf):
    expected, actual = _versions(spark, sf)
    return rows.recall_precision(rows.compared(expected, actual, ["source_file", "k"], ["a", "b"]))


def field_mismatch(spark, sf):
    expected, actual = _versions(spark, sf)
    pairs = rows.compared(expected, actual, ["source_file", "k"], ["a", "b"])
    same = {f: F.col(f"e_{f}").eqNullSafe(F.col(f"a_{f}")) for f in ("a", "b")}
    return rows.mismatch_counts(rows.mismatches(pairs, same))


def set_ops(spark, sf):
    expected, actual = (df.select("k") for df in _versions(spark, sf))
    parts = [("both", expected.intersect(actual)), ("missing", expected.subtract(actual)), ("extra", actual.subtract(expected))]
    out = [df.select(F.lit(name).alias("side"), "k") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def lookup_default(spark, sf):
    fixes = spark.createDataFrame([("1-URGENT", "now"), ("5-LOW", "later")], "raw string, canonical string")
    o = rows.looked_up(_table(spark, sf, "orders"), "o_orderpriority", fixes, "raw", "canonical", "priority")
    return o.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def locations(spark, sf):
    s = _table(spark, sf, "supplier")
    name, branch = F.regexp_replace("s_name", "#0+", " - "), F.when(F.col("s_suppkey") % 3 == 0, "a").when(F.col("s_suppkey") % 3 == 1, " ")
    combined = tx.combined_location(name, branch)
    wanted = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), combined)).otherwise(F.lit(None))
    return s.select("s_suppkey", combined.alias("combined"), tx.locations_match(wanted, name, branch).alias("same"))


def _lines(spark, sf):
    return lines_of(_table(spark, sf, "documents"), "doc_id", "text")


def doc_lines(spark, sf):
    lines = extract.with_title(_lines(spark, sf))
    return lines.groupBy(F.col("source_file").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.min("center_name")).alias("title_md5"), F.sum(F.length("text")).alias("n_chars"))


def header_carry(spark, sf):
    short = F.length("text") < 40
    out = extract.carried(_lines(spark, sf), short, F.when(F.length("text") > 12, F.col("text")), "header").where(~short & F.col("header").isNotNull())
    return out.select(F.col("source_file").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), "header")


def gate(spark, sf):
    lines = extract.section(_lines(spark, sf), F.length("text") < 40, F.length("text") > 400)
    return lines.groupBy(F.col("source_file").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("n").cast("long").alias("first"), F.max("n").cast("long").alias("last"))


def lookahead(spark, sf):
    lines = extract.following(_lines(spark, sf), F.col("text"), "next").where((F.length("text") < 40) & (F.length("next") > 200))
    return lines.select(F.col("source_file").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), F.md5("next").alias("next_md5"))


def matrix_unpivot(spark, sf):
    ev = _table(spark, sf, "events")
    counts = ev.groupBy(F.dayofweek("ts").alias("d"), F.hour("ts").alias("h")).agg(F.count(F.lit(1)).cast("string").alias("text"))
    grid = counts.select(F.lit("g").alias("source_file"), F.lit(0).alias("table_no"), (F.col("h") + 1).alias("row_no"), F.col("d").alias("col_no"), "text")
    heads = ev.select(F.dayofweek("ts").alias("col_no"), F.date_format("ts", "E").alias("text")).distinct().select(F.lit("g").alias("source_file"), F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), "col_no", "text")
    sides = ev.select((F.hour("ts") + 1).alias("row_no"), F.date_format("ts", "HH").alias("text")).distinct().select(F.lit("g").alias("source_file"), F.lit(0).alias("table_no"), "row_no", F.lit(0).alias("col_no"), "text")
    out = extract.unpivoted(grid.unionByName(heads).unionByName(sides))
    return out.select(F.col("column_head").alias("weekday"), F.col("row_head").alias("hour"), F.col("text").cast("long").alias("n"))


def named_columns(spark, sf):
    o = _table(spark, sf, "orders")
    cells = o.select(F.lit("o").alias("source_file"), F.lit(0).alias("table_no"), (F.col("o_orderkey") + 1).cast("int").alias("row_no"), F.posexplode(F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"))).alias("col_no", "text"))
    heads = o.limit(1).select(F.lit("o").alias("source_file"), F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.posexplode(F.array(F.lit(" State"), F.lit("Priority  "), F.lit("Who"))).alias("col_no", "text"))
    wide = extract.named_rows(cells.unionByName(heads), {"State": "state", "Priority": "priority", "Who": "who"})
    return wide.select((F.col("row_no") - 1).cast("long").alias("o_orderkey"), "state", "priority", "who")


def adaptive_split(spark, sf):
    lines = _lines(spark, sf).where(F.length("text") > 0)
    parts = extract.adaptive_parts(F.col("text"))
    return lines.select(F.col("source_file").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), F.size(parts).cast("long").alias("n_parts"), F.get(parts, F.lit(0)).alias("head"))


def regex_fields(spark, sf):
    pages = _table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long")
    return pages.select("page_id", F.regexp_replace(host, "^(?:www|m|blog)[.]", "").alias("site"), number.alias("number"), F.get(F.split(host, "[.]", 2), F.lit(0)).alias("head"), F.startswith("url", F.lit("https:")).alias("secure"))


def display_line(spark, sf):
    p = _table(spark, sf, "part")
    c = {"name": F.col("p_name"), "day": F.col("p_type"), "start_time": F.lit("08:00"), "end_time": F.when(F.col("p_size") % 2 == 0, "09:00"), "center_name": F.col("p_brand"), "branch": F.when(F.col("p_size") % 3 == 0, "a"), "instructor": F.when(F.col("p_size") % 4 == 0, ""), "min_age": F.when(F.col("p_size") % 5 < 3, F.col("p_size")), "max_age": F.when(F.col("p_size") % 5 > 1, F.col("p_size") + 9), "status": F.when(F.col("p_size") % 6 == 0, "tbd").otherwise("active")}
    return p.select("p_partkey", search.display_line(c).alias("line"))


def audience_rule(spark, sf):
    p = _table(spark, sf, "part")
    table = spark.createDataFrame([("red ring", "mixed"), ("blue bolt", "women")], "name string, audience string")
    return rows.looked_up(p.withColumn("kind", F.lit("other")), "p_name", table, "name", "audience", "found").select("p_partkey", F.when(F.col("found") == F.col("p_name"), "other").otherwise(F.col("found")).alias("audience"))


def _understood_from(c):
    return c.select(
        "conv_id", "turn", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 7).cast("int")).alias("msg_date"), F.lit("other").alias("intent"), F.lit(False).alias("confident"),
        F.when(F.col("turn") % 2 == 0, "Mon").when(F.col("turn") % 3 == 0, "Wed").alias("day"), F.when(F.col("turn") % 3 == 1, "9:30").alias("start_after"), F.when(F.col("turn") % 3 == 1, "25:00").alias("start_before"),
        F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("center_name"), F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("location"), F.lit("ing").alias("branch"), F.lit("Ther").alias("instructor"),
    )


def _messages(spark, sf):
    return _understood_from(_table(spark, sf, "conversations"))


def message_rules(spark, sf):
    out = messages.understand(_messages(spark, sf), WORDS)
    return out.select("conv_id", "turn", "intent", "confident", "target_audience", "day", "start_after", "start_before", "center_name", "location", "branch", "instructor")


def merge_candidates(spark, sf):
    m = _messages(spark, sf)
    first = m.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "day", "start_after")
    second = m.where("turn > 1").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") == 2, "Fri").alias("day"), F.lit("7:00").alias("start_after"))
    return messages.filled(first, second, "id", ["day", "start_after"])


def routes(spark, sf):
    m = messages.understand(_messages(spark, sf), WORDS)
    to = messages.route(F.when(F.col("conv_id") % 9 != 0, F.col("text")), F.col("intent"), F.col("confident"), F.col("turn") == 5, F.col("turn") % 2 == 1)
    return m.groupBy(to.alias("route")).agg(F.count(F.lit(1)).alias("n"))


def lexicon_slots(spark, sf):
    lex = _table(spark, sf, "nation").select((F.col("n_nationkey") % 3).cast("string").alias("slot"), F.element_at(F.array(*[F.lit(w) for w in ("the", "and", "that", "der", "que", "con", "les", "und", "with", "of the", "and the", "in the")]), (F.col("n_nationkey") % 12 + 1).cast("int")).alias("variant"))
    lex = lex.distinct().withColumn("canonical", F.upper("variant"))
    found = messages.lexicon_slots(_table(spark, sf, "conversations"), ["conv_id", "turn"], lex)
    return found.select("conv_id", "turn", "slot", "canonical")


def conv_labels(spark, sf):
    c = _table(spark, sf, "conversations")
    kinds = F.when(tx.symbol_only(F.col("text")), "symbols").when(conversation.thanks_or_stop(F.col("text"), STOP), "stop").otherwise("message")
    cleared = conversation.cleared_fields(F.col("text"), CLEAR)
    may = conversation.may_follow_up(F.col("text"), F.col("turn") > 0, ["ered", "eau"])
    return c.select("conv_id", "turn", kinds.alias("label"), F.array_join(cleared, ",").alias("cleared"), may.alias("follow_up"), F.md5(tx.edge_stripped(tx.search_form(F.col("text")))).alias("core_md5"))


def _turns(rows):
    t = tx.search_form(F.col("text"))
    fresh = F.contains(t, F.lit("ation")) & (F.col("turn") > 0)
    return rows.select("conv_id", "turn", fresh.alias("new_query"), conversation.cleared_fields(F.col("text"), CLEAR).alias("cleared"), *slots_of(t))


def conv_state(spark, sf):
    out = conversation.carried_state(_turns(_table(spark, sf, "conversations")), _SLOTS, new_query=F.col("new_query"), cleared=F.col("cleared"))
    return out.select("conv_id", "turn", *[f"now_{s}" for s in _SLOTS])


def known_slots(spark, sf):
    out = conversation.carried_state(_turns(_table(spark, sf, "conversations")), _SLOTS, new_query=F.col("new_query"), cleared=F.col("cleared"))
    known = conversation.known_slots([f"now_{s}" for s in _SLOTS])
    return out.groupBy(F.array_join(known, ",").alias("known")).agg(F.count(F.lit(1)).alias("n"))


def paging_sessions(spark, sf):
    c = _table(spark, sf, "conversations")
    t = c.select("conv_id", "turn", (F.col("turn") % 4 == 0).alias("new_query"), (F.col("turn") % 4 != 0).alias("more"), F.when((F.col("turn") % 4 == 3) & (F.col("conv_id") % 3 == 0), "stop").otherwise("message").alias("label"), (F.length("text") % 23).alias("results"))
    return conversation.sessions(t).select("conv_id", "turn", "offset", "page_rows", "has_more")


def eval_score(spark, sf):
    done = eval_cases(spark, sf)
    return evalcases.score(done).select("total", "passed", "failed", F.round("score_percent", 6).alias("score_percent"))


def json_fields(spark, sf):
    parsed = F.from_json("props", "k long")
    return _table(spark, sf, "events").groupBy((parsed["k"] % 10).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.sum(parsed["k"]).alias("total"))


def stream_state(spark, sf):
    with jobs.state_store(spark):
        return _stream(spark, sf, "conversations", lambda source: jobs.conversation_stream(_turns(source), _SLOTS)).drop("late")


def stream_validate(spark, sf):
    check = [("late_hour", "error", F.hour("ts") >= 22), ("no_value", "warning", F.col("value") < 1.0)]
    found = _stream(spark, sf, "events", lambda s: jobs.validate_stream(s, check, ["event_id"]))
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


def stream_messages(spark, sf):
    found = _stream(spark, sf, "conversations", lambda s: jobs.understand_stream(_understood_from(s), WORDS))
    return found.select("conv_id", "turn", "intent", "confident", "target_audience", "day", "start_after", "start_before", "center_name", "location", "branch", "instructor")


def stream_search(spark, sf):
    path, n = shared_folder(spark, "stream"), F.col("n_nationkey")
    source = spark.readStream.schema(_table(spark, sf, "nation").schema).parquet(f"{sf}/nation.parquet*")
    asked = source.select(n.cast("long").alias("request_id"), F.when(n % 2 == 0, "economy").otherwise("small").alias("day"), (n * 2).alias("age"))
    each = jobs.search_stream(_parts_as_activities(spark, sf), f"{path}/out")
    asked.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("total"))


def stream_dedup(spark, sf):
    found = _stream(spark, sf, "events", lambda s: jobs.ingest_stream(s.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at")), ["user_id", "event_type"], "at", "10000 days"))
    return found.select("user_id", "event_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        norm_text, clean_placeholders, tolerant_search, batch_search, answer_text, age_summaries, all_places, deep_page, next_page, single_search, time_window, daypart_join, weekday_name, add_minutes, time_forms, infer_end,
        range_status, certainty_rank, page, dedup_first, dedup_last, dup_groups, profile, violations, verdict, source_summary, key_diff, precision_recall, field_mismatch, set_ops,
        lookup_default, locations, doc_lines, header_carry, gate, lookahead, matrix_unpivot, named_columns, adaptive_split, regex_fields, display_line, audience_rule, message_rules,
        merge_candidates, routes, lexicon_slots, conv_labels, conv_state, known_slots, paging_sessions, eval_cases, eval_score, json_fields, stream_state, stream_validate, stream_messages, stream_search,
        stream_dedup,
    )
    return {f.__name__: f for f in found} | layouts.queries() | chats.queries() | stores.queries() | reports.queries() | lookups.queries()
