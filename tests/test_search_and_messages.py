"""Search, paging, quality, messages, conversations and cases on small tables."""

import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.operators import conversation as conv
from taktwerk.operators import evalcases, messages, quality, reports, rows, search
from taktwerk.schemas import ORDERED_ACTIVITY
from taktwerk.streaming import jobs


@pytest.fixture(scope="module")
def activities(spark):
    def row(ord_, name, day, start, **more):
        base = dict.fromkeys(f.name for f in ORDERED_ACTIVITY) | {"name": name, "day": day, "start_time": start, "ord": ord_, "source_file": "a.docx", "status": "active"} | more
        return tuple(base[f.name] for f in ORDERED_ACTIVITY)

    return spark.createDataFrame([
        row(1, "יוגה", "שלישי", "17:00", center_name="הדס", min_age=18),
        row(2, "יוגה זורמת", "שלישי", "18:00", center_name="מעיין", status=None),
        row(3, "זומבה", "שלישי", "18:30", status="cancelled"),
        row(4, "פילאטיס", "שני", "9:00", english_name="Pilates", min_age=10, max_age=16),
        row(5, "קרמיקה", "שלישי", None, source_file="a.xlsx", target_audience=rules.MIXED),
        row(6, "ג'ודו", "שלישי", "19:00", min_age=6, max_age=12),
    ], ORDERED_ACTIVITY).withColumn("category", search.category_of(F.lit(None).cast("string"), F.col("source_file")))


def ords(df):
    return [r.ord for r in df.collect()]


def test_single_search(activities):
    assert ords(search.search(activities, day="יום שלישי", start_after="17:00")) == [1, 2, 6]
    assert ords(search.search(activities, day="שלישי", age=20)) == [1, 2, 5]
    assert ords(search.search(activities, category="pilates class")) == [4]
    assert ords(search.search(activities, category="ספורט")) == [1, 2, 4, 6]
    assert ords(search.search(activities, start_before="9:00")) == [4]
    assert ords(search.search(activities, start_after="bad")) == []
    assert ords(search.search(activities, day=" ", with_cancelled=True)) == [1, 2, 3, 4, 5, 6]
    assert [r.age_match for r in search.search(activities, age=12).collect()] == ["match", "match", "unknown", "unknown"]


def test_many_searches_equal_single_ones(spark, activities, monkeypatch):
    asked = [(1, "יום שלישי", "17:00", None, None), (2, None, None, 12, None), (3, "שני", None, None, "יוגה"), (4, " ", None, None, "יוגה"), (5, None, None, None, None)]
    requests = spark.createDataFrame(asked, "request_id long, day string, start_after string, age int, category string")
    for parts in (32, 2):
        monkeypatch.setattr(search, "ALL_PARTS", parts)
        got = search.search_many(activities, requests).collect()
        for rid, day, after, age, category in asked:
            want = ords(search.search(activities, **{k: v for k, v in (("day", day), ("start_after", after), ("age", age), ("category", category)) if v is not None}))
            mine = sorted((r.place, r.ord) for r in got if r.request_id == rid)
            assert [o for _, o in mine] == want and all(r.total == len(want) for r in got if r.request_id == rid)


def test_pages_join_to_the_whole(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 12), (2, 5), (3, 6)) for i in range(n)], "k int, i int")
    seen = {}
    for offset in (0, 5, 10, 15):
        for r in search.page(df, ["k"], ["i"], offset).collect():
            seen.setdefault(r.k, []).append(r.i)
            assert r.has_more == ({1: 12, 2: 5, 3: 6}[r.k] > offset + 5)
    assert {k: sorted(v) for k, v in seen.items()} == {1: list(range(12)), 2: list(range(5)), 3: list(range(6))}


def test_display(activities):
    line = search.display_line({c: F.col(c) for c in activities.columns})
    assert [r.x for r in activities.where("ord in (1, 3, 4)").orderBy("ord").select(line.alias("x")).collect()] == [
        "יוגה — שלישי 17:00, מרכז: הדס, מגיל 18", "זומבה — שלישי 18:30, סטטוס: cancelled", "פילאטיס — שני 9:00, גיל 10–16",
    ]


def test_events_and_volunteering(spark):
    events = spark.createDataFrame([(1, "fair", "שני", "10:00", "ילדים", "x"), (2, "talk", "שני", "19:00", None, "y")], "ord long, name string, day string, start_time string, target_age_group string, location string")
    assert ords(search.search_events(events, day="שני", target_audience="ילדים")) == [1]
    posts = spark.createDataFrame([(1, "help", "שני", "10:00", 16), (2, "drive", "שני", "10:00", None)], "ord long, title string, day string, start_time string, min_age int")
    assert ords(search.search_volunteering(posts, volunteer_age=15)) == [2]
    assert ords(search.search_volunteering(posts, volunteer_age=17)) == [1, 2]


def test_row_rules_and_report(spark, activities):
    bad = spark.createDataFrame([(7, " ", "x", "25:00", "9:00", "-1", "200", "odd"), (8, "a", "שני", "10:00", "9:00", "9", "5", "ACTIVE ")], "ord long, name string, day string, start_time string, end_time string, min_age string, max_age string, status string")
    bad = bad.withColumns({c: F.lit(None).cast("string") for c in ("center_name", "instructor", "location", "target_audience", "branch")})
    found = quality.violations(bad, quality.activity_row_rules({c: F.col(c) for c in bad.columns}), ["ord"])
    by = {}
    for r in found.collect():
        by.setdefault(r.ord, set()).add(r.rule)
    common = {"center_empty", "instructor_empty", "location_empty"}
    assert by[7] == common | {"name_empty", "day_unknown", "start_invalid", "min_age_range", "max_age_range", "ages_crossed", "status_unknown"} - {"ages_crossed"}
    assert by[8] == common | {"end_not_after_start", "ages_crossed"}
    twice = activities.unionByName(activities.where("ord = 1").withColumn("ord", F.lit(9).cast("long")).withColumn("name", F.lit(" יוגה")))
    report = reports.validate(twice, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/r")
    summary = report.part("summary").first()
    assert (summary.status, summary.total_activities, summary.duplicate_groups) == ("FAIL", 7, 1)
    assert sorted(r.ord for r in report.part("duplicates").collect()) == [1, 9]
    assert {(s.column, s.value, s.n) for s in report.part("statistics").collect()} >= {("status", "missing", 1), ("missing:age_range", "missing", 3), ("day", "שלישי", 6)}


def test_dayparts_overlap(spark):
    df = spark.createDataFrame([(t,) for t in ("12:00", "17:00", "21:00", "23:59", "05:59")], "t string")
    got = {}
    for r in rows.with_dayparts(df, F.col("t")).collect():
        got.setdefault(r.t, set()).add(r.daypart)
    assert got == {"12:00": {"morning", "noon"}, "17:00": {"noon", "evening"}, "21:00": {"evening", "night"}, "23:59": {"evening", "night"}}


MESSAGES = [
    # text, candidates, expected
    ("אילו חוגים יש היום?", {}, {"intent": "activity", "confident": True, "day": "ראשון"}),
    ("אני רוצה משהו מחר", {"intent": "activity"}, {"intent": "unknown", "confident": False, "day": "שני"}),
    ("מה יש בערב?", {}, {"intent": "activity", "start_after": "17:00", "start_before": "23:59"}),
    ("שלום", {"intent": "x", "day": "שני"}, {"intent": "x", "day": None}),
    ("יוגה בשעה 18:30 אחרי 10:00", {}, {"start_after": "18:30", "start_before": "18:30"}),
    ("אחרי 17:00", {"start_before": "9:00"}, {"start_after": "17:00", "start_before": None}),
    ("בשעה 25:00 בבוקר", {}, {"start_after": "06:00", "start_before": "12:00"}),
    ("משהו", {"start_after": "9:00", "start_before": "9"}, {"start_after": "09:00", "start_before": None}),
    ("שלשי לנשים", {"day": "שלישי"}, {"day": "שלישי", "target_audience": "נשים"}),
    ("גברים ולנשים", {}, {"target_audience": "גם לגברים"}),
    ("מעיין בערב", {"center_name": "ערב"}, {"center_name": None}),
    ("מעיין", {"center_name": "מעיין", "location": "מרכז מעיין", "instructor": "דנה"}, {"center_name": "מעיין", "location": None, "instructor": None}),
    ("סניףא דנה", {"branch": "א", "instructor": "דנה", "location": "בריכה"}, {"branch": "א", "instructor": "דנה", "location": "בריכה"}),
]


def test_message_rules(spark):
    fields = ["intent", "confident", "day", "start_after", "start_before", "target_audience", "center_name", "location", "branch", "instructor"]
    schema = "n int, text string, msg_date date, " + ", ".join(f"{f} {'boolean' if f == 'confident' else 'string'}" for f in fields)
    data = [(n, text, datetime.date(2024, 1, 7), *[given.get(f) for f in fields]) for n, (text, given, _) in enumerate(MESSAGES)]
    got = {r.n: r for r in messages.understand(spark.createDataFrame(data, schema)).collect()}
    for n, (text, _, want) in enumerate(MESSAGES):
        assert {k: got[n][k] for k in want} == want, text


def test_lexicon_with_names_of_several_words(spark):
    msgs = spark.createDataFrame([(1, "Lessons at the North  Pool, today"), (2, "the pool"), (3, "north of the pool"), (4, None), (5, "nort pool")], "id long, text string")
    lex = spark.createDataFrame([("centre", "north pool", "North Pool"), ("centre", "pool", "Pool"), ("centre", "", "none")], "slot string, variant string, canonical string")
    assert {r.id: r.canonical for r in messages.lexicon_slots(msgs, ["id"], lex).collect()} == {1: "North Pool", 2: "Pool", 3: "Pool", 5: "Pool"}
    assert {r.id for r in messages.lexicon_slots(msgs, ["id"], lex.where("variant = 'north pool'"), near=True).collect()} == {1, 5}


def test_lexicon_with_misspellings(spark):
    msgs = spark.createDataFrame([(1, "פילאטיס ביום רבעי"), (2, "פלאטיס"), (3, "כדור")], "id int, text string")
    lex = spark.createDataFrame([("day", "רביעי", "רביעי"), ("category", "פילאטיס", "pilates")], "slot string, variant string, canonical string")
    near = {(r.id, r.slot): r.canonical for r in messages.lexicon_slots(msgs, ["id"], lex, near=True).collect()}
    assert near == {(1, "day"): "רביעי", (1, "category"): "pilates", (2, "category"): "pilates"}
    assert messages.lexicon_slots(msgs, ["id"], lex).count() == 1


def test_labels(spark):
    texts = ["?!", "שלום!", "תודה רבה", "לא צריך", "יוגה", "עוד", "כן בבקשה", "לא עוד", None, "בלי מרכז וכל שעה, כל שעה"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = df.select("i", conv.label(x).alias("label"), conv.wants_more(x).alias("more"), conv.wants_no_more(x).alias("no_more"), conv.cleared_fields(x).alias("clear")).orderBy("i").collect()
    assert [r.label for r in got] == ["symbols", "greeting", "thanks", "stop", "message", "message", "message", "message", "symbols", "message"]
    assert [r.more for r in got] == [False, False, False, False, False, True, True, False, False, False]
    assert [r.no_more for r in got][2:8] == [True, True, False, False, False, True]
    assert got[9].clear == ["center_name", "time"]
    full = df.select("i", conv.completed(x).alias("q")).orderBy("i").collect()
    assert full[4].q == "אילו חוגים יש יוגה?"


def test_request_text(spark):
    df = spark.createDataFrame([("יוגה", "שני", "17:00", None), ("יוגה", None, "9:00", "9:00"), (None, "שני", None, None)], "category string, day string, start_after string, start_before string")
    text = conv.request_text({c: F.col(c) for c in df.columns})
    assert [r.x for r in df.select(text.alias("x")).collect()] == ["אילו חוגים יש יוגה שני אחרי 17:00?", "אילו חוגים יש יוגה בשעה 9:00?", "אילו חוגים יש שני?"]


TURNS = [
    (1, 0, True, [], "mon", None, "a", "b"), (1, 1, False, [], None, "yoga", None, None), (1, 2, False, [], None, None, None, "c"), (1, 3, False, ["time", "day"], "tue", None, None, None),
    (1, 4, True, [], None, "judo", None, None), (2, 0, True, None, None, None, None, None), (2, 1, False, [], "sun", None, "z", None),
]
TURN_SCHEMA = "conv_id long, turn long, new_query boolean, cleared array<string>, day string, category string, start_after string, start_before string"
SLOTS = ["day", "category", "start_after", "start_before"]
STATES = [
    (1, 0, "mon", None, "a", "b"), (1, 1, "mon", "yoga", "a", "b"), (1, 2, "mon", "yoga", None, "c"), (1, 3, "tue", "yoga", None, None), (1, 4, None, "judo", None, None),
    (2, 0, None, None, None, None), (2, 1, "sun", None, "z", None),
]


def test_carried_state(spark):
    turns = spark.createDataFrame(TURNS, TURN_SCHEMA)
    out = conv.carried_state(turns, SLOTS, new_query=F.col("new_query"), cleared=F.col("cleared"))
    assert sorted(tuple(r) for r in out.select("conv_id", "turn", *[f"now_{s}" for s in SLOTS]).collect()) == STATES


def test_stream_state_equals_batch_state(spark, tmp_path):
    """Three batches with turns out of order, and one that comes late."""
    spark.conf.set(*jobs.STATE_STORE)
    source, out = tmp_path / "in", tmp_path / "out"
    late = (1, 0, False, [], "late", None, None, None)
    stream = None
    for k, part in enumerate((TURNS[1::-1] + TURNS[5:6], TURNS[3:1:-1] + TURNS[6:], [late, TURNS[4]])):
        spark.createDataFrame(part, TURN_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        turns = spark.readStream.schema(TURN_SCHEMA).parquet(str(source))
        stream = jobs.conversation_stream(turns, SLOTS).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()
    got = spark.read.parquet(str(out)).collect()
    assert sorted((r.conv_id, r.turn, *[r[f"now_{s}"] for s in SLOTS]) for r in got if not r.late) == STATES
    assert [(r.turn, r.now_day) for r in got if r.late] == [(0, "tue")]


def test_sessions(spark):
    turns = [(1, 0, True, False, "message", 12), (1, 1, False, True, "message", 0), (1, 2, False, True, "message", 0), (1, 3, False, True, "message", 0), (1, 4, False, False, "thanks", 0), (1, 5, False, True, "message", 0)]
    out = conv.sessions(spark.createDataFrame(turns, "conv_id int, turn int, new_query boolean, more boolean, label string, results int")).orderBy("turn").collect()
    assert [(r.offset, r.page_rows, r.has_more) for r in out] == [(0, 5, True), (5, 5, True), (10, 2, False), (12, 0, False), (0, 0, False), (0, 0, False)]


def test_cases(spark):
    from taktwerk.schemas import EVAL_CASE

    case = lambda i, **e: (i, "", "", tuple(e.get(k) for k in ("intent", "day", "start_after", "start_before", "target_audience", "age", "category_contains", "center_contains", "instructor_contains", "min_results", "exact_results", "must_contain", "must_not_contain", "allow_clarification")))
    cases = spark.createDataFrame([case("a", day="שני", min_results=2), case("b", day="שני", category_contains="YOGA", must_contain=["x"], must_not_contain=["y"]), case("c", allow_clarification=True), case("d", exact_results=0), case("e")], EVAL_CASE)
    seen = F.struct(F.when(F.col("id") == "a", "שני").alias("day"), F.lit("yoga class").alias("category"), F.lit("X y").alias("final_answer"), F.lit("other").alias("intent"), F.lit(False).alias("waiting_for_clarification"))
    results = spark.createDataFrame([("a",), ("a",), ("d",)], "id string")
    done = evalcases.evaluate(evalcases.result_counts(cases.withColumn("observed", seen).withColumn("error", F.when(F.col("id") == "e", "boom")), results))
    failures = {r.id: r.failures for r in done.collect()}
    assert failures["a"] == [] and len(failures["b"]) == 2 and len(failures["c"]) == 1 and len(failures["d"]) == 1 and failures["e"] == ["run failed: boom"]
    total = evalcases.score(done).first()
    assert (total.total, total.passed, total.failed, total.score_percent) == (5, 1, 4, 20.0)


def test_the_activities_of_a_search_are_not_sent_to_all_tasks(spark, sf_dir, monkeypatch):
    from taktwerk.plans import common

    made = []
    for most in (50_000, 0):
        monkeypatch.setattr(search, "SENT_KEYS", most)
        found = search.matches(common.parts_as_activities(spark, sf_dir), common.requests(spark, sf_dir))
        made.append(sorted((r.request_id, r.ord, r.age_match) for r in found.select("request_id", "ord", "age_match").collect()))
        # A file that is small for being compressed once had its exploded rows collected by the driver.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BroadcastExchange" in plan) == (most > 0)
    assert made[0] == made[1] and made[0]
