"""Reports, intervals, rules and names against plain Python."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import evalcases, intervals, lexicon, messages, reports, rows
from taktwerk.plans import common
from taktwerk.streaming import jobs


def test_first_of_each_and_how_many_more(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("b", 2)], "k string, i long").repartition(6)
    got = sorted((r.k or "", r.i, r.place, r.more) for r in reports.first_of(df, ["k"], ["i"], 3).collect())
    assert got == [("", 1, 1, 0), ("a", 0, 1, 47), ("a", 1, 2, 47), ("a", 2, 3, 47), ("b", 2, 1, 0)]
    plan = reports.first_of(df, ["k"], ["i"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_members_of_groups_row_by_row(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "X ", None), (3, "y", "z"), (4, None, None), (5, None, None)], "ord long, a string, b string")
    got = sorted(map(tuple, reports.duplicate_members(df, [F.lower(F.trim("a")), F.col("b")], F.concat(F.lit("#"), "ord")).collect()))
    assert got == [(1, 2, 1, "#1"), (1, 2, 2, "#2"), (4, 2, 4, "#4"), (4, 2, 5, "#5")]
    assert "collect" not in reports.duplicate_members(df, [F.col("a")], F.col("b"))._jdf.queryExecution().executedPlan().toString()


def test_validation_report_in_parts(spark, sf_dir):
    orders = common.order_rows(spark, sf_dir).withColumn("branch", F.lit(None).cast("string")).withColumn("target_audience", F.lit("x"))
    report = reports.validate(orders, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/r")
    summary, found = report.part("summary").first(), report.part("findings")
    assert summary.total_activities == orders.count() and summary.critical_errors == found.where("severity = 'error'").count() and summary.status == "FAIL"
    assert summary.duplicate_groups == report.part("duplicates").select("first").distinct().count()
    assert report.shown(2).count() == 4 and report.part("statistics").count() > 0
    clean = reports.validate(orders.where("false"), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/r").part("summary").first()
    assert (clean.total_activities, clean.critical_errors, clean.warnings, clean.duplicate_groups, clean.status) == (0, 0, 0, 0, "PASS")


def test_case_report_as_two_arrays(spark):
    cases = spark.createDataFrame(
        [(2, "q2", 0.25, ("activity",), ("other", 7), 1), (1, "q1", 0.5, ("activity",), ("activity", None), 0)],
        "id long, query string, duration double, expected struct<intent:string>, observed struct<intent:string, age:int>, result_count long",
    )
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    reports.save_cases(evalcases.evaluate(cases), f"file://{folder}")
    summary, results = (json.load(open(f"{folder}/{n}.json", encoding="utf-8")) for n in ("summary", "results"))
    assert summary == [{"passed": 1, "failed": 1, "total": 2, "score": 50.0, "total_duration": 0.75}]
    assert [(r["id"], r["passed"], len(r["failures"]), r["observed"]["age"], r["observed"]["result_count"]) for r in results] == [(1, True, 0, None, 0), (2, False, 1, 7, 1)]


def test_intervals_of_any_length(spark):
    lot = random.Random(1)
    spans = [(i, lot.randrange(-500, 500), lot.randrange(-500, 900), lot.randrange(2)) for i in range(80)] + [(90, None, 5, 0), (91, 5, None, 1)]
    points = [(i, lot.randrange(-600, 900), lot.randrange(2)) for i in range(300)] + [(900, None, 1)]
    a, b = spark.createDataFrame(points, "p long, v long, s long"), spark.createDataFrame(spans, "i long, lo long, hi long, t long")
    for width in (1, 37, 10_000):
        met = intervals.in_intervals(a, F.col("v"), b, "lo", "hi", width, {"s": "t"})
        want = sorted((p, i) for p, v, s in points for i, lo, hi, t in spans if None not in (v, lo, hi) and lo <= v <= hi and s == t)
        assert sorted((r.p, r.i) for r in met.select("p", "i").collect()) == want
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_rules_with_open_keys(spark):
    lot = random.Random(4)
    rule = [(lot.choice([None, "a", "b"]), lot.choice([None, 1, 2]), lot.randrange(6), lot.choice([None, *range(9)])) for _ in range(25)]
    facts = [(i, lot.choice(["a", "b", "c", None]), lot.choice([1, 2, 3, None])) for i in range(60)]
    df = spark.createDataFrame(facts, "id long, k string, n long")
    for held in (rule, [r for r in rule if r[0] is not None and r[1] is not None], []):
        table = spark.createDataFrame(held, "k string, n long, p long, v long")
        got = {r.id: r.v for r in intervals.first_rule(df, table, ["k", "n"], "p", "v", "v").collect()}
        for i, k, n in facts:
            fit = [(p, v is not None, v) for rk, rn, p, v in held if (rk is None or rk == k) and (rn is None or rn == n)]
            assert got[i] == (min(fit, key=lambda x: (x[0], x[1], x[2] or 0))[2] if fit else None)


def test_dayparts_are_a_table(spark):
    df = spark.createDataFrame([(1, "11:59"), (2, "12:00"), (3, "22:00"), (4, "bad")], "i long, t string")
    got = sorted((r.i, r.daypart) for r in rows.with_dayparts(df, F.col("t")).collect())
    assert got == [(1, "morning"), (2, "morning"), (2, "noon"), (3, "evening"), (3, "night")]
    own = rows.dayparts(spark, [("late", "22:00", "23:00")])
    assert [tuple(r) for r in rows.with_dayparts(df, F.col("t"), own).select("i", "daypart").collect()] == [(3, "late")]


LEX = [("center", "הדס", "הדס"), ("center", "alon grove", "alonim"), ("day", "mon", "monday"), ("kind", "yoga", "yoga"), ("kind", "power yoga", "power yoga"), ("kind", " Zumba! ", "zumba")]


@pytest.mark.parametrize(
    ("text", "near", "want"),
    [
        ("מה יש בהדס ביום", False, {("center", "הדס", 0, 1)}), ("כשבהדס", False, {("center", "הדס", 0, 3)}), ("שהדסה", True, set()), ("יוגהדס", False, set()),
        ("Power  Yoga, on MON", False, {("kind", "power yoga", 0, 0), ("day", "monday", 0, 0)}), ("yogaa zumb", True, {("kind", "zumba", 1, 0)}), ("yogaa", True, {("kind", "yoga", 1, 0)}),
        ("yogaa", False, set()), ("alongrove", True, {("center", "alonim", 1, 0)}), ("mom", True, set()), ("", True, set()), (None, True, set()), ("poweryoga", True, {("kind", "power yoga", 1, 0)}),
    ],
)
def test_names_in_texts(spark, text, near, want):
    df = spark.createDataFrame([(1, text, "x")], "id long, text string, slot string").drop("slot")
    got = {(r.slot, r.canonical, r.off, r.cut) for r in lexicon.mentions(df, ["id"], spark.createDataFrame(LEX, "slot string, variant string, canonical string"), near).collect()}
    assert got == want


def test_tree_and_join_find_the_same_names(spark, sf_dir):
    """Without prefixes the walked tree and the join of pieces agree, exact and with a letter off."""
    talk = common.table(spark, sf_dir, "conversations").limit(60).select("conv_id", "turn", "text").persist()
    lex = spark.createDataFrame([(s, v, v) for s, v in (("a", "thing"), ("a", "ation"), ("b", "und der"), ("b", "que la"), ("c", "with"), ("c", "that"))], "slot string, variant string, canonical string")
    for near in (False, True):
        tree = {(r.conv_id, r.turn, r.slot, r.canonical) for r in lexicon.mentions(talk, ["conv_id", "turn"], lex, near, prefixes="").collect()}
        join = {tuple(r) for r in messages.lexicon_slots(talk, ["conv_id", "turn"], lex, near).select("conv_id", "turn", "slot", "canonical").collect()}
        assert tree == join and tree


def test_a_lexicon_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_NAMES", 2)
    with pytest.raises(ValueError, match="lexicon_slots"):
        lexicon.mentions(spark.createDataFrame([(1, "x")], "id long, text string"), ["id"], spark.createDataFrame(LEX, "slot string, variant string, canonical string"))


def test_first_by_order_on_a_stream(spark):
    """Repeats that arrive in any order over several batches leave the least; the last record closes all groups."""
    base, lot = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), random.Random(6)
    facts = [(f"k{lot.randrange(8)}", n, 1_000_000 + lot.randrange(500)) for n in range(60)]
    lot.shuffle(facts)
    schema = "k string, ord long, at timestamp"
    make = lambda part: spark.createDataFrame(part, "k string, ord long, s long").select("k", "ord", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    for part in (facts[:20], facts[20:40], facts[40:], [("closing", -1, 9_000_000)]):
        make(part)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        out = jobs.first_by_order_stream(source, ["k"], "ord", "at", "1 hour", "1 hour")
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, r.ord) for r in spark.read.parquet(f"{base}/out").collect())
    want = rows.keep_first(spark.createDataFrame(facts, "k string, ord long, s long"), ["k"])
    assert got == sorted((r.k, r.ord) for r in want.collect())


def test_equal_ranks_on_a_stream_go_by_number(spark):
    from taktwerk.plans import reports as plans

    for order in ("event_id", "event_id desc"):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        ids = spark.createDataFrame([(0,), (3,), (3 + 10_007,), (3 + 3 * 10_007,)], "event_id long").orderBy(F.expr(order.split()[0]).desc() if "desc" in order else F.col(order))
        events = ids.select("event_id", F.lit(7).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
        events.coalesce(1).write.parquet(f"{folder}/events.parquet")
        assert [tuple(r) for r in plans.stream_first(spark, folder).collect()] == [(7, "view", 3)]
