"""The index of pieces, places over ranges and pages, against plain Python."""

import random

from pyspark.sql import functions as F

from taktwerk.operators import index, ranking, search
from taktwerk.plans import queries


def pairs(spark, needles, hays):
    frame = lambda texts: spark.createDataFrame([(k, t) for k, t in texts], "kind string, text string")
    return sorted(map(tuple, index.contained_pairs(frame(needles), frame(hays)).collect()))


def test_contained_pairs(spark):
    lot = random.Random(2)
    texts = sorted({"".join(lot.choice("abc ") for _ in range(lot.randrange(9))) for _ in range(150)} | {"", "a", "שלום", "ש", "aaaaaaaaaaaaaaaaaaaa"})
    needles, hays = [("x", t) for t in texts] + [("y", "ab")], [("x", t) for t in reversed(texts)] + [("y", "cab"), ("y", "b")]
    assert pairs(spark, needles, hays) == sorted((k, a, b) for k, a in needles for j, b in hays if k == j and a in b)
    assert pairs(spark, [], hays) == [] and pairs(spark, needles, []) == []


def test_places_of_a_hot_group_fill_many_tasks(spark):
    """One group has most rows; its places are a window's, and no range has all of it."""
    rows = [("hot" if i % 10 else None if i % 20 else "cold", i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    out = ranking.ranked(df, ["k"], ["v", "i"])
    got = {(r.k, r.i): (r.place, r.total) for r in out.collect()}
    for k in ("hot", None, "cold"):
        mine = sorted((v, i) for kk, v, i in rows if kk == k)
        assert [got[k, i] for _, i in mine] == [(n, len(mine)) for n in range(1, len(mine) + 1)]
    places = ranking.kept_in_order(out, ["k"])
    hot = places.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 900
    page = ranking.page_at(places, 895, 10).collect()
    assert sorted(r.place for r in page) == list(range(896, 901)) and {(r.next_offset, r.has_more) for r in page} == {(900, False)}
    down = ranking.ranked(df, ["k"], ["v", "i"], descending=("v",)).where("k = 'cold'").orderBy("place").collect()
    assert [(r.v, r.i) for r in down] == sorted(((v, i) for kk, v, i in rows if kk == "cold"), key=lambda x: (-x[0], x[1]))


def test_a_page_reads_the_files_that_hold_it(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), "id")
    places = ranking.kept_in_order(ranking.ranked(df, ["k"], ["id"]), ["k"])
    page = ranking.page_at(places, 3990, 5)
    assert sorted(r.id for r in page.collect()) == list(range(3990, 3995))
    assert "GreaterThan(place,3990)" in page._jdf.queryExecution().executedPlan().toString()


def test_no_places_without_rows(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert ranking.ranked(empty, ["k"], ["v"]).count() == 0


def test_next_page_by_values(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a long, b long")
    assert [tuple(r) for r in ranking.page_after(df, ["a", "b"], [1, 2], 4).collect()] == [(1, 3), (2, 0), (2, 1), (2, 2)]


def test_search_meets_by_equal_keys_only(spark, sf_dir):
    for df in (queries.batch_search(spark, sf_dir), queries.age_summaries(spark, sf_dir), queries.all_places(spark, sf_dir)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = queries.batch_search(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_requests_of_every_kind_against_every_row(spark):
    """Each request by itself, by the plain conditions, and all together by the index."""
    lot = random.Random(8)
    words = ["Yoga", "yoga  for all", "all", "", " ", "Red Ring", "ring", "שני", "יום שני", None]
    acts = [
        (i, lot.choice(words), lot.choice(words), lot.choice(words), lot.choice(words), lot.choice(["9:00", "09:30", "17:00:00", "bad", None, "23:59"]), lot.choice([None, "6", "12.0", "40"]),
         lot.choice([None, "10", "18", "130"]), lot.choice([None, "active", "cancelled"])) for i in range(120)
    ]
    activities = spark.createDataFrame(acts, "ord long, name string, english_name string, category string, day string, start_time string, min_age string, max_age string, status string")
    asked = [
        (i, lot.choice([None, *words]), lot.choice([None, None, *words]), lot.choice([None, None, "9:15", "nine"]), lot.choice([None, None, "20:00", "8:00", "x"]), lot.choice([None, None, 5, 12, 200])) for i in range(40)
    ] + [(90, None, None, None, None, None), (91, "nothing like it", None, None, None, None)]
    requests = spark.createDataFrame(asked, "request_id long, category string, day string, start_after string, start_before string, age int")
    want = {}
    a, q = activities.alias("a"), requests.alias("q")
    row = {c: F.col(f"a.{c}") for c in activities.columns} | {c: F.lit(None).cast("string") for c in search.TEXT_FILTERS if c not in activities.columns}
    ok = search.conditions(row, {c: F.col(f"q.{c}") for c in requests.columns if c != "request_id"})
    for r in a.crossJoin(q).where(ok).select("request_id", "ord").collect():
        want.setdefault(r.request_id, set()).add(r.ord)
    got = {}
    for r in search.search_many(activities, requests).collect():
        assert r.ord not in got.setdefault(r.request_id, {})
        got[r.request_id][r.ord] = (r.place, r.total)
    assert [(k, asked[k] if k < 40 else k, set(got.get(k, ())) ^ want.get(k, set())) for k in {*got, *want} if set(got.get(k, ())) != want.get(k, set())] == []
    assert len(want[90]) > 60
    for k, v in got.items():
        assert sorted(p for p, _ in v.values()) == list(range(1, len(v) + 1)) and {t for _, t in v.values()} == {len(v)}
    first = search.search_many(activities, requests, first=3).collect()
    assert {(r.request_id, r.ord): (r.place, r.total) for r in first} == {(k, o): p for k, v in got.items() for o, p in v.items() if p[0] <= 3}
