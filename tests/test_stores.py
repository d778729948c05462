"""Versions of a table and arrays of records: switches, conflicts, streams, failures."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from taktwerk.sources import arrays, records, tables
from taktwerk.sources.versions import Conflict, Versions, with_current


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_a_reader_keeps_its_version(spark, folder):
    v = Versions(spark, f"file://{folder}/t")
    with pytest.raises(LookupError):
        v.read()
    assert v.publish(spark.range(5), "first") == 1
    old = v.read()
    assert v.publish(spark.range(3).withColumn("more", F.lit("ä")), after=1) == 2
    assert (old.count(), v.read().count(), v.read().columns, v.read(1).count()) == (5, 3, ["id", "more"], 5)
    assert (v.manifest(1).note, v.numbers()) == ("first", [1, 2])
    assert v.publish(spark.range(0)) == 3 and v.read().count() == 0


def test_of_two_writers_one_wins(spark, folder):
    v = Versions(spark, f"file://{folder}/t")
    v.publish(spark.range(1))
    v.publish(spark.range(2), after=1)
    with pytest.raises(Conflict):
        v.publish(spark.range(3), after=1)
    slow = Versions(spark, f"file://{folder}/t")
    # The slow writer has looked before the other published.
    slow.numbers = lambda: [1]
    with pytest.raises(Conflict):
        slow.publish(spark.range(4))
    assert v.numbers() == [1, 2] and v.read().count() == 2 and not [f for f in os.listdir(f"{folder}/t/manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_old_versions_go_with_their_files(spark, folder):
    v = Versions(spark, f"file://{folder}/t")
    for n in (1, 2, 3):
        v.publish(spark.range(n))
    v.switch(1)
    assert v.forget(2) == [1, 2] and v.numbers() == [3, 4] and v.read().count() == 1
    assert len(os.listdir(f"{folder}/t/files")) == 2


def test_a_view_follows_when_shown_again(spark, folder):
    v = Versions(spark, f"file://{folder}/t")
    v.publish(spark.range(5))
    assert v.show_as("shown") == 1
    v.publish(spark.range(7))
    assert spark.table("shown").count() == 5 and v.show_as("shown") == 2 and spark.table("shown").count() == 7


def test_a_stream_meets_the_new_version_in_its_next_batch(spark, folder):
    v = Versions(spark, f"file://{folder}/t")
    v.publish(spark.createDataFrame([(1, "old")], "k long, name string"))
    for n in (1, 2):
        spark.createDataFrame([(1, n)], "k long, n int").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def make(batch, held, number):
        batch.join(held, "k").withColumn("number", F.lit(number)).write.mode("append").parquet(f"{folder}/out")
        if number == 1:
            v.publish(spark.createDataFrame([(1, "new")], "k long, name string"))

    source = spark.readStream.schema("k long, n int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    source.writeStream.foreachBatch(with_current(v, make)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.name, r.number) for r in spark.read.parquet(f"{folder}/out").collect()) == [("new", 2), ("old", 1)]


def test_array_is_plain_json(spark, folder):
    rows = [(i, 'שלום "x"\n', None if i % 2 else 1.5, dt.datetime(2024, 1, 2, 3, 4, 5), [i]) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, s string, d double, t timestamp, a array<long>").repartition(7)
    path = f"file://{folder}/a.json"
    arrays.save_array(df, path, ["i"])
    text = open(f"{folder}/a.json", encoding="utf-8").read()
    assert json.loads(text) == [{"i": i, "s": s, "d": d, "t": "2024-01-02 03:04:05", "a": a} for i, s, d, _, a in rows] and "שלום" in text
    assert arrays.read_array(spark, path, "i long, s string, d double, t string, a array<long>").count() == 50
    arrays.save_array(df.where("i < 3"), path, ["i"], keep=["s", "i"])
    assert [list(r) for r in json.loads(open(f"{folder}/a.json", encoding="utf-8").read())] == [["s", "i"]] * 3
    arrays.save_array(df.where("false"), path, ["i"])
    assert json.loads(open(f"{folder}/a.json").read()) == [] and arrays.read_array(spark, path, "i long").count() == 0


def test_a_job_that_fails_leaves_the_old_file(spark, folder):
    path = f"file://{folder}/a.json"
    arrays.save_array(spark.range(3), path, ["id"])
    with pytest.raises(Exception, match="no good"):
        arrays.save_array(spark.range(9).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("no good"))).otherwise("y")), path, ["id"])
    assert [r["id"] for r in json.loads(open(f"{folder}/a.json").read())] == [0, 1, 2]
    assert not [f for f in os.listdir(folder) if f.startswith(".a.json-")]


def test_loose_records(spark):
    texts = [(1, '{"k": 3}'), (2, '{"k": "x"}'), (3, "{"), (4, None), (5, "7"), (6, ""), (7, '{"k": {"k": 1}}'), (8, "null")]
    got = records.loose(spark.createDataFrame(texts, "i int, raw string"), "raw", {"k": ("$.k", "int")}).orderBy("i").collect()
    assert [(r.state, r.k) for r in got] == [("object", 3), ("object", None), ("broken", None), ("null", None), ("other", None), ("broken", None), ("object", None), ("other", None)]


def test_scratch_removes_all_but_what_is_kept(spark):
    with tables.scratch(spark) as keep:
        gone, kept = tables.written(spark.range(3), "a"), keep(spark.range(4), "b")
        with tables.scratch(spark) as inner:
            mine = inner(spark.range(5), "c")
        assert (gone.count(), mine.count()) == (3, 5)
    assert kept.count() == 4
    for df in (gone, mine):
        with pytest.raises(Exception, match="(?i)not.*exist"):
            df.count()


def test_the_task_that_writes_an_array_sorts_nothing(spark, folder, monkeypatch):
    plans, kind = [], type(spark.range(1))
    whole = kind.coalesce
    monkeypatch.setattr(kind, "coalesce", lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, n))
    arrays.save_array(spark.range(5000).withColumn("s", F.lit("é")).repartition(5), f"file://{folder}/a.json", ["id"])
    assert [r["id"] for r in json.loads(open(f"{folder}/a.json", encoding="utf-8").read())] == list(range(5000))
    assert plans and not [p for p in plans if "Sort" in p]
