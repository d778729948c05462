"""Column functions on the corners of their inputs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions import text as tx
from taktwerk.functions import timeofday as td
from taktwerk.functions.ages import age_bound, age_status, certainty, strict_int


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def X():  # noqa: N802
    return F.col("x")



def test_clean_and_search_forms(spark):
    assert values(spark, tx.clean_text(X()), [None, "", " \t ", "—", "-", "יתעדכן", " a  b "]) == [None, None, None, None, None, None, "a b"]
    assert values(spark, tx.search_form(X()), [None, " A \n b"]) == ["", "a b"]
    assert values(spark, tx.nullified(X()), [" ", " a ", None]) == [None, "a", None]
    assert values(spark, tx.edge_stripped(X()), ["?!שלום...", "a-b", '"x"']) == ["שלום", "a-b", "x"]
    assert values(spark, tx.symbol_only(X()), ["?!", "א", "", None, "1"]) == [True, False, True, True, False]
    assert values(spark, tx.center_reference(X()), ["מרכז הספורט  הדס", "מרכז מעיין", "הדס", '"הדס"']) == ["הדס", "מעיין", "הדס", "הדס"]
    assert values(spark, tx.unified_location(X()), ["a - b", " ", None]) == ["a – b", None, None]
    assert values(spark, tx.unified_audience(X()), ["Women only", "mixed", " other ", None]) == [rules.WOMEN, rules.MIXED, "other", None]


@pytest.mark.parametrize(
    ("value", "wanted", "ok"),
    [(None, None, True), (None, "a", False), (None, "", False), ("", "a", True), ("a", "", True), ("Yoga  class", "yoga", True), ("yoga", "the yoga class", True), ("x", "y", False), ("a b", "A b", True)],
)
def test_tolerant_match(spark, value, wanted, ok):
    df = spark.createDataFrame([(value, wanted)], "v string, w string")
    assert df.select(tx.tolerant_match(F.col("v"), F.col("w"))).first()[0] is ok


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aA \t —-", max_size=8), min_size=1, max_size=8))
def test_cleaning_twice_is_cleaning_once(spark, texts):
    assert values(spark, tx.clean_text(tx.clean_text(X())), texts) == values(spark, tx.clean_text(X()), texts)
    assert values(spark, tx.search_form(tx.search_form(X())), texts) == values(spark, tx.search_form(X()), texts)


def test_times(spark):
    inputs = ["8.00", "19.10", "7:00 בערב", "12:00 בערב", "7:40 AM", "12:05 am", "6:05 PM", "12:05 PM", "24:00", "123:45", "at 9:30!", None, "—", "בערב"]
    assert values(spark, td.canonical_time(X()), inputs) == ["08:00", "19:10", "19:00", "12:00", "07:40", "00:05", "18:05", "12:05", None, None, "09:30", None, None, None]
    spans = values(spark, td.time_range(X()), ["17:00-18:00", "8.00 – 9.15", "7:00", "6:05 PM - 7:00 PM", None])
    assert [(s.start, s.end) if s else None for s in spans[:4]] == [("17:00", "18:00"), ("08:00", "09:15"), ("07:00", None), ("18:05", "19:00")]
    inputs = ["8:05", "08:05", "08:05:30", "2026-03-01 08:05:00", "8:05 abc", "24:00", "", None]
    assert values(spark, td.seconds_of(X()), inputs) == [29100, 29100, 29130, 29100, 29100, None, None, None]
    assert values(spark, td.strict_seconds(X()), inputs) == [29100, 29100, 29130, None, None, None, None, None]
    assert values(spark, td.add_minutes(X(), F.lit(55)), ["23:30", "08:00", "25:00", None]) == ["00:25", "08:55", None, None]
    assert values(spark, td.add_minutes(X(), F.lit(None)), ["23:30"]) == [None]
    assert values(spark, td.at_or_after(X(), F.lit("8:05")), ["8:05", "8:04", None, "x"]) == [True, False, False, False]
    assert values(spark, td.canonical_day(X()), ["Sunday", "יום שני", "שבת", "someday", None]) == ["ראשון", "שני", "שבת", "someday", None]
    assert values(spark, td.weekday_of(X().cast("date")), ["2024-01-07", "2024-01-13"]) == ["ראשון", "שבת"]
    assert values(spark, td.status_of(X()), [None, "", "שיעור בוטל", "יתעדכן", "CANCELLED", "x"]) == ["active", "active", "cancelled", "tbd", "cancelled", "active"]
    assert values(spark, td.valid_clock(X()), ["9:30", "25:00", "9:3", None]) == ["09:30", None, None, None]


def test_ages(spark):
    inputs = ["16", "16.0", "16.5", "-1", "16d", "nan", "", None, " 7 "]
    assert values(spark, age_bound(X()), inputs) == [16, 16, None, None, None, None, None, None, 7]
    assert values(spark, strict_int(X()), inputs) == [16, None, None, -1, None, None, None, None, 7]
    df = spark.createDataFrame([(None, None, 5), ("6", None, 5), (None, "9", 5), ("3", "4", 5), ("3", "9", 5), ("3", "9", None)], "lo string, hi string, age int")
    got = [r.s for r in df.select(age_status(F.col("lo"), F.col("hi"), F.col("age")).alias("s")).collect()]
    assert got == ["unknown", "no_match", "match", "no_match", "match", None]
    assert values(spark, certainty(X()), ["match", "unknown", "no_match", None]) == [0, 1, 2, 3]


def test_white_space_of_any_kind_around_times(spark):
    odd = ["\t9:30", "9:30\n", "  9:30 \r\n", "\n", None]
    assert values(spark, td.seconds_of(X()), odd) == [34_200, 34_200, 34_200, None, None]
    assert values(spark, td.strict_seconds(X()), odd) == [34_200, 34_200, 34_200, None, None]
    assert values(spark, td.valid_clock(X()), odd) == ["09:30", "09:30", "09:30", None, None]
