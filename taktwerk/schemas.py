"""Declared schemas."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_NUMBERS = {"min_age", "max_age", "capacity"}
ACTIVITY_COLUMNS = [
    "source_file", "center_name", "branch", "day", "raw_day", "start_time", "end_time", "end_time_source", "raw_time", "name", "raw_name", "english_name", "instructor",
    "location", "target_audience", "min_age", "max_age", "level", "capacity", "status", "season", "valid_from", "notes", "source_language",
]
ACTIVITY = StructType([StructField(c, IntegerType() if c in _NUMBERS else StringType()) for c in ACTIVITY_COLUMNS])
#: With the order of ingestion.
ORDERED_ACTIVITY = StructType([*ACTIVITY.fields, StructField("ord", LongType())])

ACTIVITY_SYNTH = "id string, name string, category string, age_group string, day string, start_time string, end_time string, min_age int, max_age int, price int, instructor string, location string"
EVENT = "id string, name string, date string, day string, start_time string, end_time string, target_age_group string, price int, location string"
VOLUNTEER = "id string, title string, day string, start_time string, end_time string, min_age int, location string, contact_person string"
PARAGRAPH = "source_file string, n int, text string"
CELL = "source_file string, table_no int, row_no int, col_no int, text string"
GROUND_TRUTH_COLUMNS = {
    "קובץ_מקור": "source_file", "שם_המרכז": "center_name", "יום": "day", "שעת_התחלה": "start_time", "שעת_סיום": "end_time", "שם_החוג": "name", "שם_בקובץ": "raw_name",
    "שם_באנגלית": "english_name", "מדריך": "instructor", "אולם": "location", "קהל_יעד": "target_audience", "הערות": "notes", "מלכודת_בדיקה": "trap",
}
EVAL_CASE = (
    "id string, description string, query string, expected struct<intent:string, day:string, start_after:string, start_before:string, target_audience:string, age:int, "
    "category_contains:string, center_contains:string, instructor_contains:string, min_results:int, exact_results:int, must_contain:array<string>, "
    "must_not_contain:array<string>, allow_clarification:boolean>"
)
