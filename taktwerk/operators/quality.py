"""Row rules, profiles and the verdict on an activity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.ages import strict_int
from taktwerk.functions.text import is_blank, search_form
from taktwerk.functions.timeofday import strict_seconds
from taktwerk.operators.rows import duplicate_groups

#: The columns that make two activities the same, compared in search form.
SAME_ACTIVITY = ["center_name", "branch", "day", "start_time", "end_time", "name", "instructor", "location"]

Rule = tuple[str, str, Column]


def activity_row_rules(c: dict[str, Column]) -> list[Rule]:
    """Name, severity and condition of every rule."""
    start, end = strict_seconds(c["start_time"]), strict_seconds(c["end_time"])
    out: list[Rule] = [
        ("name_empty", "error", is_blank(c["name"])),
        ("center_empty", "error", is_blank(c["center_name"])),
        ("day_empty", "error", is_blank(c["day"])),
        ("day_unknown", "error", ~is_blank(c["day"]) & ~F.trim(c["day"]).isin(*rules.WEEKDAYS)),
        ("start_empty", "error", is_blank(c["start_time"])),
        ("start_invalid", "error", ~is_blank(c["start_time"]) & start.isNull()),
        ("end_empty", "warning", is_blank(c["end_time"])),
        ("end_invalid", "error", ~is_blank(c["end_time"]) & end.isNull()),
        ("end_not_after_start", "warning", end <= start),
    ]
    ages = {side: strict_int(c[side]) for side in ("min_age", "max_age")}
    for side, age in ages.items():
        out.append((f"{side}_invalid", "error", c[side].isNotNull() & age.isNull()))
    for side, age in ages.items():
        out.append((f"{side}_range", "error", (age < 0) | (age > 120)))
    out += [
        ("ages_crossed", "error", ages["min_age"] > ages["max_age"]),
        ("status_unknown", "warning", ~is_blank(c["status"]) & ~search_form(c["status"]).isin(*rules.STATUSES)),
        ("instructor_empty", "warning", is_blank(c["instructor"])),
        ("location_empty", "warning", is_blank(c["location"])),
    ]
    return out


def violations(df: DataFrame, row_rules: list[Rule], keep: list[str]) -> DataFrame:
    """One row per broken rule, from one scan: the kept columns, ``rule`` and ``severity``."""
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, test in row_rules]))
    return df.select(*keep, F.explode(found).alias("_v")).select(*keep, "_v.rule", "_v.severity")


def profile(df: DataFrame, frequencies: dict[str, str | None], missing: dict[str, Column]) -> DataFrame:
    """``column, value, n``: how often each value of a column stands, and how often a field is missing.

    A column's empty values are left out, or count under the name that is given for them.  All
    columns come from one scan.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.when(is_blank(F.col(c)), F.lit(empty).cast("string")).otherwise(F.trim(F.col(c).cast("string"))).alias("value")) for c, empty in frequencies.items()]
    cells += [F.struct(F.lit(f"missing:{name}").alias("column"), F.when(test, F.lit("missing")).alias("value")) for name, test in missing.items()]
    each = df.select(F.explode(F.array(*cells)).alias("c")).select("c.column", "c.value").where(F.col("value").isNotNull())
    return each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def activity_profile(df: DataFrame) -> DataFrame:
    """Centres, days, statuses and audiences, and missing optional fields; an age is missing if both bounds are."""
    missing = {f: is_blank(F.col(f)) for f in ("instructor", "location", "end_time")} | {"age_range": F.col("min_age").isNull() & F.col("max_age").isNull()}
    return profile(df, {"center_name": None, "day": None, "status": "missing", "target_audience": "missing"}, missing)


def source_summary(df: DataFrame) -> DataFrame:
    """Rows per source, of these cancelled, undecided, and without instructor or location."""
    return df.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "cancelled").alias("n_cancelled"), F.count_if(F.col("status") == "tbd").alias("n_tbd"),
        F.count_if(is_blank(F.col("instructor"))).alias("n_no_instructor"), F.count_if(is_blank(F.col("location"))).alias("n_no_location"),
    )


def same_activities(df: DataFrame) -> DataFrame:
    """Groups of rows that are one activity but for case and white space."""
    label = F.concat_ws(" | ", F.concat(F.lit("#"), F.col("ord").cast("string")), "name", "center_name", F.concat_ws(" ", "day", "start_time"))
    return duplicate_groups(df, [search_form(F.col(c)) for c in SAME_ACTIVITY], label)


def verdict(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, and PASS if there is no error."""
    out = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return out.withColumn("status", F.when(F.col("errors") == 0, "PASS").otherwise("FAIL"))
