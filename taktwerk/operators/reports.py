"""Reports as tables: a summary, findings of which the first are shown, groups row by row, cases one by one.

Nothing is gathered into a cell.  Counts for the summary are observed while the parts are written, so the input is not
read again for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.text import search_form
from taktwerk.operators.quality import SAME_ACTIVITY, activity_profile, activity_row_rules, violations
from taktwerk.sources.arrays import save_array

#: Rows of a list that a report shows.
SHOWN = 20


def first_of(df: DataFrame, keys: list[str], order: list[str], n: int = SHOWN) -> DataFrame:
    """The first ``n`` rows of each group by a total order, with ``place`` and ``more`` (rows that are not shown).

    Each task lets ``n`` rows of a group go on before they meet, so a group of any size does.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    shown = df.withColumn("place", place).where(F.col("place") <= n).alias("s")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).alias("t")
    both = shown.join(totals, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return both.select("s.*", F.greatest(F.col("t._total") - n, F.lit(0)).alias("more"))


def duplicate_members(df: DataFrame, keys: list[Column], label: Column, order: str = "ord") -> DataFrame:
    """A row for each member of a group of more than one row with equal keys (null equals null): ``first, n, ord, label``."""
    names = [f"k{i}" for i in range(len(keys))]
    keyed = df.select(*[k.alias(name) for k, name in zip(keys, names, strict=True)], F.col(order).alias("ord"), label.alias("label"))
    many = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).where("n > 1")
    a, b = keyed.alias("a"), many.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]).select("b.first", "b.n", "a.ord", "a.label")


def same_activity_members(df: DataFrame) -> DataFrame:
    """:func:`duplicate_members` of activities that are one but for case and white space."""
    label = F.concat_ws(" | ", "name", "center_name", F.concat_ws(" ", "day", "start_time"))
    return duplicate_members(df, [search_form(F.col(c)) for c in SAME_ACTIVITY], label)


@dataclass(frozen=True)
class ValidationReport:
    """The folder of a report and its parts, each a table below it."""

    spark: SparkSession
    folder: str

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def shown(self, n: int = SHOWN) -> DataFrame:
        """The first findings of each severity, and how many more there are."""
        return first_of(self.part("findings"), ["severity"], ["ord", "rule"], n)


def validate(df: DataFrame, folder: str) -> ValidationReport:
    """Write the validation report of an activity table: ``findings``, ``statistics``, ``duplicates`` and ``summary``."""
    spark = df.sparkSession
    seen, broken, twins = (Observation(n) for n in ("activities", "findings", "duplicates"))
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
    found = violations(observed, activity_row_rules({c: F.col(c) for c in df.columns}), ["ord"])
    found.observe(broken, F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).write.parquet(f"{folder}/findings")
    same_activity_members(df).observe(twins, F.count_if(F.col("ord") == F.col("first")).alias("groups")).write.parquet(f"{folder}/duplicates")
    activity_profile(df).write.parquet(f"{folder}/statistics")
    errors = broken.get["errors"]
    summary = {"total_activities": seen.get["n"], "critical_errors": errors, "warnings": broken.get["warnings"], "duplicate_groups": twins.get["groups"]}
    status = F.lit("PASS" if errors == 0 else "FAIL").alias("status")
    spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in summary.items()], status).write.parquet(f"{folder}/summary")
    return ValidationReport(spark, folder)


def case_summary(evaluated: DataFrame) -> DataFrame:
    """One row: cases passed, failed and all, the share passed in percent (two digits), and the time that all took."""
    passed, n = F.count_if("passed"), F.count(F.lit(1))
    time = F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 3)
    score = F.round(F.coalesce(F.try_divide(passed * 100.0, n), F.lit(0.0)), 2)
    return evaluated.agg(passed.alias("passed"), (n - passed).alias("failed"), n.alias("total"), score.alias("score"), time.alias("total_duration"))


def case_rows(evaluated: DataFrame, observed: list[str]) -> DataFrame:
    """One row per case: what it asked, whether it passed and why not, its time, and what was observed."""
    known = {f.name for f in evaluated.schema["observed"].dataType.fields}
    seen = F.struct(*[(F.col(f"observed.{c}") if c in known else F.lit(None).cast("string")).alias(c) for c in observed], F.col("result_count").alias("result_count"))
    return evaluated.select("id", "query", "passed", F.round("duration", 3).alias("duration"), "failures", seen.alias("observed"))


#: What a report tells of each case.
OBSERVED = ["intent", "category", "day", "start_after", "start_before", "center_name", "instructor", "target_audience", "age", "waiting_for_clarification"]


def save_cases(evaluated: DataFrame, folder: str) -> None:
    """Write the evaluation report as two arrays of records: ``summary.json`` and ``results.json``, by the cases' ids."""
    save_array(case_summary(evaluated), f"{folder}/summary.json", ["total"])
    save_array(case_rows(evaluated, OBSERVED), f"{folder}/results.json", ["id"])
