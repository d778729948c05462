"""Expected against observed values, case by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.functions.text import holds

EXACT = ["intent", "day", "start_after", "start_before", "target_audience", "age"]
CONTAINS = {"category_contains": "category", "center_contains": "center_name", "instructor_contains": "instructor"}


def result_counts(cases: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Cases with the number of their results; none is 0."""
    n = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return cases.join(n, key, "left").withColumn("result_count", F.coalesce("_n", F.lit(0))).drop("_n")


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def evaluate(cases: DataFrame, exact: list[str] | None = None) -> DataFrame:
    """``failures`` and ``passed`` of each case.

    ``cases`` has ``expected`` (struct) and ``observed`` (struct), ``result_count`` and, where
    the run of a case broke, ``error``.  Only expectations that are set are checked.
    """
    want = {f.name for f in cases.schema["expected"].dataType.fields}
    seen = {f.name for f in cases.schema["observed"].dataType.fields}
    e, o = (lambda f: F.col(f"expected.{f}")), (lambda f: F.col(f"observed.{f}") if f in seen else F.lit(None).cast("string"))
    checks = []
    for f in exact or EXACT:
        if f in want:
            bad = e(f).isNotNull() & ~e(f).eqNullSafe(o(f).cast(cases.schema["expected"].dataType[f].dataType))
            checks.append(F.when(bad, F.concat(F.lit(f"{f}: expected="), _shown(e(f)), F.lit(", actual="), _shown(o(f)))))
    for f, of in CONTAINS.items():
        if f in want:
            bad = e(f).isNotNull() & ~holds(o(of), e(f))
            checks.append(F.when(bad, F.concat(F.lit(f"{of}: expected to contain "), _shown(e(f)), F.lit(", actual="), _shown(o(of)))))
    n = F.col("result_count")
    if "min_results" in want:
        checks.append(F.when(n < e("min_results"), F.concat(F.lit("result_count: expected >= "), _shown(e("min_results")), F.lit(", actual="), _shown(n))))
    if "exact_results" in want:
        checks.append(F.when(n != e("exact_results"), F.concat(F.lit("result_count: expected="), _shown(e("exact_results")), F.lit(", actual="), _shown(n))))
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    nothing = F.array().cast("array<string>")
    if "must_contain" in want:
        missing = F.transform(F.filter(e("must_contain"), lambda x: ~holds(o("final_answer"), x)), lambda x: F.concat(F.lit("answer missing: "), x))
        found = F.concat(found, F.coalesce(missing, nothing))
    if "must_not_contain" in want:
        present = F.transform(F.filter(e("must_not_contain"), lambda x: holds(o("final_answer"), x)), lambda x: F.concat(F.lit("answer should not have: "), x))
        found = F.concat(found, F.coalesce(present, nothing))
    if "allow_clarification" in want:
        lost = F.coalesce(e("allow_clarification"), F.lit(False)) & ~F.coalesce(o("waiting_for_clarification").cast("boolean"), F.lit(False))
        lost = lost & ~F.coalesce(o("intent").isin("activity", "unknown"), F.lit(False))
        found = F.concat(found, F.when(lost, F.array(F.lit("expected clarification or a known intent"))).otherwise(nothing))
    if "error" in cases.columns:
        found = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("run failed: "), "error"))).otherwise(found)
    return cases.withColumn("failures", found).withColumn("passed", F.size("failures") == 0)


def score(evaluated: DataFrame, duration: str | None = "duration") -> DataFrame:
    """One row: cases, passed, failed, the share passed in percent, and the mean time."""
    passed = F.count_if("passed")
    n = F.count(F.lit(1))
    mean = F.avg(duration) if duration and duration in evaluated.columns else F.lit(None).cast("double")
    return evaluated.agg(n.alias("total"), passed.alias("passed"), (n - passed).alias("failed"), F.coalesce(F.try_divide(passed * 100.0, n), F.lit(0.0)).alias("score_percent"), mean.alias("mean_seconds"))
