"""Duplicates, null-safe differences between two tables, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.text import locations_match, unified_audience
from taktwerk.functions.timeofday import add_minutes, seconds_of
from taktwerk.operators.intervals import first_rule, in_intervals


def keep_first(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of the rows with equal keys (null equals null) the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of the rows with equal keys the last by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def duplicate_groups(df: DataFrame, keys: list[Column], label: Column, order: str = "ord") -> DataFrame:
    """Groups of more than one row with equal keys: ``first``, ``n``, and the members' labels in order.

    Groups are counted before members are gathered, so rows without a twin never meet.
    """
    keyed = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(order).alias("o"), label.alias("l"))
    names = [f"k{i}" for i in range(len(keys))]
    many = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first")).where("n > 1")
    same = [keyed[k].eqNullSafe(many[k]) for k in names]
    members = keyed.join(many, same).select(many["first"], many["n"], keyed["o"], keyed["l"])
    return members.groupBy("first", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]).alias("members"))


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str], order: str = "ord") -> DataFrame:
    """Both tables on their keys (null equals null): ``side`` is ``both``, ``missing`` or ``extra``; the
    fields come as ``e_`` and ``a_`` columns.  Of equal keys the last row of each side counts."""
    e, a = (keep_last(df, keys, order) for df in (expected, actual))
    e = e.select(*[F.col(k).alias(f"ek_{k}") for k in keys], *[F.col(f).alias(f"e_{f}") for f in fields], F.lit(1).alias("_e"))
    a = a.select(*[F.col(k).alias(f"ak_{k}") for k in keys], *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("_a"))
    both = e.join(a, [e[f"ek_{k}"].eqNullSafe(a[f"ak_{k}"]) for k in keys], "full_outer")
    side = F.when(F.col("_e").isNull(), "extra").when(F.col("_a").isNull(), "missing").otherwise("both")
    named = [F.when(F.col("_e").isNotNull(), F.col(f"ek_{k}")).otherwise(F.col(f"ak_{k}")).alias(k) for k in keys]
    return both.select(side.alias("side"), *named, *[F.col(f"{s}_{f}") for f in fields for s in ("e", "a")])


def recall_precision(pairs: DataFrame) -> DataFrame:
    """One row: counts of the sides, recall and precision over distinct keys; 0 for an empty side."""
    n = {s: F.count_if(F.col("side") == s) for s in ("both", "missing", "extra")}
    ratio = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    return pairs.agg(
        n["both"].alias("matched"), n["missing"].alias("missing"), n["extra"].alias("extra"),
        ratio(n["both"], n["both"] + n["missing"]).alias("recall"), ratio(n["both"], n["both"] + n["extra"]).alias("precision"),
    )


def mismatches(pairs: DataFrame, rules_by_field: dict[str, Column]) -> DataFrame:
    """One row per matched key and field that differs: the pair's columns and ``field``.

    Each rule is true where the field agrees.
    """
    fields = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f)) for f, ok in rules_by_field.items()]))
    return pairs.where("side = 'both'").withColumn("field", F.explode(fields))


def activity_rules() -> dict[str, Column]:
    """The field rules of an extraction against its ground truth."""
    return {
        "end_time": F.col("e_end_time").eqNullSafe(F.col("a_end_time")),
        "instructor": F.col("e_instructor").eqNullSafe(F.col("a_instructor")),
        "target_audience": unified_audience(F.col("e_target_audience")).eqNullSafe(unified_audience(F.col("a_target_audience"))),
        "location": locations_match(F.col("e_location"), F.col("a_location"), F.col("a_branch")),
    }


def mismatch_counts(found: DataFrame, source: str = "source_file") -> DataFrame:
    """Differences by source and field, and by field over all sources (null source)."""
    return found.groupingSets([[source, "field"], ["field"]], source, "field").agg(F.count(F.lit(1)).alias("n"))


def looked_up(df: DataFrame, column: str, table: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """The table's value for a column, or the column itself.  Spark sends the table to every task
    if its size allows, and joins by shuffling if not."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(t, df[column] == F.col("_k"), "left").withColumn(into, F.coalesce("_v", column)).drop("_k", "_v")


def infer_end(df: DataFrame, rule_table: DataFrame, explicit: str = "end_time") -> DataFrame:
    """Add ``end_inferred`` and ``end_time_source``.

    An end that is given stays.  Else the rule with the lowest priority that fits source, day,
    start and name gives the minutes; a rule without minutes says that the end is unknown.
    """
    out = first_rule(df, rule_table, ["source_file", "day", "start_time", "name"], "priority", "minutes", "_minutes")
    best = F.col("_minutes")
    given = F.col(explicit).isNotNull()
    end = F.when(given, F.col(explicit)).otherwise(add_minutes(F.col("start_time"), best))
    origin = F.when(given, "explicit").when(end.isNotNull(), "inferred_source_rule").otherwise("missing")
    return out.withColumn("end_inferred", end).withColumn("end_time_source", origin).drop("_minutes")


def duration_rules(spark, rows: list[tuple] | None = None) -> DataFrame:
    """The duration rules as a table."""
    columns = {"source_file": "string", "day": "string", "start_time": "string", "name": "string", "minutes": "int", "priority": "int"}
    # As one literal, whose size Spark knows.
    each = [F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, columns.items(), strict=True)]) for row in (rules.DURATIONS if rows is None else rows)]
    table = f"array<struct<{','.join(f'{c}:{kind}' for c, kind in columns.items())}>>"
    return spark.range(1).select(F.inline(F.array(*each).cast(table)))


def dayparts(spark, parts: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The dayparts as a table of intervals in seconds: ``daypart, low, high``."""
    bound = lambda t: int(t[:2]) * 3600 + int(t[3:]) * 60
    # As one literal, whose size Spark knows.
    each = [F.struct(F.lit(label).alias("daypart"), F.lit(bound(lo)).alias("low"), F.lit(bound(hi)).alias("high")) for label, lo, hi in parts or rules.DAYPARTS]
    return spark.range(1).select(F.inline(F.array(*each)))


def with_dayparts(df: DataFrame, time: Column, parts: DataFrame | None = None) -> DataFrame:
    """A row for every daypart in which the time lies, both ends included; ``daypart`` is its label.

    ``parts`` is a table as :func:`dayparts` gives it, of any size.
    """
    table = dayparts(df.sparkSession) if parts is None else parts
    return in_intervals(df, seconds_of(time), table, "low", "high", 3600).drop("low", "high")


def daypart_of(after: Column, before: Column) -> Column:
    """The label of a pair of bounds: a daypart, an exact hour, after or before."""
    out = None
    for label, lo, hi in rules.DAYPARTS:
        test = (after == lo) & (before == hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.when(after == before, "exact").when(after.isNotNull() & before.isNotNull(), "between").when(after.isNotNull(), "after").when(before.isNotNull(), "before")


def audience_by_name(name: Column, layout: str, min_age: Column | None = None) -> Column:
    """The audience of a layout's activities: mixed for its listed names and from the age of 16, else women."""
    mixed = F.coalesce(name.isin(*rules.AUDIENCE_BY_NAME[layout]), F.lit(False))
    if min_age is not None:
        mixed = mixed | F.coalesce(min_age >= 16, F.lit(False))
    return F.when(mixed, F.lit(rules.MIXED)).otherwise(F.lit(rules.WOMEN))
