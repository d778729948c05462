"""Rows that meet tables of intervals and of rules, by joins of equals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_intervals(df: DataFrame, value: Column, intervals: DataFrame, low: str, high: str, width: int, by: dict[str, str] | None = None) -> DataFrame:
    """The rows with every interval in which ``value`` (a whole number) lies, both ends included.

    Intervals are a table of any size that may overlap; each stands in every bin of ``width`` that it touches, a row in one,
    and the ends are tested where they meet.  ``by`` names columns of the rows and of the intervals that must be equal besides.
    A null value lies in no interval; an interval with a null end, or one that ends before it begins, holds nothing.
    """
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    bins = F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))
    held = intervals.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins)).alias("i")
    rows = df.withColumn("_value", value.cast("long")).withColumn("_bin", bin_of(F.col("_value"))).alias("r")
    same = [F.col(f"r.{a}") == F.col(f"i.{b}") for a, b in (by or {}).items()]
    met = rows.join(held, [F.col("r._bin") == F.col("i._bin"), *same]).where(F.col("r._value").between(F.col(f"i.{low}"), F.col(f"i.{high}")))
    return met.select(*[F.col(f"r.{c}") for c in df.columns], *[F.col(f"i.{c}") for c in intervals.columns if c not in df.columns])


def first_rule(df: DataFrame, rule_table: DataFrame, keys: list[str], priority: str, value: str, into: str) -> DataFrame:
    """The rows with the value of the rule that fits and has the least priority, and null where none fits.

    A rule fits a row if its keys equal the row's; a null key fits all.  Rules are a table of any size.  Those with the same
    keys set make a pattern, and rows meet each pattern that occurs in one join on these keys; of rules with equal keys only the first
    by priority is there, so a row never becomes two.  Of two rules of one priority the lesser value holds, null before all.
    """
    pattern = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)])
    marked = rule_table.withColumn("_pattern", pattern)
    # At most two to the power of the keys.
    patterns = sorted(r[0] for r in marked.select("_pattern").distinct().collect())
    out, found = df, []
    for p in patterns:
        held = [k for i, k in enumerate(keys) if p >> i & 1]
        best = F.min(F.struct(F.col(priority).alias("p"), F.col(value).alias("v"))).alias(f"_best{p}")
        mine = marked.where(F.col("_pattern") == p)
        mine = mine.groupBy(*held).agg(best) if held else mine.agg(best)
        mine = mine.select(*[F.col(k).alias(f"_k{p}_{k}") for k in held], f"_best{p}")
        out = out.join(mine, [F.col(k) == F.col(f"_k{p}_{k}") for k in held], "left") if held else out.join(F.broadcast(mine), how="left")
        found.append(F.col(f"_best{p}"))
    best = F.array_min(F.array_compact(F.array(*found)))["v"] if found else F.lit(None).cast(rule_table.schema[value].dataType)
    return out.select(*df.columns, best.alias(into))
