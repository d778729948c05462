"""Places of rows within groups of any size, and pages far behind the first.

A window puts all rows of a group into one task.  Here rows are dealt by ranges of group and order and written; what a range
holds of a group is counted, sums over the ranges before give each range's first place, and a row's place is its distance from its
group's first row in the range.  A group may fill many ranges.  The table that comes out is in order, so its files tell by their
least and greatest place whether a page lies in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.sources.tables import written


def ranked(df: DataFrame, keys: list[str], order: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``place`` (from 1, by ``order``) and ``total`` within each group of ``keys``.

    ``order`` must tell the rows of a group apart for the places to be the same each time.  Nulls come first (last where descending).
    """
    by = [*keys, *[F.desc(c) if c in descending else F.asc(c) for c in order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # The upper bits of the number are the partition, the lower ones count its rows.
    dealt = written(dealt.select("*", F.monotonically_increasing_id().alias("_row")).select("*", F.shiftright("_row", 33).alias("_range")), "ranked")
    pieces = dealt.groupBy(*keys, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*keys, "_range", "_first", before.alias("_before"), F.sum("_n").over(group).alias("total"))
    a, b = dealt.alias("a"), pieces.alias("b")
    both = a.join(b, [F.col("a._range") == F.col("b._range"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]])
    place = (F.col("a._row") - F.col("b._first") + F.col("b._before") + 1).alias("place")
    return both.select(*[F.col(f"a.{c}") for c in names], place, F.col("b.total").alias("total"))


def kept_in_order(ranked_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table of :func:`ranked` written by ranges of group and place, so that a page reads the files that hold it."""
    parts = int(ranked_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(ranked_rows.repartitionByRange(parts, *keys, "place").sortWithinPartitions(*keys, "place"), "in-order")


def page_at(ranked_rows: DataFrame, offset: int, n: int) -> DataFrame:
    """The ``n`` rows of each group behind the first ``offset``, with ``next_offset`` and ``has_more``."""
    out = ranked_rows.where((F.col("place") > offset) & (F.col("place") <= offset + n))
    return out.withColumn("next_offset", F.least(F.lit(offset + n), F.col("total"))).withColumn("has_more", F.col("total") > offset + n)


def page_after(df: DataFrame, order: list[str], last: list, n: int) -> DataFrame:
    """The ``n`` rows that follow the row with the values ``last`` in the order: no row before it is put in order."""
    later: Column = F.lit(False)
    for i in range(len(order) - 1, -1, -1):
        here = F.col(order[i])
        later = (here > F.lit(last[i])) | ((here == F.lit(last[i])) & later)
    return df.where(later).orderBy(*order).limit(n)


def running_total(df: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in a total order.

    Rows are dealt by ranges and written; sums of whole ranges (one row each) give where a range begins, a window within it the rest.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("_range"))
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    begins = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(begins), "_range").select(*df.columns, (F.col("_begin") + within).alias(into))
