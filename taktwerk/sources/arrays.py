"""A table as one file with a JSON array of records, in a stated order, replaced at one stroke.

Records become texts where they are and are put in order and written by ranges, by many tasks; a single task then copies the
ranges one behind the other, as one file has one writer, and holds a line at a time.  Spark's commit lets the part appear once its task has ended, and a rename
puts it in the place of the old file, so a job that fails leaves the old file as it was.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.sources.documents import text_dates


def array_lines(df: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The lines of the array: each record behind a bracket or a comma, then the closing bracket.  ``order`` tells rows apart.

    Nulls are written, other letters than ASCII stand as they are, times go as ``yyyy-MM-dd HH:mm:ss``.
    """
    record = F.to_json(F.struct(*(keep or df.columns)), {"ignoreNullFields": "false"})
    lines = text_dates(df).select(F.lit(0).alias("_end"), F.struct(*order).alias("_at"), record.alias("value"))
    first = lines.agg(F.min("_at").alias("_first"))
    marked = lines.join(F.broadcast(first), how="left").select("_end", "_at", F.concat(F.when(F.col("_at") == F.col("_first"), "[").otherwise(","), "value").alias("value"))
    closing = first.select(F.lit(1).alias("_end"), F.lit(None).cast(lines.schema["_at"].dataType).alias("_at"), F.when(F.col("_first").isNull(), "[]").otherwise("]").alias("value"))
    return marked.unionByName(closing).orderBy("_end", "_at").select("value")


def save_array(df: DataFrame, path: str, order: list[str], keep: list[str] | None = None) -> None:
    """Write ``df`` to the file ``path`` as one array."""
    spark = df.sparkSession
    spark_path = spark._jvm.org.apache.hadoop.fs.Path
    target = spark_path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    draft, ranges = (spark_path(target.getParent(), f".{target.getName()}-{kind}-{uuid.uuid4().hex}") for kind in ("whole", "ranges"))
    try:
        # Parts are named in the order of their ranges; compressed ones are not split, so that each is one piece of the copy.
        array_lines(df, order, keep).write.text(ranges.toString(), compression="gzip")
        parts = sorted(f.getPath().toString() for f in fs.listStatus(ranges) if f.getPath().getName().startswith("part-"))
        copies = [spark.read.text(p, lineSep="\n") for p in parts]
        reduce(DataFrame.unionAll, copies).coalesce(1).write.text(draft.toString())
        part = next(f.getPath() for f in fs.listStatus(draft) if f.getPath().getName().startswith("part-"))
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        over = spark._sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(part, target, over)
    finally:
        fs.delete(draft, True)
        fs.delete(ranges, True)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of such a file, read line by line, so that a large file is read by many tasks."""
    lines = spark.read.text(path).where(~F.col("value").isin("]", "[]"))
    return lines.select(F.from_json(F.substring("value", 2, 2_147_483_647), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
