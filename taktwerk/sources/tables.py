"""Tables that a job writes for itself, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The paths written in the innermost open :func:`scratch` of this thread.
_OPEN: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names; a session on one machine without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{base.rstrip('/')}/taktwerk/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back, so that what follows starts from files and costly steps run once."""
    path = shared_folder(df.sparkSession, label)
    held = _OPEN.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, by merging at every size.

    Spark's estimates go by the bytes of files: a file that is small for being compressed, or whose rows are exploded
    behind it, would else be taken for small enough to be collected by the driver and sent to all tasks.
    """
    return left.join(right.hint("merge"), on, how)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are removed at the end, but for those written with the function it gives, which are the caller's."""
    before, own = _OPEN.get(), []
    token = _OPEN.set(own)

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _OPEN.set(before)
        try:
            return written(df, label)
        finally:
            _OPEN.reset(inner)

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
