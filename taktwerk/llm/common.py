"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a batch that goes to Python: texts can be long, and a task holds a few batches at once.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: White space between words, in the sense of the contracts: blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where it names none, a session on one machine gets a
    temporary folder, and on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/taktwerk/{label}-{uuid.uuid4().hex}"


#: Paths written in each open :func:`scratch`, the innermost last.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from those files.

    Lost executors cost nothing then, and a costly step feeds several branches without running twice.
    """
    path = shared_folder(df.sparkSession, label)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables materialised inside are removed at the end, but for those written with the function it gives.

    The garbage collections let Spark's cleaner remove the shuffle files of plans that have ended.
    """
    own: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        _OPEN.pop()
        try:
            return materialize(df, label)
        finally:
            _OPEN.append(own)

    spark._jvm.System.gc()
    _OPEN.append(own)
    try:
        yield keep
    finally:
        _OPEN.remove(own)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        spark._jvm.System.gc()


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input.

    Neither is broadcast at any size, so that a plan that works on little data is the one that runs on much.
    """
    return left.join(right.hint("merge"), on, how)


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct with fields ``c0``, ``c1`` and so on, which no name can clash with."""
    return F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])


def unpacked(row: str, names: list[str], new: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a :func:`packed` row under their names, some of them replaced."""
    return [(new or {}).get(c, F.col(f"{row}.c{i}")).alias(c) for i, c in enumerate(names)]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words_of(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_text(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that others cannot clash with them.

    As such a table may go to Python, the session's batches are made no larger than ``BATCH_ROWS``.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, BATCH_ROWS)
    return docs.select(*[docs[old].alias(new) for new, old in names.items()])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of one of them stays small.

    At the end the worker, which other tasks will use, gives free memory back to the system.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
