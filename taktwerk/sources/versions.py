"""Versions of a table: written once, switched at one stroke, read as a whole.

A version is a folder of files that never change.  A manifest with the next number names it; the greatest number is in
force.  A manifest appears by a rename that fails where the number is taken, so of two writers one wins and the other
learns of it, and a reader sees the old version or the new one.  Readers that have begun keep the files they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published first."""


@dataclass(frozen=True)
class Manifest:
    """A number, the folder with the version's files, the schema (as JSON) and a note."""

    number: int
    files: str
    schema: str
    note: str


class Versions:
    """The versions of one table under a folder that all machines share (any file system of Spark)."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self._root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _manifests(self) -> str:
        return f"{self._root}/manifests"

    def numbers(self) -> list[int]:
        """All numbers that were published and are still there, in order."""
        folder = self._path(self._manifests())
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """A version's manifest; without a number that of the one in force."""
        if number is None:
            found = self.numbers()
            if not found:
                raise LookupError(f"{self._root} has no version")
            number = found[-1]
        stream = self._fs.open(self._path(f"{self._manifests()}/{number:012d}.json"))
        try:
            text = self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _name(self, files: str, schema: str, note: str, after: int | None) -> int:
        found = self.numbers()
        last = found[-1] if found else 0
        if after is not None and after != last:
            raise Conflict(f"version {last} is in force, not {after}")
        made = Manifest(last + 1, files, schema, note)
        draft, place = self._path(f"{self._manifests()}/.{uuid.uuid4().hex}"), self._path(f"{self._manifests()}/{made.number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(made.__dict__, ensure_ascii=False).encode()))
        out.close()
        try:
            self._context.rename(draft, place, self._spark._sc._gateway.new_array(self._spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(place):
                raise Conflict(f"version {made.number} was published meanwhile") from error
            raise
        return made.number

    def publish(self, df: DataFrame, note: str = "", after: int | None = None) -> int:
        """Write a table as the next version and put it in force; with ``after`` only if that version is the last one."""
        files = f"{self._root}/files/{uuid.uuid4().hex}"
        df.write.parquet(files)
        return self._name(files, df.schema.json(), note, after)

    def switch(self, number: int, note: str = "") -> int:
        """Put the files of an older version in force again, under the next number."""
        old = self.manifest(number)
        return self._name(old.files, old.schema, note or f"as {number}", None)

    def read(self, number: int | None = None) -> DataFrame:
        """A version's rows; the reader keeps this version whatever is published later."""
        held = self.manifest(number)
        return self._spark.read.schema(StructType.fromJson(json.loads(held.schema))).parquet(held.files)

    def show_as(self, view: str, number: int | None = None) -> int:
        """Let a view show a version (without a number the one in force); calling it again refreshes the view.  Gives the number."""
        held = self.manifest(number)
        self.read(held.number).createOrReplaceTempView(view)
        return held.number

    def forget(self, keep: int) -> list[int]:
        """Remove the manifests before the last ``keep`` and the files that none of the others names; gives the numbers removed."""
        found = self.numbers()
        old, kept = found[: max(0, len(found) - keep)], found[max(0, len(found) - keep) :]
        held = {self.manifest(n).files for n in kept}
        for number in old:
            files = self.manifest(number).files
            self._fs.delete(self._path(f"{self._manifests()}/{number:012d}.json"), False)
            if files not in held:
                self._fs.delete(self._path(files), True)
        return old


def with_current(versions: Versions, make: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of a stream meets the version that is in force when the batch begins."""

    def run(batch: DataFrame, _: int) -> None:
        number = versions.manifest().number
        make(batch, versions.read(number), number)

    return run
