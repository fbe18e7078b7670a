"""Stored tables as snapshots: every write makes new folders and then one small pointer file.

Pointers are numbered, and a number is given once: a file is written beside and renamed to its name only
if there is none of that name. Readers follow the greatest number, so they see either the old or the new
state of all tables, never a mixture; of two writers on one state the second fails and may start again.

A table is one or more folders. New rows are a folder more; only a table whose rows change is written
anew, and so is one that has come to many folders.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.errors import DatabaseMigrationFailed, DatabaseNotInitialized
from quillgraph.schema import TABLES

#: Version of the tables' schemas; a store of another version is refused.
SCHEMA_VERSION = 1
#: Names of pointers: their number between.
POINTER, SUFFIX = "_snapshot-", ".json"
#: A table of more folders is written as one at its next change.
MOST_FOLDERS = 32


class StaleSnapshot(RuntimeError):
    """Another writer has made a snapshot in the meantime."""


class Catalog:
    """The tables of ``schema.TABLES`` below ``root``, a folder of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of the pointers that are there, ascending."""
        found = self._fs.globStatus(self._path(f"{self.root}/{POINTER}*{SUFFIX}")) or []
        names = [status.getPath().getName() for status in found]
        return sorted(int(name[len(POINTER) : -len(SUFFIX)]) for name in names)

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{POINTER}{number:010d}{SUFFIX}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, number: int, value: dict) -> None:
        """The pointer of a number, unless another writer has made it already."""
        part = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        jvm = self.spark._jvm
        whole = self._fs.makeQualified(self._path(f"{self.root}/{POINTER}{number:010d}{SUFFIX}"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(),
            self.spark._jsc.hadoopConfiguration(),
        )
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(part), whole, over)  # fails if the name is taken
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise StaleSnapshot(f"snapshot {number} is there already") from None
            raise

    def pointer(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            raise DatabaseNotInitialized(f"no tables at {self.root}")
        current = self._read(numbers[-1])
        if current["schema_version"] != SCHEMA_VERSION:
            raise DatabaseNotInitialized(
                f"tables at {self.root} have version {current['schema_version']}, not {SCHEMA_VERSION}",
            )
        return current

    def initialize(self) -> bool:
        """Make empty tables; False if there are tables of this version already."""
        numbers = self._numbers()
        current = self._read(numbers[-1]) if numbers else None
        if current is not None:
            if current["schema_version"] > SCHEMA_VERSION:
                raise DatabaseMigrationFailed(f"tables at {self.root} are newer than this version")
            if current["schema_version"] == SCHEMA_VERSION:
                return False
        self._fs.mkdirs(self._path(self.root))
        number = numbers[-1] + 1 if numbers else 0
        folders = {}
        for name, schema in TABLES.items():
            folders[name] = [f"{self.root}/{name}/{number}-{uuid.uuid4().hex[:8]}"]
            self.spark.createDataFrame([], schema).write.parquet(folders[name][0])
        self._write(number, {"schema_version": SCHEMA_VERSION, "snapshot": number, "tables": folders})
        return True

    def table(self, name: str, pointer: dict | None = None) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*(pointer or self.pointer())["tables"][name])

    def tables(self) -> dict[str, DataFrame]:
        pointer = self.pointer()
        return {name: self.table(name, pointer) for name in TABLES}

    def commit(
        self,
        changed: dict[str, DataFrame],
        based_on: dict,
        added: dict[str, DataFrame] | None = None,
    ) -> dict:
        """Make ``changed`` tables, and tables with the rows of ``added`` as well, current, all at once.

        ``based_on`` is the pointer the new tables were computed from. Columns are brought into the
        declared order and types; unchanged tables keep their folders. A writer whose state is no longer
        current is told before it writes anything, or, at the latest, when it takes its number.
        """
        number = based_on["snapshot"] + 1
        if self._numbers()[-1] != based_on["snapshot"]:
            raise StaleSnapshot(f"snapshot {based_on['snapshot']} is no longer current")
        folders = {name: list(of) for name, of in based_on["tables"].items()}

        def write(name: str, df: DataFrame) -> str:
            folder = f"{self.root}/{name}/{number}-{uuid.uuid4().hex[:8]}"
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]
            df.select(*columns).write.parquet(folder)
            return folder

        for name, df in changed.items():
            folders[name] = [write(name, df)]
        for name, df in (added or {}).items():
            if len(folders[name]) >= MOST_FOLDERS:
                folders[name] = [write(name, self.spark.read.schema(TABLES[name]).parquet(*folders[name]))]
            folders[name].append(write(name, df))
        pointer = {"schema_version": SCHEMA_VERSION, "snapshot": number, "tables": folders}
        self._write(number, pointer)
        return pointer

    def clean_up(self, keep: int = 10) -> int:
        """Delete all but the last ``keep`` pointers, and the folders that no pointer left names; gives
        the number of folders deleted. Writers must be idle: a folder that is being written is in none."""
        numbers = self._numbers()
        kept, gone = numbers[-keep:], numbers[:-keep]
        used = {folder for n in kept for of in self._read(n)["tables"].values() for folder in of}
        old = {folder for n in gone for of in self._read(n)["tables"].values() for folder in of} - used
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{POINTER}{n:010d}{SUFFIX}"), False)
        for folder in old:
            self._fs.delete(self._path(folder), True)
        return len(old)
