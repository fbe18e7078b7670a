"""Listing and hashing document files.

Directories are listed by tasks, a level of all trees at a time, as a listing must not follow links to
directories and must keep nanosecond times, which Spark's file source does not do. Contents are hashed
by tasks too, only where a file is stale. Files lie on storage that driver and executors share.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillgraph.session import cut

# The suffix of documents, the size of pieces in which they are read, the hash's prefix.
SUFFIX, PIECE, PREFIX = ".pdf", 1 << 20, "sha256:"

LISTING = "normalized_path string, file_size long, file_mtime_ns long, readable boolean"
LISTED = f"folder string, {LISTING}"
#: Directories that a task lists, where there are many.
FOLDERS = 200


def normalize_local_path(path: str) -> str:
    """An absolute path without ``~``, ``.`` and ``..``; links are not resolved."""
    return os.path.abspath(os.path.expanduser(path))


def _stat(path: str) -> tuple[str, int | None, int | None, bool]:
    try:
        stat = os.stat(path)
        return path, stat.st_size, stat.st_mtime_ns, True
    except OSError:
        return path, None, None, False


def list_folder(folder: str) -> tuple[list[str], list[tuple[str, int | None, int | None, bool]]]:
    """Directories and documents directly in a directory, in order of names. Links to files are kept as
    they are, those that lead nowhere and those to directories are left out; so is what cannot be read."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [], []
    folders = [e.path for e in entries if e.is_dir(follow_symlinks=False)]
    files = [_stat(e.path) for e in entries if e.name.lower().endswith(SUFFIX) and os.path.isfile(e.path)]
    return folders, files


def list_documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The listing of all documents below the roots that exist; a file below several comes once.

    One job per level of directories: what a level finds is stored, and its directories are the next
    level. The driver holds the roots alone.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in LISTED.split(", ")]
        for frame in frames:
            rows = []
            for folder in frame.folder:
                folders, files = list_folder(folder)
                rows += [(f, None, None, None, None) for f in folders] + [(None, *f) for f in files]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    level = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "folder string")
    listing = spark.createDataFrame([], LISTING)
    while count := level.count():
        # Directories differ in size, so they are dealt out: one a task, until there are more than tasks.
        tasks = min(count, max(spark.sparkContext.defaultParallelism, math.ceil(count / FOLDERS)))
        found = cut(level.distinct().repartition(tasks).mapInPandas(read, LISTED))
        listing = listing.unionByName(found.where("folder IS NULL").drop("folder"))
        level = found.where("folder IS NOT NULL").select("folder")
    return listing.distinct()


def hash_file(path: str) -> str | None:
    """``sha256:`` and the hex digest, read in pieces; None if the file cannot be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while piece := f.read(PIECE):
                digest.update(piece)
    except OSError:
        return None
    return PREFIX + digest.hexdigest()


def hash_documents(paths: DataFrame) -> DataFrame:
    """(normalized_path, content_hash) of ``paths``; NULL where a file cannot be read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content_hash=[hash_file(p) for p in frame.normalized_path])

    return paths.select("normalized_path").mapInPandas(read, "normalized_path string, content_hash string")


def availability(sources: DataFrame) -> DataFrame:
    """``sources`` with ``available``: whether the directory is there now."""
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def there(paths: pd.Series) -> pd.Series:
        return paths.map(os.path.isdir)

    return sources.withColumn("available", there(F.col("normalized_path")))
