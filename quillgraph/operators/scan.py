"""Comparing a listing of files with the document copies known so far, per source.

All of it is equi-joins: a path is covered by a source if the source is one of the path's ancestor
directories, and those are spelled out, so there is no prefix join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """All directories above an absolute path, the root first."""
    parts = F.split(path, "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.transform(F.when(F.size(parts) > 1, each), lambda d: F.when(d == "", F.lit("/")).otherwise(d))


def covering(paths: DataFrame, sources: DataFrame, path: str = "normalized_path") -> DataFrame:
    """(path, source_id, source_path): every source above every path of ``paths``."""
    above = paths.select(path, F.explode(ancestors(F.col(path))).alias("source_path"))
    # A root is stored with or without a slash at its end.
    roots = sources.select(
        F.col("id").alias("source_id"),
        F.coalesce(
            F.nullif(F.regexp_replace("normalized_path", r"/+\z", ""), F.lit("")),
            F.lit("/"),
        ).alias("source_path"),
    )
    return above.join(roots, "source_path").select(path, "source_id", "source_path")


def owners(cover: DataFrame, path: str = "normalized_path") -> DataFrame:
    """(path, source_id): the first covering source in the order of paths."""
    return cover.groupBy(path).agg(F.min(F.struct("source_path", "source_id"))["source_id"].alias("source_id"))


def scan_diff(listing: DataFrame, copies: DataFrame, sources: DataFrame) -> DataFrame:
    """What a scan finds, one row per path that a scanned source covers.

    ``listing`` has normalized_path, file_size, file_mtime_ns and readable (NULL counts as true) of the
    files found under the sources; ``sources`` has id, normalized_path and available, and holds the
    sources to scan. Rows: (normalized_path, document_id, source_id, state, reappeared). ``state`` is
    new, changed, same, unreadable, missing, or gone (missing before). A file is stale, and so changed, if its
    copy has no hash or another size or time. Every path belongs to the first available source above
    it, so nested sources do not count it twice. Paths under no available source are left alone and
    do not come out. Rows that occur twice count once.
    """
    able = sources.where("available")
    files = listing.groupBy("normalized_path").agg(
        F.max(F.struct("file_mtime_ns", "file_size", F.coalesce("readable", F.lit(True)).alias("readable"))).alias("f")
    )
    known = copies.groupBy("normalized_path").agg(
        F.max(F.struct("id", "content_hash", "file_size", "file_mtime_ns", "missing_since")).alias("c"),
    )
    both = files.join(known, "normalized_path", "full_outer")
    owned = both.join(owners(covering(both.select("normalized_path"), able)), "normalized_path")
    same_file = (F.col("c.file_size") == F.col("f.file_size")) & (F.col("c.file_mtime_ns") == F.col("f.file_mtime_ns"))
    state = (
        F.when(F.col("f").isNull(), F.when(F.col("c.missing_since").isNull(), "missing").otherwise("gone"))
        .when(~F.col("f.readable"), "unreadable")
        .when(F.col("c").isNull(), "new")
        .when(F.col("c.content_hash").isNull() | ~F.coalesce(same_file, F.lit(False)), "changed")
        .otherwise("same")
    )
    back = F.col("f").isNotNull() & F.col("f.readable") & F.col("c.missing_since").isNotNull()
    return owned.select(
        "normalized_path",
        F.col("c.id").alias("document_id"),
        "source_id",
        state.alias("state"),
        F.coalesce(back, F.lit(False)).alias("reappeared"),
        F.col("f.file_size").alias("file_size"),
        F.col("f.file_mtime_ns").alias("file_mtime_ns"),
    )


def scan_counters(listing: DataFrame, diff: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, normalized_path, available, found, new, changed, reappeared, missing) of every
    source to scan; zeros for one that is not available. ``found`` counts a file under every source."""
    paths = listing.select("normalized_path").distinct()
    found = covering(paths, sources.where("available")).groupBy("source_id").agg(F.count(F.lit(1)).alias("found"))
    counted = diff.groupBy("source_id").agg(
        *[
            F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "missing")
        ], F.count_if("reappeared").alias("reappeared")
    )
    rows = sources.select(
        F.col("id").alias("source_id"),
        "normalized_path",
        "available",
    ).join(found, "source_id", "left").join(counted, "source_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "new", "changed", "reappeared", "missing")]
    return rows.select("source_id", "normalized_path", "available", *zero)


def apply_scan(copies: DataFrame, diff: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """The document copies after a scan. ``hashes`` has normalized_path and content_hash of the stale
    files; one without hash could not be read and stays as it was. A new copy's id follows from its
    path, so the same scan gives the same ids."""
    new_id = F.regexp_replace(
        F.md5(F.concat(F.lit("document:"), "normalized_path")),
        r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z",
        "$1-$2-$3-$4-$5",
    )
    change = diff.select(
        "normalized_path",
        "state",
        F.col("file_size").alias("_size"),
        F.col("file_mtime_ns").alias("_time"),
    ).join(
        hashes.select("normalized_path", F.col("content_hash").alias("_hash")), "normalized_path", "left"
    )
    rows = copies.join(change, "normalized_path", "full_outer")
    stale = F.col("state").isin("new", "changed") & F.col("_hash").isNotNull()
    seen = stale | (F.col("state") == "same")
    pick = lambda new, old: F.when(stale, F.col(new)).otherwise(F.col(old)).alias(old)
    out = rows.where(F.col("id").isNotNull() | stale).select(
        F.coalesce("id", new_id).alias("id"),
        "paper_id",
        F.coalesce("path", "normalized_path").alias("path"),
        "normalized_path",
        pick("_hash", "content_hash"),
        pick("_size", "file_size"),
        pick("_time", "file_mtime_ns"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(seen, None).when(
            F.col("state") == "missing",
            now,
        ).otherwise(F.col("missing_since")).alias("missing_since"),
        F.coalesce("created_at", now).alias("created_at"),
    )
    return out
