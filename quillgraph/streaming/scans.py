"""Scans as a stream: listings arrive in folders, and each is compared with the stored copies.

An addition to the library's own scan, for sources that report their listings continuously. A listing
may consist of any number of files, so its folder is announced, once it is complete, by a row in a file
of its own; the announcements are what is streamed. The state is the stored table itself, so a listing
that is stored again after a failure changes nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.scan import apply_scan, scan_diff
from quillgraph.session import cut
from quillgraph.sources.catalog import Catalog
from quillgraph.sources.files import LISTING

#: A listing's rows carry the source's state and, for stale files, the hash.
ROWS = f"{LISTING}, content_hash string"
#: An announcement: the folder of a complete listing, and when it was complete.
ANNOUNCED = "listing string, complete_at timestamp"
#: Files of announcements read at once.
ANNOUNCEMENTS = 100


def scan_batch(catalog: Catalog, listing: DataFrame) -> dict[str, int]:
    """Store one complete listing of all sources; gives how many files were in each state."""
    at = catalog.pointer()
    copies, sources = catalog.table("document_copy", at), catalog.table("scan_source", at).withColumn("available", F.lit(True))
    diff = cut(scan_diff(listing, copies, sources))
    changed = apply_scan(
        copies,
        diff,
        listing.select("normalized_path", "content_hash").distinct(),
        F.current_timestamp(),
    )
    catalog.commit({"document_copy": changed}, at)
    return {r.state: r["count"] for r in diff.groupBy("state").count().collect()}


def scan_stream(
    spark: SparkSession,
    catalog: Catalog,
    folder: str,
    checkpoint: str,
    done: Callable[[str, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """A stream that stores each listing announced in ``folder`` (Parquet rows of ``ANNOUNCED``), one
    after the other by time, then name. ``done`` is told a listing's folder and its states."""
    rows = spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", ANNOUNCEMENTS).parquet(folder)

    def store(batch: DataFrame, number: int) -> None:
        for row in batch.distinct().orderBy("complete_at", "listing").collect():  # a few names
            states = scan_batch(catalog, cut(spark.read.schema(ROWS).parquet(row.listing)))
            if done:
                done(row.listing, states)

    return rows.writeStream.option(
        "checkpointLocation",
        checkpoint,
    ).foreachBatch(store).trigger(availableNow=True).start()


def citation_counts(stream: DataFrame, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """(window, cited_paper_id, citations) of a stream of citations (citing, cited, created_at): counts
    per week of creation, for rows up to ``late`` behind the newest. A citation that is recorded again
    within that time, under whatever time or id, counts once, where it came first."""
    valid = stream.where(F.col("citing_paper_id") != F.col("cited_paper_id")).withWatermark("created_at", late)
    once = valid.dropDuplicatesWithinWatermark(["citing_paper_id", "cited_paper_id"])
    return once.groupBy(F.window("created_at", window), "cited_paper_id").agg(F.count(F.lit(1)).alias("citations"))
