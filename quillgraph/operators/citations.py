"""Storing citations: new edges once, checked against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(new: DataFrame, edges: DataFrame, paper: DataFrame) -> DataFrame:
    """(citing, cited, outcome) of each different incoming edge: created, confirmed, self, or
    unknown_paper, where an end is not stored or NULL.

    Known edges and papers are marks on a row after left joins, so all outcomes come from one pass.
    Known edges come first: both sides lie by both ends already, so that join shuffles nothing again.
    """
    rows = new.select("citing", "cited").distinct()
    ids = paper.select("id").distinct()
    known = edges.select("citing", "cited").distinct().withColumn("_known", F.lit(True))
    a, b = (ids.select(F.col("id").alias(e), F.lit(True).alias(f"_{e}")) for e in ("citing", "cited"))
    marked = rows.join(known, ["citing", "cited"], "left").join(a, "citing", "left").join(b, "cited", "left")
    outcome = (
        F.when(F.col("citing") == F.col("cited"), "self")
        .when(F.col("_citing").isNull() | F.col("_cited").isNull(), "unknown_paper")
        .when(F.col("_known"), "confirmed")
        .otherwise("created")
    )
    return marked.select("citing", "cited", outcome.alias("outcome"))


def upsert(new: DataFrame, edges: DataFrame, paper: DataFrame) -> DataFrame:
    """All edges after storing the valid incoming ones."""
    added = classify(new, edges, paper).where("outcome = 'created'").select("citing", "cited")
    return edges.select("citing", "cited").unionByName(added)
