"""Checks of the stored relations: one row per rule, with the number of rows or keys that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.identity import holders


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of all rules on the tables of ``schema.TABLES``; rows repeated under one id
    count as broken once per key."""
    paper, identifier, source, copy, citation = (
        tables[t] for t in ("paper", "paper_identifier", "scan_source", "document_copy", "citation")
    )
    ids = paper.select(F.col("id").alias("paper_id"))
    end = lambda c: citation.where(F.col(c).isNotNull()).select(F.col(c).alias("paper_id"))
    shared = holders(identifier).groupBy("scheme", "normalized_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    broken = {
        "paper.id repeated": _repeated(paper, "id"),
        "identifier held by several papers": shared,
        "identifier row repeated": _repeated(identifier, "id"),
        "identifier without paper": identifier.where("paper_id IS NOT NULL").join(ids, "paper_id", "left_anti"),
        "source path repeated": _repeated(source, "normalized_path"),
        "document path repeated": _repeated(copy, "normalized_path"),
        "document without its paper": copy.where("paper_id IS NOT NULL").join(ids, "paper_id", "left_anti"),
        "citation repeated": _repeated(citation, "citing_paper_id", "cited_paper_id"),
        "citation of itself": citation.where("citing_paper_id = cited_paper_id"),
        "citation without an end": citation.where("citing_paper_id IS NULL OR cited_paper_id IS NULL"),
        "citing paper not stored": end("citing_paper_id").join(ids, "paper_id", "left_anti"),
        "cited paper not stored": end("cited_paper_id").join(ids, "paper_id", "left_anti"),
    }
    counts = [rows.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(rule).alias("rule"),
        "violations",
    ) for rule, rows in broken.items()]
    return reduce(DataFrame.unionByName, counts)


def equal_contents(copy: DataFrame) -> DataFrame:
    """(content_hash, copies, first_path): contents that lie at several paths."""
    known = copy.where("content_hash IS NOT NULL").select("content_hash", "normalized_path").distinct()
    counts = known.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("normalized_path").alias("first_path"),
    )
    return counts.where("copies > 1")
