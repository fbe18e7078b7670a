"""Papers with their identifiers, labels, filters and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIERS = "array<struct<scheme:string,normalized_value:string,value:string>>"


def paper_identifiers(identifier: DataFrame) -> DataFrame:
    """(paper_id, identifiers): sorted by scheme and normal form. Rows without a normal form are no
    identifiers; a key that a paper holds twice counts once, with its least spelling."""
    known = identifier.where(F.col("normalized_value").isNotNull() & F.col("paper_id").isNotNull())
    # The set is combined map-side; the least spelling of a key is taken before, so it is small.
    keys = known.groupBy("paper_id", "scheme", "normalized_value").agg(F.min("value").alias("value"))
    return keys.groupBy("paper_id").agg(
        F.sort_array(F.collect_list(F.struct("scheme", "normalized_value", "value"))).alias("identifiers"),
    )


def paper_records(paper: DataFrame, identifier: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Papers with nested identifiers and Library membership; only those of ``ids`` (id), if given,
    where unknown ids are skipped. Both sides are reduced to the ids before they are joined."""
    if ids is not None:
        wanted = ids.select("id").distinct()
        paper = paper.join(wanted, "id", "left_semi")
        identifier = identifier.join(wanted.withColumnRenamed("id", "paper_id"), "paper_id", "left_semi")
    nested = paper_identifiers(identifier).withColumnRenamed("paper_id", "id")
    return paper.join(nested, "id", "left").select(
        "id",
        "title",
        "publication_year",
        "created_at",
        F.coalesce("identifiers", F.array().cast(IDENTIFIERS)).alias("identifiers"),
        in_library().alias("in_library"),
    )


def in_library() -> Column:
    return F.col("library_added_at").isNotNull()


def library(paper: DataFrame) -> DataFrame:
    return paper.where(in_library())


def identifier_text(identifiers: str = "identifiers") -> Column:
    """``scheme:value`` of every identifier, in their order."""
    return F.array_join(
        F.transform(identifiers, lambda i: F.concat(i["scheme"], F.lit(":"), i["normalized_value"])),
        " ",
    )


def primary_identifier(identifiers: str = "identifiers") -> Column:
    """The first DOI, else the first arXiv id, else the first of any scheme, as ``scheme:value``."""
    of = lambda a: F.try_element_at(a, F.lit(1))
    best = F.coalesce(
        of(F.filter(identifiers, lambda i: i["scheme"] == "doi")),
        of(F.filter(identifiers, lambda i: i["scheme"] == "arxiv")),
        of(F.col(identifiers)),
    )
    return F.concat(best["scheme"], F.lit(":"), best["normalized_value"])


def paper_label() -> Column:
    """Title, else the primary identifier, else the first eight characters of the id."""
    return F.coalesce(F.nullif("title", F.lit("")), primary_identifier(), F.substring("id", 1, 8))


def short_label(width: int = 40) -> Column:
    """For a node of a drawing: the title, cut at ``width``, else the first identifier, else the id."""
    first = F.try_element_at(F.col("identifiers"), F.lit(1))
    title = F.when(
        F.length("title") > width,
        F.concat(F.substring("title", 1, width), F.lit("…")),
    ).otherwise(F.nullif("title", F.lit("")))
    return F.coalesce(title, F.concat(first["scheme"], F.lit(":"), first["normalized_value"]), F.substring("id", 1, 8))


def text_filter(query: str) -> Column:
    """Whether title, identifiers as typed, and id contain ``query``, without case and white space."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    values = F.array_join(F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit(":"), i["value"])), " ")
    return bare(F.concat_ws(" ", "title", values, "id")).contains(bare(F.lit(query)))


def totals(paper: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: (papers, library, citations)."""
    papers = paper.agg(F.count(F.lit(1)).alias("papers"), F.count_if(in_library()).alias("library"))
    return papers.withColumn("citations", edges.agg(F.count(F.lit(1))).scalar())


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node of ``nodes``; 0 without edges.

    Both ends go into one aggregation, so there is one shuffle, with counts combined before it.
    """
    ends = edges.select(F.col("citing").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("cited").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    every = ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    known = every.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return known.join(nodes.select("id"), "id", "left_semi")


def most_cited(edges: DataFrame, count: int = 5) -> DataFrame:
    """The ``count`` papers with the most citations, ties by id; a paper without any never appears."""
    from quillgraph.operators.heavy_keys import salted_aggregate

    per_key = salted_aggregate(
        edges,
        "cited",
        [F.col("citing")],
        {"citations": F.count(F.lit(1))},
        {"citations": F.sum},
    )
    return per_key.select(F.col("cited").alias("id"), "citations").orderBy(F.desc("citations"), "id").limit(count)
