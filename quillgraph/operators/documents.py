"""Document copies: listing, identification, inspection, links to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.hints import is_strong
from quillgraph.operators.identity import holders, resolve
from quillgraph.operators.papers import paper_label, paper_records
from quillgraph.schema import IdentificationStatus, ResolutionStatus
from quillgraph.session import cut


# Schemes that a provider is asked for by a hint.
ASKABLE = ("doi", "arxiv")


def documents(copies: DataFrame, paper_id: str | None = None, unlinked_only: bool = False) -> DataFrame:
    """Copies, each once, of one paper and / or without a paper, in the order of paths."""
    rows = copies.distinct()
    if paper_id is not None:
        rows = rows.where(F.col("paper_id") == paper_id)
    if unlinked_only:
        rows = rows.where(F.col("paper_id").isNull())
    return rows.orderBy("normalized_path", "id")


def presence() -> Column:
    return F.when(F.col("missing_since").isNotNull(), "missing").otherwise("present")


def with_paper_labels(copies: DataFrame, paper: DataFrame, identifier: DataFrame) -> DataFrame:
    """(id, normalized_path, presence, paper_id, label): NULL label without a stored paper."""
    rows = copies.distinct().select("id", "normalized_path", presence().alias("presence"), "paper_id")
    wanted = rows.where("paper_id IS NOT NULL").select(F.col("paper_id").alias("id"))
    labels = paper_records(paper, identifier, wanted).select(
        F.col("id").alias("paper_id"),
        paper_label().alias("label"),
    )
    return rows.join(labels, "paper_id", "left").select("id", "normalized_path", "presence", "paper_id", "label")


def minted_paper_id(scheme: Column, normalized: Column) -> Column:
    """The id of a paper that is created for an identifier. It follows from the identifier, so a task
    that runs again, or another document with the same one, gives the same id."""
    digest = F.md5(F.concat(F.lit("paper:"), scheme, F.lit(":"), normalized))
    return F.regexp_replace(digest, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


def assess() -> Column:
    """What identification makes of a resolution, before anything is written. Several identifiers are
    accepted only if one paper already holds them all: a file with an arXiv id and a DOI may well be
    about two papers, a preprint and its published version."""
    agreed = (F.size("identifiers") == 1) | (
        (F.col("status") == ResolutionStatus.matched.value) & (F.size("unassigned") == 0)
    )
    return (
        F.when(F.col("status") == ResolutionStatus.insufficient.value, IdentificationStatus.unidentified.value)
        .when((F.col("status") == ResolutionStatus.ambiguous.value) | ~agreed, IdentificationStatus.ambiguous.value)
        .when(F.col("status") == ResolutionStatus.new.value, IdentificationStatus.created.value)
        .otherwise(IdentificationStatus.linked.value)
    )


def identify(selected: DataFrame, identifier: DataFrame, order: str = "order") -> DataFrame:
    """(document_id, status, paper_id, identifiers, candidate_paper_ids) of documents in scan order.

    ``selected`` has document_id, ``order`` and identifiers, the selected ones. As in a scan that takes
    one document after the other, the first with an unseen identifier creates a paper and later ones
    are linked to it. A paper made so holds one identifier, so it cannot change what becomes of a
    document with several, only appear among its candidates. That makes the scan a few joins.
    """
    # Hints are read from texts once, and the resolution is looked at three times below.
    chosen = cut(selected.select("document_id", F.col(order).alias("_order"), "identifiers"))
    rows = resolve(chosen.select("document_id", "identifiers"), identifier, "document_id")
    rows = cut(rows.withColumn("outcome", assess()).join(chosen.select("document_id", "_order"), "document_id"))
    one = F.get("identifiers", F.lit(0))
    fresh = F.col("outcome") == IdentificationStatus.created.value
    # The first per key by a minimum, which is combined before the shuffle, not by ranking all rows.
    firsts = (
        rows.where(fresh)
        .groupBy(one["scheme"].alias("scheme"), one["normalized_value"].alias("normalized_value"))
        .agg(F.min(F.struct("_order", "document_id")).alias("first"))
        .withColumn("made", minted_paper_id(F.col("scheme"), F.col("normalized_value")))
    )
    single = rows.withColumn("scheme", F.when(fresh, one["scheme"])).withColumn(
        "normalized_value",
        F.when(fresh, one["normalized_value"]),
    )
    single = single.join(firsts, ["scheme", "normalized_value"], "left")
    later = F.col("made").isNotNull() & (F.col("first.document_id") != F.col("document_id"))
    several = rows.where(F.size("identifiers") > 1).select("document_id", "_order", F.explode("identifiers").alias("i"))
    seen = (
        several.join(
            firsts,
            (F.col("i.scheme") == F.col("scheme")) & (F.col("i.normalized_value") == F.col("normalized_value")),
        )
        .where(F.col("first._order") < F.col("_order"))
        .groupBy("document_id")
        .agg(F.collect_set("made").alias("_more"))
    )
    out = single.join(seen, "document_id", "left")
    status = F.when(later, IdentificationStatus.linked.value).otherwise(F.col("outcome"))
    linked = status.isin(IdentificationStatus.created.value, IdentificationStatus.linked.value)
    candidates = F.array_sort(
        F.array_union("candidate_paper_ids", F.coalesce("_more", F.array().cast("array<string>"))),
    )
    return out.select(
        "document_id",
        status.alias("status"),
        F.when(linked, F.coalesce("paper_id", "made")).alias("paper_id"),
        "identifiers",
        F.when(later, F.array("made")).otherwise(candidates).alias("candidate_paper_ids"),
    )


def summary(identified: DataFrame) -> DataFrame:
    """One row: (linked, ambiguous, unidentified), where created counts as linked."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return identified.agg(
        count("linked", "created").alias("linked"),
        count("ambiguous").alias("ambiguous"),
        count("unidentified").alias("unidentified"),
    )


def hint_matches(hints: DataFrame, identifier: DataFrame) -> DataFrame:
    """(document_id, pos, scheme, value, normalized_value, origin, strong, paper_id) of every hint of
    ``hints`` (document_id, hints): whether it decides, and the paper that holds it (the least, if several)."""
    held = holders(identifier).groupBy("scheme", "normalized_value").agg(F.min("paper_id").alias("paper_id"))
    each = hints.select("document_id", F.posexplode("hints").alias("pos", "h"))
    rows = each.select(
        "document_id",
        "pos",
        "h.scheme",
        "h.value",
        "h.normalized_value",
        "h.origin",
        is_strong(F.col("h")).alias("strong"),
    )
    return rows.join(held, ["scheme", "normalized_value"], "left").select(
        "document_id", "pos", "scheme", "value", "normalized_value", "origin", "strong", "paper_id"
    )


def importable(matches: DataFrame) -> DataFrame:
    """Hints that no paper holds and that a provider can be asked for."""
    return matches.where(F.col("paper_id").isNull() & F.col("scheme").isin(*ASKABLE))


def next_steps(documents: DataFrame, matches: DataFrame, paper: DataFrame) -> DataFrame:
    """(document_id, rank, step, target) of unlinked ``documents`` (document_id): what can be done next.

    ``link`` to each paper that holds a hint, in the order of papers; then ``import`` each hint that no
    paper holds and a provider can be asked for, as ``scheme:value``, in the order of hints; ``search``,
    without a target, for a document that has neither, also one without any hint.
    """
    held = matches.where("paper_id IS NOT NULL").select("document_id", "paper_id").distinct()
    known = paper.select(F.col("id").alias("paper_id"), "created_at")
    link = held.join(known, "paper_id").select(
        "document_id", F.lit("link").alias("step"), F.col("paper_id").alias("target"), "created_at", F.lit(0).alias("pos")
    )
    open_hints = importable(matches).select(
        "document_id",
        F.lit("import").alias("step"),
        F.concat("scheme", F.lit(":"), "normalized_value").alias("target"),
        F.lit(None).cast("timestamp").alias("created_at"),
        "pos",
    )
    able = link.unionByName(open_hints)
    order = Window.partitionBy("document_id").orderBy(F.desc("step"), "created_at", "pos", "target")
    ranked = able.select("document_id", F.row_number().over(order).alias("rank"), "step", "target")
    rows = documents.select("document_id").distinct().join(ranked, "document_id", "left")
    return rows.select(
        "document_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce("step", F.lit("search")).alias("step"),
        "target",
    )


def linked(copies: DataFrame, links: DataFrame) -> DataFrame:
    """Copies with the papers of ``links`` (document_id, paper_id); a link replaces an earlier one."""
    new = links.select(F.col("document_id").alias("id"), F.col("paper_id").alias("_new"))
    return copies.join(new, "id", "left").withColumn("paper_id", F.coalesce("_new", "paper_id")).select(copies.columns)


def unlinked(copies: DataFrame, links: DataFrame) -> DataFrame:
    """Copies without the links of ``links``; one to another paper stays."""
    gone = links.select(F.col("document_id").alias("id"), F.col("paper_id").alias("_gone"))
    keep = F.when(F.col("paper_id") == F.col("_gone"), None).otherwise(F.col("paper_id"))
    return copies.join(gone, "id", "left").withColumn("paper_id", keep).select(copies.columns)
