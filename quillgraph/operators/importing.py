"""Importing works as papers, filling metadata, and search candidates, for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.documents import minted_paper_id
from quillgraph.operators.identity import KEYS, resolve, shares_identifier, without
from quillgraph.operators.works import LOOKUP_ORDER, lookup, with_keys
from quillgraph.schema import CandidateStatus, ImportStatus, MetadataStatus, ResolutionStatus
from quillgraph.session import cut


def import_status(requests: DataFrame, works: DataFrame, identifier: DataFrame, key: str) -> DataFrame:
    """(key, status, work_id, paper_id, title, publication_year, identifiers, added, ignored, candidate_paper_ids)
    of each request, as if it were the only one.

    ``requests`` has ``key`` and normalised ``identifiers``. A work is trusted only if it shares an
    identifier with the request, else unconfirmed. It is ambiguous if several papers hold its
    identifiers; matched if one does, created if none. Only the work's identifiers are ever attached;
    those of the request that it lacks are ``ignored``. A request that finds no work has NULL status and work.
    """
    works = normalized_once(works)
    found = requests.select(key, "identifiers").join(lookup(requests, works, key), key, "left")
    known = works.select("work_id", "title", "publication_year", "keys")
    rows = cut(
        found.select(key, F.col("identifiers").alias("asked"), "work_id").join(known, "work_id", "left")
    )  # resolved, and joined to its resolution
    outcome = resolve(
        rows.where("work_id IS NOT NULL").select(key, F.col("keys").alias("identifiers")),
        identifier,
        key,
    )
    both = rows.join(outcome.withColumnRenamed("status", "resolution"), key, "left")
    sure = shares_identifier(F.col("asked"), F.col("keys"))
    first = F.try_element_at("keys", F.lit(1))
    status = (
        F.when(F.col("work_id").isNull(), None)
        .when(~sure, ImportStatus.unconfirmed.value)
        .when(F.col("resolution") == ResolutionStatus.ambiguous.value, ImportStatus.ambiguous.value)
        .when(F.col("resolution") == ResolutionStatus.new.value, ImportStatus.created.value)
        .otherwise(ImportStatus.matched.value)
    )
    none = F.array().cast(KEYS)
    rows = both.withColumn("status", status)
    done = F.col("status").isin(ImportStatus.created.value, ImportStatus.matched.value)
    confirmed = F.col("status") != ImportStatus.unconfirmed.value
    return rows.select(
        key,
        "status",
        "work_id",
        F.when(
            done,
            F.coalesce("paper_id", minted_paper_id(first["scheme"], first["normalized_value"])),
        ).alias("paper_id"),
        "title",
        "publication_year",
        F.when(confirmed, F.col("keys")).otherwise(F.col("asked")).alias("identifiers"),
        F.when(done, F.col("unassigned")).otherwise(none).alias("added"),
        F.when(confirmed, without(F.col("asked"), F.col("keys"))).otherwise(none).alias("ignored"),
        F.when(
            confirmed,
            F.col("candidate_paper_ids"),
        ).otherwise(F.array().cast("array<string>")).alias("candidate_paper_ids"),
    )


def normalized_once(works: DataFrame) -> DataFrame:
    """``works`` with ``keys``, which are made once although works are read several times."""
    return works if "keys" in works.columns else cut(with_keys(works))


def candidates(found: DataFrame, identifier: DataFrame) -> DataFrame:
    """(work_id, status, title, publication_year, identifiers, paper_id, candidate_paper_ids) of works
    found by a search: new, existing or ambiguous. Works without a usable identifier do not come out."""
    keyed = normalized_once(found).where(F.size("keys") > 0)
    outcome = resolve(keyed.select("work_id", F.col("keys").alias("identifiers")), identifier, "work_id")
    status = (
        F.when(F.col("status") == ResolutionStatus.matched.value, CandidateStatus.existing.value)
        .when(F.col("status") == ResolutionStatus.ambiguous.value, CandidateStatus.ambiguous.value)
        .otherwise(CandidateStatus.new.value)
    )
    return keyed.select("work_id", "title", "publication_year").join(outcome, "work_id").select(
        "work_id", status.alias("status"), "title", "publication_year", "identifiers", "paper_id", "candidate_paper_ids"
    )


def import_choice(identifiers: str = "identifiers"):
    """The identifier to import a new candidate by: its work id, else its DOI."""
    of = lambda scheme: F.try_element_at(F.filter(identifiers, lambda i: i["scheme"] == scheme), F.lit(1))
    return F.coalesce(of("openalex"), of("doi"))


def metadata_fill(paper: DataFrame, identifier: DataFrame, works: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(paper_id, status, title, publication_year, title_set, year_set, added) of papers, or those of
    ``of`` (id), whose work the provider knows.

    A work whose identifiers belong to another paper, or to several, is a conflict; one that shares
    none with the paper is unconfirmed. Else its title and year fill what is NULL, never more, and
    identifiers that nobody holds are added.
    """
    rows = paper if of is None else paper.join(of.select("id"), "id", "left_semi")
    works = normalized_once(works)
    # Of every scheme only the first identifier, in the order of normal forms, is asked for.
    first = lambda s: F.min(F.when(F.col("scheme") == s, F.col("normalized_value"))).alias(s)
    held = identifier.where(F.col("normalized_value").isNotNull() & F.col("scheme").isin(*LOOKUP_ORDER))
    keys = held.groupBy("paper_id").agg(*[first(s) for s in LOOKUP_ORDER])
    key = lambda s: F.when(
        F.col(s).isNotNull(),
        F.struct(F.lit(s).alias("scheme"), F.col(s).alias("value"), F.col(s).alias("normalized_value")),
    )
    asked = keys.select("paper_id", F.array_compact(F.array(*[key(s) for s in LOOKUP_ORDER])).alias("identifiers"))
    asked = asked.join(rows.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    hits = cut(
        lookup(asked, works, "paper_id").join(works.select("work_id", "title", "publication_year", "keys"), "work_id")
    )  # resolved, and joined to its resolution
    outcome = resolve(
        hits.select(F.col("paper_id").alias("asked_by"), F.col("keys").alias("identifiers")),
        identifier,
        "asked_by",
    )
    own = rows.select(
        F.col("id").alias("asked_by"),
        F.col("title").alias("old_title"),
        F.col("publication_year").alias("old_year"),
    )
    known = hits.select(
        F.col("paper_id").alias("asked_by"),
        F.col("title").alias("new_title"),
        F.col("publication_year").alias("new_year"),
    )
    both = own.join(known, "asked_by").join(outcome, "asked_by")
    conflict = (F.col("status") == ResolutionStatus.ambiguous.value) | (
        F.col("paper_id").isNotNull() & (F.col("paper_id") != F.col("asked_by"))
    )
    status = F.when(conflict, MetadataStatus.conflict.value).when(
        F.col("paper_id").isNull(),
        MetadataStatus.unconfirmed.value,
    ).otherwise(MetadataStatus.updated.value)
    rows = both.withColumn("outcome", status)
    updated = F.col("outcome") == MetadataStatus.updated.value
    fill = lambda old, new: F.when(updated, F.coalesce(old, new)).otherwise(F.col(old))
    gained = lambda old, new: updated & F.col(old).isNull() & F.col(new).isNotNull()
    return rows.select(
        F.col("asked_by").alias("paper_id"),
        F.col("outcome").alias("status"),
        fill("old_title", "new_title").alias("title"),
        fill("old_year", "new_year").alias("publication_year"),
        gained("old_title", "new_title").alias("title_set"),
        gained("old_year", "new_year").alias("year_set"),
        F.when(updated, F.col("unassigned")).otherwise(F.array().cast(KEYS)).alias("added"),
    )
