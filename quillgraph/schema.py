"""The stored relations, and closed vocabularies of results."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*c) for c in columns])


_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()

#: Library membership is ``library_added_at`` not being NULL. A title is metadata, never identity.
PAPER = _table(
    ("id", _S, False), ("title", _S, True), (
        "publication_year",
        T.IntegerType(),
        True,
    ), ("created_at", _TS, False), ("library_added_at", _TS, True)
)
PAPER_IDENTIFIER = _table(
    ("id", _S, False),
    ("paper_id", _S, False),
    ("scheme", _S, False),
    ("value", _S, False),
    ("normalized_value", _S, True),
)
SCAN_SOURCE = _table(
    ("id", _S, False),
    ("path", _S, False),
    ("normalized_path", _S, False),
    ("created_at", _TS, False),
    ("last_scanned_at", _TS, True),
)
DOCUMENT_COPY = _table(
    ("id", _S, False), ("paper_id", _S, True), ("path", _S, False), ("normalized_path", _S, False), ("content_hash", _S, True),
    ("file_size", _L, True), ("file_mtime_ns", _L, True), ("last_seen_at", _TS, True), ("missing_since", _TS, True), ("created_at", _TS, False),
)
CITATION = _table(
    ("id", _S, False),
    ("citing_paper_id", _S, True),
    ("cited_paper_id", _S, True),
    ("created_at", _TS, False),
)

TABLES = {
    "paper": PAPER,
    "paper_identifier": PAPER_IDENTIFIER,
    "scan_source": SCAN_SOURCE,
    "document_copy": DOCUMENT_COPY,
    "citation": CITATION,
}

#: A work as a provider reports it. ``works`` are rows of this; ``referenced_works`` are its work ids.
IDENTIFIER = T.StructType([T.StructField("scheme", _S), T.StructField("value", _S)])
WORK = _table(
    ("work_id", _S, False), (
        "identifiers",
        T.ArrayType(IDENTIFIER),
        True,
    ), ("title", _S, True), ("publication_year", T.IntegerType(), True),
    ("referenced_works", T.ArrayType(_S), True), ("cited_by_count", _L, True),
)


class Direction(StrEnum):
    references = "references"
    citations = "citations"
    both = "both"


class ResolutionStatus(StrEnum):
    new = "new"
    matched = "matched"
    ambiguous = "ambiguous"
    insufficient = "insufficient"


class IdentificationStatus(StrEnum):
    created = "created"
    linked = "linked"
    ambiguous = "ambiguous"
    unidentified = "unidentified"


class ImportStatus(StrEnum):
    created = "created"
    matched = "matched"
    ambiguous = "ambiguous"
    unconfirmed = "unconfirmed"


class CandidateStatus(StrEnum):
    new = "new"
    existing = "existing"
    ambiguous = "ambiguous"


class MetadataStatus(StrEnum):
    updated = "updated"
    unconfirmed = "unconfirmed"
    conflict = "conflict"


class HintOrigin(StrEnum):
    filename = "filename"
    pdf_metadata = "pdf_metadata"
    pdf_text = "pdf_text"
