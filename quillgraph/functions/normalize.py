"""Normalising external identifiers, as column expressions. NULL stands for an invalid identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import strip

# Prefixes that may precede an identifier, and the forms of identifiers.
DOI_PREFIXES = ("doi:", "https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/")
ARXIV_PREFIX = r"(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)"
OPENALEX_PREFIX = r"(?:openalex:|https?://(?:api\.)?openalex\.org/(?:works/)?)"
ARXIV_NEW = r"\d{4}\.\d{4,5}"
ARXIV_OLD = r"[a-z-]+(?:\.[A-Z]{2})?/\d{7}"
SCHEME = r"[a-z0-9][a-z0-9._-]*"
ARXIV_DOI = "10.48550/arxiv."

_DOI_ANY = "(?:" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
_NO_SPACE = r"[^\s\x1c-\x1f]"


def _lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_scheme(scheme: Column) -> Column:
    """Stripped and in lower case; NULL if that is no scheme name."""
    name = F.lower(strip(scheme))
    return F.when(name.rlike(rf"\A{SCHEME}\z"), name)


def strip_doi_prefix(value: Column) -> Column:
    """Without one prefix, in any case. Nothing is stripped after it."""
    return F.regexp_replace(value, rf"(?i)\A{_DOI_ANY}", "")


def normalize_doi(value: Column) -> Column:
    """A DOI with ASCII letters in lower case; other letters keep their case."""
    doi = strip_doi_prefix(strip(value))
    return F.when(doi.rlike(rf"(?U)\A10\.[^/\s\x1c-\x1f]+/{_NO_SPACE}+\z"), _lower_ascii(doi))


def normalize_arxiv(value: Column) -> Column:
    """An arXiv id without its version."""
    bare = F.regexp_replace(F.regexp_replace(strip(value), rf"(?i)\A{ARXIV_PREFIX}", ""), r"\.pdf\z", "")
    return F.nullif(F.regexp_extract(bare, rf"\A({ARXIV_NEW}|{ARXIV_OLD})(?:v\d+)?\z", 1), F.lit(""))


def normalize_openalex(value: Column) -> Column:
    """A work id, W and digits."""
    bare = F.regexp_replace(strip(value), rf"(?i)\A{OPENALEX_PREFIX}", "")
    return F.when(bare.rlike(r"\A[wW]\d+\z"), F.upper(bare))


def normalize_generic(value: Column) -> Column:
    """Any other scheme: stripped, case kept."""
    return F.nullif(strip(value), F.lit(""))


def normalize_value(scheme: Column, value: Column) -> Column:
    """The normal form of ``value`` under a normalised ``scheme``; NULL if either is invalid."""
    return (
        F.when(scheme == "doi", normalize_doi(value))
        .when(scheme == "arxiv", normalize_arxiv(value))
        .when(scheme == "openalex", normalize_openalex(value))
        .when(scheme.isNotNull(), normalize_generic(value))
    )


def clean_title(title: Column) -> Column:
    """Stripped; blank is NULL."""
    return F.nullif(strip(title), F.lit(""))
