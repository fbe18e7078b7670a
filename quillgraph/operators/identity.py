"""Resolving identifiers to papers. Identity is an exact normalised identifier, never a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.hints import KEYS, first_wins
from quillgraph.functions.normalize import normalize_scheme, normalize_value
from quillgraph.schema import ResolutionStatus


def normalized_identifiers(identifiers: Column) -> Column:
    """array<struct<scheme, value>> to normalised ones, without invalid ones, each key once, the first
    staying. NULL counts as none."""
    each = F.transform(
        identifiers,
        lambda i: F.struct(
            normalize_scheme(i["scheme"]).alias("scheme"),
            i["value"].alias("value"),
            normalize_value(normalize_scheme(i["scheme"]), i["value"]).alias("normalized_value"),
        ),
    )
    valid = F.coalesce(F.filter(each, lambda i: i["normalized_value"].isNotNull()), F.array().cast(KEYS))
    return first_wins(valid, KEYS, "scheme", "normalized_value")


def invalid_identifiers(identifiers: Column) -> Column:
    """Those that the strict mode rejects: (scheme, value) without a normal form."""
    bad = F.filter(identifiers, lambda i: normalize_value(normalize_scheme(i["scheme"]), i["value"]).isNull())
    return F.coalesce(bad, F.array().cast("array<struct<scheme:string,value:string>>"))


def holders(identifier: DataFrame) -> DataFrame:
    """(scheme, normalized_value, paper_id), each once: who holds a key. Normally one paper."""
    known = identifier.where(F.col("normalized_value").isNotNull() & F.col("paper_id").isNotNull())
    return known.select("scheme", "normalized_value", "paper_id").distinct()


def resolve(groups: DataFrame, identifier: DataFrame, key: str) -> DataFrame:
    """(key, status, identifiers, paper_id, candidate_paper_ids, unassigned) of every input group.

    ``groups`` has ``key``, unique, and ``identifiers``, normalised ones. A group whose keys are held by
    no paper is new, by one matched, by several ambiguous; one without keys, or with NULL, is
    insufficient. Candidates come in the order of ids; ``unassigned`` are the keys that nobody holds.
    The groups are read once: what a group holds is brought together again with what is known of it.
    """
    keys = groups.select(key, F.posexplode_outer("identifiers").alias("_pos", "_i")).select(
        key,
        "_pos",
        F.col("_i.scheme").alias("scheme"),
        F.col("_i.value").alias("value"),
        F.col("_i.normalized_value").alias("normalized_value"),
    )
    held = keys.join(holders(identifier), ["scheme", "normalized_value"], "left")
    own = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "scheme", "value", "normalized_value"))
    bare = lambda c: F.transform(
        c,
        lambda i: F.struct(*[i[f].alias(f) for f in ("scheme", "value", "normalized_value")]),
    ).cast(KEYS)
    outcome = held.groupBy(key).agg(
        F.array_sort(F.collect_set("paper_id")).alias("candidate_paper_ids"),
        # A key with several holders is there as often, and counts once.
        F.sort_array(F.collect_set(own)).alias("_own"),
        F.sort_array(F.collect_list(F.when(F.col("paper_id").isNull(), own))).alias("_free"),
    )
    count = F.size("candidate_paper_ids")
    status = (
        F.when(F.size("_own") == 0, ResolutionStatus.insufficient.value)
        .when(count == 0, ResolutionStatus.new.value)
        .when(count == 1, ResolutionStatus.matched.value)
        .otherwise(ResolutionStatus.ambiguous.value)
    )
    return outcome.select(
        key,
        status.alias("status"),
        bare("_own").alias("identifiers"),
        F.when(count == 1, F.get("candidate_paper_ids", F.lit(0))).alias("paper_id"),
        "candidate_paper_ids",
        bare("_free").alias("unassigned"),
    )


def keys_of(identifiers: Column) -> Column:
    """The comparable part of identifiers: structs (scheme, normalized_value)."""
    return F.transform(
        identifiers,
        lambda i: F.struct(i["scheme"].alias("scheme"), i["normalized_value"].alias("normalized_value")),
    )


def shares_identifier(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(keys_of(a), keys_of(b)), F.lit(False))


def without(a: Column, b: Column) -> Column:
    """Identifiers of ``a`` whose key is not among those of ``b``."""
    other = keys_of(b)
    return F.filter(
        a,
        lambda i: ~F.array_contains(
            other,
            F.struct(i["scheme"].alias("scheme"), i["normalized_value"].alias("normalized_value")),
        ),
    )


def conflicts(identifier: DataFrame) -> DataFrame:
    """(scheme, normalized_value, paper_id): every holder of the keys that more than one paper holds. A
    row per holder, as one key may be held by any number of papers."""
    held = holders(identifier)
    ends = held.groupBy("scheme", "normalized_value").agg(F.min("paper_id").alias("_a"), F.max("paper_id").alias("_z"))
    shared = ends.where(F.col("_a") != F.col("_z")).select("scheme", "normalized_value")
    return held.join(shared, ["scheme", "normalized_value"], "left_semi")
