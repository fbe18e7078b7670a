"""Aggregation per key where a few keys hold most rows.

``salted_counts`` aggregates in two stages. Keys that hold more than a stated share of the rows get a
salt, so that their rows spread over many tasks; the partial results of all salts are merged by key.
All other keys keep salt 0, so they cost no more than in a plain aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

#: Salts of a heavy key.
SALTS = 64
#: A key is heavy from this share of all rows on; so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1 / 2000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold at least ``share`` of the rows of ``df``: (key, rows of the key, of all).

    Counts are combined before the shuffle. The result has at most ``1 / share`` rows. NULL keys are
    no keys. An empty input gives an empty result.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__qg_n"))
    # One partial sum per partition goes to one task: a scalar subquery, not a window over all keys.
    total = counts.agg(F.sum("__qg_n").alias("__qg_all")).scalar()
    return counts.where(F.col("__qg_n") >= F.lit(share) * total)


def salted_aggregate(
    df: DataFrame,
    key: str,
    spread: Sequence[Column],
    partial: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    heavy: DataFrame | None = None,
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Aggregates per ``key``, without a task that holds all rows of a heavy key.

    ``partial`` names the aggregates of the first stage, per key and salt; ``merge`` gives, for each
    of them, the aggregate that merges partial results (``F.sum`` for counts, ``F.min`` for minima).
    ``heavy`` are the heavy keys (one column named as ``key``, at most ``1 / share`` rows) where the
    caller finds them more cheaply than by counting ``df``; they decide how rows spread, never what
    comes out. ``spread`` are the columns the salt is hashed from. It depends on the row alone, so a task that
    is run again gives the same salts.

    Rows with a NULL key form one result row with a NULL key, salted as any heavy key is. Repeated
    rows count as often as they occur. An empty input gives an empty result. Further columns of
    ``df`` are ignored, whatever their names.
    """
    if heavy is None:
        heavy = heavy_keys(df, key, share)
    heavy = F.broadcast(heavy.select(F.col(key).alias("__qg_heavy")))  # <= 1 / share rows
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = df.join(heavy, F.col(key) == F.col("__qg_heavy"), "left").withColumn(
        "__qg_salt", F.when(F.col("__qg_heavy").isNotNull() | F.col(key).isNull(), salt).otherwise(F.lit(0))
    )
    first = salted.groupBy(key, "__qg_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(key).agg(*[merge[n](n).alias(n) for n in partial])


def keyed_semi_join(df: DataFrame, key: str, among: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``among`` (one column of that name).

    Rows of the ``heavy`` keys, at most ``1 / share`` (see ``heavy_keys``), are looked up in a broadcast and
    stay where they are, so no task gathers them; the others are shuffled by key. ``heavy`` decides how
    rows move, never what comes out. Rows with a NULL key are left out.
    """
    hot = cut(heavy.select(key))  # read twice
    if not hot.limit(1).count():
        return df.join(among, key, "left_semi")
    usual = df.join(F.broadcast(hot), key, "left_anti").join(among, key, "left_semi")
    return df.join(F.broadcast(hot.join(among, key, "left_semi")), key, "left_semi").unionByName(usual)


def distinct_citations(citation: DataFrame) -> DataFrame:
    """(citing, cited, first_at, last_at): each citation once, however often it is stored.

    Either end missing, or both ends equal, is no citation. The cited paper need not be stored. The
    shuffle is on both ends, so a hot paper at one end does not gather in a task.
    """
    return (
        citation.where(
            F.col("citing_paper_id").isNotNull()
            & F.col("cited_paper_id").isNotNull()
            & (F.col("citing_paper_id") != F.col("cited_paper_id"))
        )
        .groupBy(F.col("citing_paper_id").alias("citing"), F.col("cited_paper_id").alias("cited"))
        .agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    )


def cited_paper_summary(citation: DataFrame, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """(cited_paper_id, citations, first_at, last_at) of every cited paper.

    See ``distinct_citations`` for what counts. ``created_at`` may be NULL: such rows count, and
    first and last are taken over the known times, NULL if there is none.
    """
    edges = distinct_citations(citation)
    # Rows as stored name the same heavy keys and cost one column of the scan, not a second distinct.
    heavy = heavy_keys(citation, "cited_paper_id", share).select(F.col("cited_paper_id").alias("cited"))
    return salted_aggregate(
        edges,
        "cited",
        [F.col("citing")],
        {"citations": F.count(F.lit(1)), "first_at": F.min("first_at"), "last_at": F.max("last_at")},
        {"citations": F.sum, "first_at": F.min, "last_at": F.max},
        heavy=heavy,
        salts=salts,
    ).select(F.col("cited").alias("cited_paper_id"), "citations", "first_at", "last_at")


def most_cited(citation: DataFrame, share: float = 1 / 40) -> DataFrame:
    """The papers that receive at least ``share`` of all citations, with their counts.

    ``share`` is exact: ``citations >= share * total``, computed over integers for ``1 / k``.
    """
    per_key = cited_paper_summary(citation).select("cited_paper_id", "citations")
    total = per_key.agg(F.sum("citations")).scalar()
    return per_key.where(F.col("citations") * F.lit(round(1 / share)) >= total)

