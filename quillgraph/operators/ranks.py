"""Places in an order, without bringing a group or the whole table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut


def numbered(df: DataFrame, order: list[Column | str], by: tuple[str, ...] = (), to: str = "rank") -> DataFrame:
    """``df`` with ``to``, each row's place from 0 on in ``order`` among the rows with equal ``by``.

    Rows are sorted by ranges over all tasks and numbered within each; what lies before a range is the
    sum of the counts of the ranges before it, one row per range and group that occurs in it.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    # The sort and its numbers are read twice, so they are fixed by the checkpoint.
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = rows.alias("r").join(
        offsets.alias("o"),
        [F.col("r._range") == F.col("o._range"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]],
    )
    place = F.col("r._at") - F.col("o._first") + F.col("o._before")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], place.alias(to))
