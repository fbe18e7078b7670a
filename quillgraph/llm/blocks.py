"""Pairs within groups of any size, and integer codes for values. Shared by the operators here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

#: Members of a group that are paired in one row. A larger group is split into blocks of this size.
BLOCK = 256
#: A group of more rows is hot; there are at most rows / HOT_ROWS of them, and their sizes are broadcast.
HOT_ROWS = 100_000


def pairs_within(df: DataFrame, key: str, member: str, block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, a, b) with a < b: every pair of distinct members that share a key, once per key.

    A member that is stored several times under a key counts once. A group of up to ``block`` members is one row of an
    intermediate table. A larger one is split by a hash of the member into blocks; every pair of
    blocks is a row of its own, so a group that holds a third of all rows is spread over many tasks
    and no row holds more than about two blocks. All pairs come out, however large the group.

    The rows of hot groups learn their group's size from a broadcast, so they stay where they are until
    they are dealt to blocks. ``df`` is read several times, and should be a stored table.
    """
    size = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    hot = size.where(F.col("_n") > hot_rows)
    members = df.select(key, member)
    sized = members.join(size, key)
    if hot.limit(1).count():
        usual = members.join(F.broadcast(hot.select(key)), key, "left_anti").join(size, key)
        sized = members.join(F.broadcast(hot), key).unionByName(usual)
    rows = (
        sized
        .withColumn("_k", F.ceil(F.col("_n") / block).cast("int"))
        .withColumn("_x", F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
        .withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .select(
            key,
            F.least("_x", "_y").alias("_i"),
            F.greatest("_x", "_y").alias("_j"),
            "_x",
            F.col(member).alias("_m"),
        )
    )
    # Repartitioned, else all cells of a hot group would stay where the join put them.
    cells = rows.repartition(key, "_i", "_j").groupBy(key, "_i", "_j").agg(
        F.sort_array(F.collect_set(F.struct("_m", "_x"))).alias("_s"),
    )
    # Both ends by position: the members are sorted, so the second end is a slice, not a filter of all.
    first = cells.select(key, "_i", "_j", "_s", F.posexplode("_s").alias("_p", "_a"))
    rest = F.slice("_s", F.col("_p") + 2, F.greatest(F.size("_s") - F.col("_p") - 1, F.lit(0)))
    other = F.filter(rest, lambda m: (F.col("_i") == F.col("_j")) | (m["_x"] != F.col("_a._x")))
    return first.select(key, F.col("_a._m").alias("a"), F.explode(other).alias("_b")).select(
        key, "a", F.col("_b._m").alias("b")
    )
