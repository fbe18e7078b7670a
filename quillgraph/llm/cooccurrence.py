"""Items that appear together in the same baskets, and how much more often than by chance.

Method: items are deduplicated per basket, ordered pairs are emitted per basket, counts are combined
before they are shuffled, and lift and pointwise mutual information come from the marginals.

Items are replaced by integers first, so the pairs, which are the bulk of the data, are two integers
each. Baskets of any size are paired in blocks (``blocks.pairs_within``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.blocks import BLOCK, pairs_within
from quillgraph.session import cut

#: Baskets of more items are asked for pairs, and paired by classes of items.
HUGE = 2000
#: Rows of a basket that a task brings together.
SPLIT = 1_000_000


def baskets(
    df: DataFrame,
    basket: str,
    item: str,
    least: int = 1,
    keep: Column | None = None,
    split: int = SPLIT,
) -> DataFrame:
    """(basket, item, n), each basket's items once, with its size n, of the baskets that hold at least
    ``least`` different items.

    Rows with a NULL basket or item, or that fail ``keep``, do not count. Rows are brought together by
    basket, once, and made distinct, counted and left there. A basket of more than ``split`` rows is not:
    its rows are made distinct by both columns, so they spread, and then counted; there are at most rows /
    ``split`` such baskets.
    """
    known = F.col(basket).isNotNull() & F.col(item).isNotNull()
    rows = df.where(known if keep is None else known & keep)
    rows = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    large = cut(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split).select("basket"))
    some = large.limit(1).count()
    usual = rows.join(large, "basket", "left_anti") if some else rows
    own = Window.partitionBy("basket")
    usual = usual.repartition("basket").distinct().withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n") >= least)
    if not some:
        return usual.select("basket", "item", "n")
    spread = rows.join(large, "basket", "left_semi").distinct()
    sizes = spread.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return usual.select("basket", "item", "n").unionByName(spread.join(sizes, "basket").select("basket", "item", "n"))


def _count(members: DataFrame) -> DataFrame:
    """(a, b, n_ab): pairs of codes by the number of baskets that hold both."""
    return pairs_within(members, "basket", "code").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))


def _lifted(n_ab: str, n_a: str, n_b: str, total: int, least: int | None) -> Column:
    """n_ab * N >= least * n_a * n_b, in exact integers; true without a limit."""
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    return F.lit(True) if least is None else exact(n_ab) * F.lit(total) >= exact(n_a) * exact(n_b) * F.lit(least)


def pair_counts(
    members: DataFrame,
    least_together: int = 1,
    huge: int = HUGE,
    total: int = 0,
    least_lift: int | None = None,
) -> DataFrame:
    """(a, b, n_ab), a < b, of the codes of (basket, code) rows that share ``least_together`` baskets.

    Baskets of up to ``huge`` items are paired, and the pairs counted. A basket of more items, which may
    hold a third of all rows, is asked which of those pairs it holds, by two joins. Pairs that only huge
    baskets hold come from ``huge_pairs``. All of it holds for any number of huge baskets. ``least_lift``
    of ``total`` baskets may leave out pairs that cannot reach it; ``members`` then has ``n``, how many
    baskets hold the code.
    """
    sizes = members.groupBy("basket").agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > huge).select("basket"))  # at most rows / huge
    if not large.limit(1).count():
        return _count(members).where(F.col("n_ab") >= least_together)
    held = cut(members.join(large, "basket", "left_semi"))
    near = _count(members.join(large, "basket", "left_anti"))
    # No pair lies in more huge baskets than its rarer item, so most need not be asked for.
    often = held.groupBy("code").agg(F.count(F.lit(1)).alias("h"))
    h = lambda end: often.select(F.col("code").alias(end), F.col("h").alias(f"h_{end}"))
    near = near.join(h("a"), "a", "left").join(h("b"), "b", "left")
    most = F.coalesce(F.least("h_a", "h_b") * F.when(F.col("h_a").isNotNull() & F.col("h_b").isNotNull(), 1), F.lit(0))
    near = cut(near.select("a", "b", "n_ab", most.alias("most")).where(F.col("n_ab") + F.col("most") >= least_together))
    a, b = (held.select("basket", F.col("code").alias(end)) for end in ("a", "b"))
    asked = near.where("most > 0").join(a, "a").join(b, ["basket", "b"])
    more = asked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_more"))
    both = near.join(more, ["a", "b"], "left").select("a", "b", (F.col("n_ab") + F.coalesce("_more", F.lit(0))).alias("n_ab"))
    # A pair of both kinds has its whole number in the first and only its huge baskets in the second.
    every = both.unionByName(huge_pairs(held, often, least_together, total, least_lift))
    counts = every.groupBy("a", "b").agg(F.max("n_ab").alias("n_ab"))
    return counts.where(F.col("n_ab") >= least_together)


def huge_pairs(
    held: DataFrame,
    often: DataFrame,
    least_together: int,
    total: int = 0,
    least_lift: int | None = None,
) -> DataFrame:
    """(a, b, n_ab): pairs of codes that lie together in ``least_together`` of the huge baskets ``held``.

    ``often`` has the number h of huge baskets of each code; one in fewer than ``least_together`` has no
    such pair. Codes that lie in the same huge baskets, and as often in all, are alike in what they share
    with others: they form a class, of which one code is paired. Classes that qualify are expanded, in
    blocks, so what is emitted beyond pairs of classes is what comes out.
    """
    able = held.join(often.where(F.col("h") >= least_together), "code")
    n = F.max("n") if "n" in held.columns else F.lit(0).cast("long")
    marks = able.groupBy("code").agg(
        F.bit_xor(F.xxhash64("basket")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(1), "basket")).alias("_y"),
        F.first("h").alias("h"),
        n.alias("n"),
    )  # the set of a code's huge baskets by 128 bits, whatever their number
    alike = ["_x", "_y", "h", "n"]
    marks = cut(marks)
    kinds = cut(marks.groupBy(*alike).agg(F.min("code").alias("kind"), F.count(F.lit(1)).alias("size")))
    first = able.select("basket", "code").join(kinds.select(F.col("kind").alias("code")), "code", "left_semi")
    across = _count(first).where(F.col("n_ab") >= least_together)
    within = kinds.where("size > 1").select(F.col("kind").alias("a"), F.col("kind").alias("b"), F.col("h").alias("n_ab"))
    of = lambda end: kinds.select(
        F.col("kind").alias(end),
        F.col("n").alias(f"n_{end}"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias(f"k_{end}"),
    )
    pairs = across.unionByName(within).join(of("a"), "a").join(of("b"), "b")
    pairs = pairs.where(_lifted("n_ab", "n_a", "n_b", total, least_lift))
    cells = pairs.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("k_a") - 1))).withColumn(
        "_j",
        F.explode(F.sequence(F.lit(0), F.col("k_b") - 1)),
    )
    codes = marks.join(kinds, alike).select(
        "kind",
        "code",
        F.pmod(F.xxhash64("code"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("block"),
    )
    left = codes.select(F.col("kind").alias("a"), F.col("block").alias("_i"), F.col("code").alias("x"))
    right = codes.select(F.col("kind").alias("b"), F.col("block").alias("_j"), F.col("code").alias("y"))
    out = cells.select("a", "b", "_i", "_j", "n_ab").join(left, ["a", "_i"]).join(right, ["b", "_j"])
    # Within a class every two codes meet both ways round.
    out = out.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_ab")


def cooccurrence(
    df: DataFrame,
    basket: str,
    item: str,
    least_items: int = 1,
    least_together: int = 1,
    least_lift: int | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, baskets, lift, pmi) of every two items that share a basket, a < b.

    Only baskets with ``least_items`` different items count, pairs in at least ``least_together``
    baskets come out, and with ``least_lift`` only those that are together at least that many times
    as often as by chance: n_ab * N >= least_lift * n_a * n_b, compared in exact integers.

    The limits prune items before pairs are made, without losing a pair: an item in fewer than
    ``least_together`` baskets has no such pair, and, as n_ab <= min(n_a, n_b), an item with
    least_lift * n_a > N has none either.

    NULL baskets and items, repeated rows and further columns of ``df`` do not count. No baskets, or
    none that is large enough, give an empty result.
    """
    rows = cut(baskets(df, basket, item, least_items, keep).select("basket", "item"))
    total = rows.select("basket").distinct().count()
    marginals = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_together)
    if least_lift is not None:
        marginals = marginals.where(F.col("n") * F.lit(least_lift) <= F.lit(total))
    # The codes must not change when a task runs again, so they are fixed in the checkpoint. They
    # follow the order of the items: a < b holds for codes as for items.
    coded = cut(
        marginals.repartitionByRange("item").sortWithinPartitions("item").withColumn(
            "code",
            F.monotonically_increasing_id(),
        ),
    )
    members = rows.join(coded, "item").select("basket", "code", "n")
    counts = pair_counts(members, least_together, HUGE, total, least_lift)
    names = coded.select("code", "item", "n")
    left = names.select(F.col("code").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    right = names.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = counts.join(left, "a").join(right, "b")
    out = out.where(_lifted("n_ab", "n_a", "n_b", total, least_lift))
    lift = F.col("n_ab") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select(
        F.col("item_a").alias("a"),
        F.col("item_b").alias("b"),
        "n_ab",
        "n_a",
        "n_b",
        F.lit(total).cast("long").alias("baskets"),
        lift.alias("lift"),
        F.log2(lift).alias("pmi"),
    )


def reference_list_pairs(citation: DataFrame, least_together: int = 1, least_lift: int | None = None) -> DataFrame:
    """``cooccurrence`` of cited papers in reference lists of five or more different papers."""
    return cooccurrence(
        citation,
        "citing_paper_id",
        "cited_paper_id",
        least_items=5,
        least_together=least_together,
        least_lift=least_lift,
        keep=F.col("citing_paper_id") != F.col("cited_paper_id"),
    )
