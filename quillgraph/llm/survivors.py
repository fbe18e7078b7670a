"""One surviving record per group of duplicates, with the best available value of every field.

Method: skyline selection. Records of a group are compared in completeness, recency and trust. The
undominated records form the first layer, those that only the first dominates the second, and so on.
Each field takes its value from the first layer that has one, by a lexicographic policy within the
layer: later, more trusted, smaller id.

Completeness is one dimension per field, or, by another policy, the number of complete fields. With one
per field, whatever dominates a record has all of its fields, so the first layer has every field that
the group has; with the number, a field may first come with a later layer.

Completeness and trust take few values, so within a combination of them (a cell) records are ordered
by recency alone: all but the first are dominated by it and have no field that it lacks, so only the
first can give a value. Layers are those of these records, one per cell: a group of any size is reduced
to a few rows before it is brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import fold
from quillgraph.llm.formatting import names_no_work
from quillgraph.session import cut


#: Letters of a text by which texts are dealt to ranges.
HEAD = 64


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (u, v): the component of a node is its smallest member.

    Hook and shortcut over a table of parents: every round each node takes the smallest grandparent
    among its neighbours and hands it to its own parent, and paths are halved. A round shuffles the
    links once on either end; lineage is cut in the shared checkpoint folder after each.
    NULL ends and links from a node to itself are ignored. No links give an empty result.
    """
    there = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")
    both = cut(there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parents = cut(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
            "node",
            F.least("node", "v").alias("parent"),
        ),
    )
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = cut(parents.join(up, "parent").select("node", "parent", "grand"))
        low = (
            both.join(grand.select(F.col("node").alias("v"), F.col("grand").alias("low")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("low").alias("low"))
        )
        own = grand.join(low, "node")
        offers = own.select("node", F.least("grand", "low").alias("parent")).unionByName(
            own.select(F.col("parent").alias("node"), F.col("low").alias("parent"))
        )
        new = offers.groupBy("node").agg(F.min("parent").alias("parent"))
        new = cut(
            new.join(parents.withColumnRenamed("parent", "old"), "node").select(
                "node",
                F.least("parent", "old").alias("parent"),
                "old",
            ),
        )
        moved = new.where(F.col("parent") != F.col("old")).limit(1).count()
        parents = new.drop("old")
        if not moved:
            return parents.select("node", F.col("parent").alias("component"))


def groups_by_shared_key(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(member, component): members joined, directly or through others, by equal keys.

    Only members that share a key with another come out. A NULL in any key joins nothing. Per key one
    star is made, around its smallest member, never all pairs, so a key that holds a third of all rows
    costs as many links as rows.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, member]])
    own = [f"_k{i}" for i in range(len(keys))]  # whatever the keys are called
    rows = members.where(known).select(
        *[F.col(k).alias(o) for k, o in zip(keys, own)],
        F.col(member).alias("v"),
    ).distinct()
    # The smallest member of each key, found with map-side combining; keys of one member drop out.
    stars = rows.groupBy(*own).agg(F.min("v").alias("u"), F.max("v").alias("_top")).where(F.col("u") != F.col("_top"))
    links = rows.join(stars.drop("_top"), own).where(F.col("u") != F.col("v")).select("u", "v")
    return components(links).select(F.col("node").alias("member"), "component")


def beginnings(forms: DataFrame, group: str, form: str) -> DataFrame:
    """(group, form): the texts that are only the beginning of a longer text of their group. An empty text
    is the beginning of none.

    In sorted order a text is directly followed by those that begin with it, so one look at the next
    distinct text tells. The order is over all texts, in ranges of about equal size, so no group need be
    in one task; the last text of a range looks at the first one of the next.
    """
    texts = forms.select(group, form).where(F.length(form) > 0).distinct()
    # Ranges go by the first letters of a text, as samples of what they go by reach the driver. They are
    # fixed by the checkpoint, else the texts at their ends might be others when read again.
    ranged = cut(texts.repartitionByRange(group, F.substring(form, 1, HEAD)).withColumn("_range", F.spark_partition_id()))
    text = F.struct(F.col(group).alias("g"), F.col(form).alias("f"))
    firsts = ranged.groupBy("_range").agg(F.min(text).alias("_first"))  # a row per range
    after = firsts.withColumn("_after", F.lead("_first").over(Window.orderBy("_range"))).drop("_first")
    following = F.lead(text).over(Window.partitionBy("_range").orderBy(group, form))
    rows = ranged.withColumn("_next", following).join(F.broadcast(after), "_range")
    rows = rows.withColumn("_next", F.coalesce("_next", "_after"))
    return rows.where((F.col("_next.g") == F.col(group)) & F.startswith("_next.f", form)).select(group, form)


def survivors(
    rows: DataFrame,
    group: str,
    id_column: str,
    complete: dict[str, Column],
    recency: Column,
    trust: Column,
    by_field: bool = True,
) -> DataFrame:
    """(group, members, <field>_id..., <field>_layer...): per group and field the id of the record that
    gives the value, and the dominance layer it comes from, 1 for the undominated.

    ``complete`` says for each field whether a record has a usable value; ``by_field`` makes each a
    dimension of its own, else their number is one. ``recency`` is a timestamp, NULL is older than any;
    ``trust`` a small integer, NULL is 0. Equal recency is resolved by higher trust, then by the smaller
    id, so repeated rows change nothing. A field that no record of the group has gives NULL.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(f"_ok{i}") for i, c in enumerate(complete.values())]
    age = F.coalesce(-F.unix_micros(recency), F.lit(2**62))
    base = rows.select(
        F.col(group).alias("_g"), F.col(id_column).alias("_id"), *flags, F.coalesce(trust, F.lit(0)).alias("_trust"), age.alias("_age")
    )
    oks = [f"_ok{i}" for i in range(len(complete))]
    cells = base.groupBy("_g", "_trust", *oks).agg(
        F.min(F.struct("_age", "_id")).alias("_top"),
        F.count(F.lit(1)).alias("_n"),
    )
    number = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in oks])
    sides = [F.col(c).cast("int").alias(f"_d{i}") for i, c in enumerate(oks)] if by_field else [number.alias("_d0")]
    dims = [*[f"_d{i}" for i in range(len(sides))], "_trust", "_new"]
    cells = cells.select(
        "_g",
        "_n",
        F.struct(*sides, "_trust", (-F.col("_top._age")).alias("_new"), F.col("_top._id").alias("_id"), *oks).alias("_r"),
    )
    merged = cells.groupBy("_g").agg(
        F.sum("_n").alias("members"),
        F.collect_list("_r").alias("_all"),
    )  # a few rows per group
    shape = merged.schema["_all"].dataType.elementType.simpleString()
    layered = f"array<struct<r:{shape},layer:int>>"

    def dominates(y: Column, x: Column) -> Column:
        least = [y[c] >= x[c] for c in dims]
        more = [y[c] > x[c] for c in dims]
        return reduce(lambda a, b: a & b, least) & reduce(lambda a, b: a | b, more)

    def peel(done: Column, x: Column) -> Column:
        """A record lies one layer below the lowest that dominates it."""
        above = F.transform(F.filter(done, lambda y: dominates(y["r"], x)), lambda y: y["layer"])
        layer = F.coalesce(F.array_max(above), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(x.alias("r"), layer.alias("layer"))).cast(layered))

    # From the greatest on, in lexicographic order, so whatever dominates a record comes before it.
    peeled = merged.withColumn(
        "_layers",
        F.aggregate(F.sort_array("_all", asc=False), F.array().cast(layered), peel),
    )

    def best(ok: str) -> Column:
        able = F.transform(
            F.filter("_layers", lambda l: l["r"][ok]),
            lambda l: F.struct(l["layer"].alias("layer"), -l["r"]["_new"], -l["r"]["_trust"], l["r"]["_id"].alias("id")),
        )
        return F.array_min(able)

    chosen = peeled.select("_g", "members", *[best(ok).alias(name) for name, ok in zip(complete, oks)])
    return chosen.select(
        F.col("_g").alias(group),
        "members",
        *[F.col(name)["id"].alias(f"{name}_id") for name in complete],
        *[F.col(name)["layer"].alias(f"{name}_layer") for name in complete],
    )


def paper_groups(paper: DataFrame, identifier: DataFrame) -> DataFrame:
    """Rows of ``paper`` in groups of two or more, with ``group_id``, the smallest id of the group.

    Papers are joined by an equal (scheme, normalized_value), directly or through other papers.
    Identifiers of papers that are not stored, and missing or blank ones, join nothing.
    """
    papers = paper.where(F.col("id").isNotNull()).select(
        "id",
        "title",
        "publication_year",
        "created_at",
        "library_added_at",
    ).distinct()
    stored = identifier.where(F.trim("normalized_value") != "").join(
        papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi"
    )
    members = groups_by_shared_key(stored, ["scheme", "normalized_value"], "paper_id")
    return papers.join(members.select(F.col("member").alias("id"), F.col("component").alias("group_id")), "id")


def best_papers(paper: DataFrame, identifier: DataFrame, years: tuple[int, int] = (1800, 2026)) -> DataFrame:
    """(group_id, members, title_id, year_id, title_layer, year_layer) of every group of ``paper_groups``.

    A title is complete if it is neither missing, blank, a placeholder nor only the beginning of a
    longer title of its group; a year if it lies in ``years``. A paper in the Library is trusted more,
    which matters only between equal times. NULL where no paper of the group has such a value. Repeated
    rows change nothing, titles of any length are compared in full, empty tables give an empty result,
    and further columns are ignored, whatever their names.
    """
    rows = cut(
        paper_groups(paper, identifier).withColumn(
            "_form",
            F.when(~names_no_work(fold(F.col("title"))), fold(F.col("title"))),
        ),
    )
    cut_short = beginnings(
        rows.where(F.col("_form").isNotNull()),
        "group_id",
        "_form",
    ).withColumn("_short", F.lit(True))
    rows = rows.join(cut_short, ["group_id", "_form"], "left")
    return survivors(
        rows,
        "group_id",
        "id",
        {
            "title": F.col("_form").isNotNull() & F.col("_short").isNull(),
            "year": F.col("publication_year").between(*years),
        },
        F.col("created_at"),
        F.col("library_added_at").isNotNull().cast("int"),
    )


def best_records(paper: DataFrame, identifier: DataFrame) -> DataFrame:
    """One record per group: (group_id, members, title, publication_year)."""
    best = best_papers(paper, identifier)
    titles = paper.select(F.col("id").alias("title_id"), "title").dropDuplicates(["title_id"])
    years = paper.select(F.col("id").alias("year_id"), "publication_year").dropDuplicates(["year_id"])
    return best.join(titles, "title_id", "left").join(years, "year_id", "left").select(
        "group_id",
        "members",
        "title",
        "publication_year",
    )
