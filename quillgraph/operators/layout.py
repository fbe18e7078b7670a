"""Where nodes of a drawn graph lie: sides, columns, sizes and rings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import ONE_TASK, distances
from quillgraph.operators.ranks import numbered
from quillgraph.schema import Direction
from quillgraph.session import cut

# Fixed values of the drawing, in pixels, and its limits.
COLUMN, ROW, CHUNK_SHIFT, CHUNK_ROWS, MIDDLE_TOP = 260, 56, 200, 30, 80
SMALLEST, LARGEST, GROWTH = 16, 56, 20
RINGS = 10
LEFT, RIGHT, BOTH = "citations", "references", "both"


def node_size(n: int | Column) -> Column:
    """A library node's size from its PageRank in a graph of ``n`` nodes."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(
        F.greatest(F.lit(SMALLEST) + F.lit(GROWTH) * F.sqrt(F.col("pagerank") * n), F.lit(float(SMALLEST))),
        F.lit(float(LARGEST)),
    )


def rings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``ring``, 0 innermost: PageRank in tenths of its spread, highest inside."""
    spread = nodes.agg(F.min("pagerank").alias("low"), F.max("pagerank").alias("high"))
    low, high = spread.select("low").scalar(), spread.select("high").scalar()
    width = (high - low) / F.lit(RINGS)
    ring = F.when(width == 0, F.lit(0)).otherwise(F.floor((high - F.col("pagerank")) / width))
    return nodes.withColumn("ring", ring.cast("int"))


def sides(nodes: DataFrame, edges: DataFrame, seed: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, side): whether a node is reached from the seed sooner along references or against them.

    Equal distances, and the seed, give ``both``. A node reached neither way takes the side of an
    adjacent decided node, the nearest one first in the order of nodes, in rounds until nothing changes,
    else ``both``. ``nodes`` has id, distance, created_at. A graph that is small by count, as what is drawn
    mostly is, is done by one task; the result is the same.
    """
    small = nodes.count() + edges.count() <= one_task
    return (_sides_one_task if small else _sides_loop)(nodes, edges, seed)


def _sides_one_task(nodes: DataFrame, edges: DataFrame, seed: DataFrame) -> DataFrame:
    """Nodes as rows with their place, edges as rows with another end, the seed as a row without either."""
    no = lambda name, kind: F.lit(None).cast(kind).alias(name)
    text = nodes.schema["id"].dataType.simpleString()
    placed = nodes.select("id", no("other", text), "distance", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    ends = edges.select(F.col("citing").alias("id"), F.col("cited").alias("other"), no("distance", "int"), no("at", "long"))
    start = seed.select("id", no("other", text), no("distance", "int"), no("at", "long"))
    rows = placed.unionByName(ends).unionByName(start).coalesce(1)
    return rows.mapInArrow(_decide, f"id {text}, side string")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order, pairs, starts = [], [], []
    for batch in batches:
        for x, other, distance, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if other is not None:
                pairs.append((x, other))
            elif distance is not None:
                order.append((distance, at is not None, at or 0, x))
            else:
                starts.append(x)
    place = {key[3]: i for i, key in enumerate(sorted(order))}
    steps = {RIGHT: {}, LEFT: {}, BOTH: {}}
    for a, b in pairs:
        for kind, x, y in ((RIGHT, a, b), (LEFT, b, a), (BOTH, a, b), (BOTH, b, a)):
            steps[kind].setdefault(x, []).append(y)
    found = {}
    for way in (RIGHT, LEFT):
        reached, level = dict.fromkeys(starts, 0), list(starts)
        while level:
            level = [y for y in dict.fromkeys(y for x in level for y in steps[way].get(x, ())) if y not in reached]
            reached.update(dict.fromkeys(level, max(reached.values()) + 1))
        found[way] = reached
    side: dict = {}
    for x in place:
        ahead, back = found[RIGHT].get(x, math.inf), found[LEFT].get(x, math.inf)
        side[x] = None if ahead == back == math.inf else BOTH if ahead == back else RIGHT if ahead < back else LEFT
    open_nodes = [x for x in place if side[x] is None]
    while open_nodes:
        still = []
        for x in open_nodes:
            able = [y for y in steps[BOTH].get(x, ()) if side.get(y) is not None]
            side[x] = side[min(able, key=place.__getitem__)] if able else None
            still += [] if able else [x]
        if len(still) == len(open_nodes):
            break
        open_nodes = still
    yield pa.RecordBatch.from_arrays([pa.array(list(place)), pa.array([side[x] or BOTH for x in place], pa.string())], names=["id", "side"])


def _sides_loop(nodes: DataFrame, edges: DataFrame, seed: DataFrame) -> DataFrame:
    """The same on tables of any size.

    A round visits the nodes in their order, so a node is decided at its first visit after one beside it:
    in the same round if that one comes before it, else in the next. The rounds are found by relaxation,
    a join per step; then each undecided node knows whom it takes its side from, the first in order
    of those beside it that were decided earlier, and sides are handed on by doubling.
    """
    place = F.struct("distance", "created_at", "id")
    # Along references and against them in one search, over nodes that are told apart by the way.
    at = lambda way, end: F.struct(F.lit(way).alias("way"), F.col(end).alias("id"))
    both = F.array(
        F.struct(at("ahead", "citing").alias("citing"), at("ahead", "cited").alias("cited")),
        F.struct(at("back", "cited").alias("citing"), at("back", "citing").alias("cited")),
    )
    starts = seed.select(F.explode(F.array(at("ahead", "id"), at("back", "id"))).alias("id"))
    reached = distances(edges.select(F.inline(both)), starts, None, Direction.references)
    of = lambda way: F.min(F.when(F.col("id.way") == way, F.col("distance"))).alias(way)
    reached = reached.groupBy(F.col("id.id").alias("id")).agg(of("ahead"), of("back"))
    side = (
        F.when(F.col("back").isNull() | (F.col("ahead") < F.col("back")), F.lit(RIGHT))
        .when(F.col("ahead").isNull() | (F.col("back") < F.col("ahead")), F.lit(LEFT))
        .otherwise(F.lit(BOTH))
    )
    side = F.when(F.col("ahead").isNotNull() | F.col("back").isNotNull(), side)
    known = nodes.select("id", place.alias("place")).join(reached, "id", "left")
    state = cut(known.select("id", "place", side.alias("side"), F.when(side.isNotNull(), 0).alias("round")))
    loose = state.where("side IS NULL").select("id")
    if not loose.limit(1).count():
        return state.select("id", "side")
    both = F.array(F.struct(F.col("citing").alias("id"), F.col("cited").alias("other")), F.struct(F.col("cited").alias("id"), F.col("citing").alias("other")))
    beside = cut(edges.select(F.inline(both)).distinct().join(loose, "id", "left_semi"))
    while True:
        of = state.where("round IS NOT NULL").select(F.col("id").alias("other"), F.col("place").alias("p"), F.col("round").alias("r"))
        own = state.where("side IS NULL").select("id", "place")
        reach = F.when((F.col("r") > 0) & (F.col("place") > F.col("p")), F.col("r")).otherwise(F.col("r") + 1)
        offers = beside.join(of, "other").join(own, "id").groupBy("id").agg(F.min(reach).alias("offer"))
        new = state.join(offers, "id", "left").withColumn("was", F.col("round")).withColumn("round", F.least("round", "offer"))
        state = cut(new.select("id", "place", "side", "round", (~F.col("round").eqNullSafe(F.col("was"))).alias("moved")))
        moved = state.where("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            break
    of = state.where("round IS NOT NULL").select(F.col("id").alias("other"), F.col("place").alias("p"), F.col("round").alias("r"))
    own = state.where("side IS NULL AND round IS NOT NULL").select("id", "place", "round")
    earlier = (F.col("r") < F.col("round")) | ((F.col("r") == F.col("round")) & (F.col("p") < F.col("place")))
    giver = beside.join(of, "other").join(own, "id").where(earlier).groupBy("id").agg(F.min_by("other", "p").alias("giver"))
    chain = cut(state.join(giver, "id", "left").select("id", "side", F.when(F.col("side").isNull(), F.col("giver")).alias("giver")))
    while chain.where("giver IS NOT NULL").limit(1).count():
        up = chain.select(F.col("id").alias("giver"), F.col("side").alias("up_side"), F.col("giver").alias("up"))
        handed = chain.join(up, "giver", "left")
        chain = cut(
            handed.select(
                "id",
                F.coalesce("side", "up_side").alias("side"),
                F.when(F.col("side").isNull() & F.col("up_side").isNull(), F.col("up")).alias("giver"),
            ),
        )
    return chain.select("id", F.coalesce("side", F.lit(BOTH)).alias("side"))


def columns(nodes: DataFrame) -> DataFrame:
    """(id, x, y) of nodes with side, distance and created_at: a column per side and distance.

    References lie to the right and citing papers to the left, further with distance; a column is broken
    after 30 rows and goes on 200 further out; columns are centred on 0. Nodes of both sides lie from 80 on downwards
    in chunks that alternate to either side. The seed lies in the origin.
    """
    place, chunk = F.col("_row") % CHUNK_ROWS, F.floor(F.col("_row") / CHUNK_ROWS)
    in_chunk = F.least(F.lit(CHUNK_ROWS), F.col("_all") - chunk * CHUNK_ROWS)
    sign = F.when(F.col("side") == RIGHT, 1).otherwise(-1)
    out = F.col("distance") * COLUMN + chunk * CHUNK_SHIFT
    swing = F.when(chunk % 2 == 1, F.ceil(chunk / 2)).otherwise(-F.ceil(chunk / 2)) * CHUNK_SHIFT
    rows = numbered(nodes.select("id", "side", "distance", "created_at"), ["created_at", "id"], ("side", "distance"), "_row")
    # A row per column: a side and a distance.
    sizes = rows.groupBy("side", "distance").agg(F.count(F.lit(1)).alias("_all"))
    rows = rows.join(sizes, ["side", "distance"])
    seed = F.col("distance") == 0
    x = F.when(seed, 0).when(F.col("side") == BOTH, swing).otherwise(sign * out)
    y = F.when(seed, 0.0).when(
        F.col("side") == BOTH,
        MIDDLE_TOP + place * ROW,
    ).otherwise((place - (in_chunk - 1) / 2) * ROW)
    return rows.select("id", x.cast("long").alias("x"), y.cast("double").alias("y"))
