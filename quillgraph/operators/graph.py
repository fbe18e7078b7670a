"""The directed citation graph: neighbourhoods, induced subgraphs, paths and PageRank.

Edges are rows (citing, cited), each once, with both ends stored and different. Loops run on the
driver, one job per step; what a step yields is cut from its lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.heavy_keys import heavy_keys, keyed_semi_join
from quillgraph.operators.papers import degrees
from quillgraph.operators.ranks import numbered
from quillgraph.schema import Direction
from quillgraph.session import cut

#: A side of up to so many ids is broadcast; they are counted first.
BROADCAST_ROWS = 100_000
#: A graph of up to so many nodes and edges together is ranked by one task, in memory.
ONE_TASK = 2_000_000

# Fixed values of PageRank.
DAMPING, MOST_STEPS, TOLERANCE = 0.85, 100, 1e-6


def stored_edges(citation: DataFrame, paper: DataFrame) -> DataFrame:
    """(citing, cited): each citation between two stored papers once."""
    rows = citation.where(F.col("citing_paper_id") != F.col("cited_paper_id")).select(
        F.col("citing_paper_id").alias("citing"), F.col("cited_paper_id").alias("cited")
    )
    ids = paper.select("id")
    # Ends are checked after the edges are distinct, when there are fewest rows to shuffle.
    edges = rows.distinct().join(ids.withColumnRenamed("id", "citing"), "citing", "left_semi")
    return keyed_semi_join(edges, "cited", ids.withColumnRenamed("id", "cited"), heavy_keys(rows, "cited")).select(
        "citing", "cited"
    )


def raw_edges(citation: DataFrame) -> DataFrame:
    """(citing, cited) of all citation rows with two different ends, as often as they are stored. Where
    a few papers are asked about, these are filtered first and made distinct and checked afterwards."""
    rows = citation.where(F.col("citing_paper_id") != F.col("cited_paper_id"))
    return rows.select(F.col("citing_paper_id").alias("citing"), F.col("cited_paper_id").alias("cited"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _step(edges: DataFrame, frontier: DataFrame, rows: int, direction: Direction) -> DataFrame:
    """(id): ends of the edges that leave the frontier in the direction; with repeats."""
    side = _sized(frontier, rows)
    out = edges.join(side.select(F.col("id").alias("citing")), "citing", "left_semi").select(F.col("cited").alias("id"))
    back = edges.join(side.select(F.col("id").alias("cited")), "cited", "left_semi").select(F.col("citing").alias("id"))
    return {Direction.references: out, Direction.citations: back, Direction.both: out.unionByName(back)}[direction]


def distances(
    edges: DataFrame,
    seeds: DataFrame,
    depth: int | None,
    direction: Direction = Direction.both,
    paper: DataFrame | None = None,
) -> DataFrame:
    """(id, distance): nodes within ``depth`` steps of the ``seeds`` (id), which have distance 0; None
    for any number of steps.

    ``both`` takes edges as undirected. Stops early when a step finds nothing new. With ``paper``, edges
    are ``raw_edges``: repeats do not matter, and ends that are not stored are not reached. Each step is
    a scan of the edges with the frontier broadcast, as long as that is small by count.
    """
    if depth is not None and depth < 0:
        raise ValueError("depth must not be negative")
    found = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier, rows, level = found.select("id"), found.count(), 0
    while rows and (depth is None or level < depth):
        level += 1
        near = _step(edges, frontier, rows, Direction(direction)).distinct()
        near = near.join(found.select("id"), "id", "left_anti")
        near = near if paper is None else near.join(paper.select("id"), "id", "left_semi")
        new = cut(near.withColumn("distance", F.lit(level)))
        frontier, rows = new.select("id"), new.count()
        found = found.unionByName(new)
    return found


def induced(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """All edges with both ends among ``nodes`` (id), each once."""
    ids = nodes.select("id")
    ids = _sized(ids, rows) if rows is not None else ids
    inner = edges.join(
        ids.withColumnRenamed("id", "citing"),
        "citing",
        "left_semi",
    ).join(ids.withColumnRenamed("id", "cited"), "cited", "left_semi")
    return inner.select("citing", "cited")


def _rank_arrays(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """PageRank of nodes 0 to n - 1; the synchronous power iteration, with its stop rule."""
    if n == 0:
        return np.zeros(0)
    out = np.bincount(source, minlength=n).astype(float)
    dangling = out == 0
    share = 1 / np.where(dangling, 1, out)
    rank = np.full(n, 1 / n)
    for _ in range(MOST_STEPS):
        flow = np.bincount(target, weights=(rank * share)[source], minlength=n)
        new = (1 - DAMPING) / n + DAMPING * (flow + rank[dangling].sum() / n)
        change = np.abs(new - rank).sum()
        rank = new
        if change < n * TOLERANCE:
            break
    return rank


def _rank_one_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.string()), ("b", pa.string())]))
        a, b = table.column("a").combine_chunks(), table.column("b").combine_chunks()
        node = np.asarray(b.is_null())
        ids = a.filter(pa.array(node))
        ids = ids.take(pa.compute.sort_indices(ids))  # sums do not depend on the order of rows
        edge = pa.array(~node)
        source = pa.compute.index_in(a.filter(edge), ids).to_numpy(zero_copy_only=False)
        target = pa.compute.index_in(b.filter(edge), ids).to_numpy(zero_copy_only=False)
        order = np.lexsort((target, source))
        value = _rank_arrays(len(ids), source[order].astype(np.int64), target[order].astype(np.int64))
        yield pa.RecordBatch.from_arrays([ids, pa.array(value)], names=["id", "pagerank"])

    import pyarrow.compute  # noqa: F401  (makes pa.compute available in the worker)

    rows = nodes.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        edges.select(F.col("citing").alias("a"), F.col("cited").alias("b"))
    )
    return rows.coalesce(1).mapInArrow(rank, "id string, pagerank double")


def _rank_loop(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The same on tables of any size: a join and an aggregation per step, whose change and dangling
    mass come with the step's one aggregation on the driver (two numbers).

    Edges lie by their citing end, in memory or on disk, for all steps: a step shuffles the ranks to them
    and the flows from them, which are added up before. The ranks of each step are cut from their lineage,
    as plans over plans would double with every step; lost edges are made again from the checkpoint.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = edges.groupBy("citing").agg(F.count(F.lit(1)).alias("out"))
    state = cut(
        nodes.select("id").join(out.withColumnRenamed("citing", "id"), "id", "left").select(
            "id",
            F.coalesce("out", F.lit(0)).alias("out"),
            F.lit(1.0 / n).alias("rank"),
        ),
    )
    edges = cut(edges).repartition(parts, "citing").persist(StorageLevel.MEMORY_AND_DISK)
    lost = state.agg(F.sum(F.when(F.col("out") == 0, F.col("rank")))).first()[0] or 0.0
    try:
        for _ in range(MOST_STEPS):
            given = state.where("out > 0").select(F.col("id").alias("citing"), (F.col("rank") / F.col("out")).alias("part"))
            flow = edges.join(given, "citing").groupBy(F.col("cited").alias("id")).agg(F.sum("part").alias("flow"))
            new = (1 - DAMPING) / n + DAMPING * (F.coalesce("flow", F.lit(0.0)) + lost / n)
            state = cut(state.join(flow, "id", "left").select("id", "out", new.alias("rank"), F.col("rank").alias("old")))
            change, lost = state.agg(
                F.sum(F.abs(F.col("rank") - F.col("old"))),
                F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)),
            ).first()
            state = state.drop("old")
            if change < n * TOLERANCE:
                break
    finally:
        edges.unpersist()
    return state.select("id", F.col("rank").alias("pagerank"))


def pagerank(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, pagerank) within the graph of ``nodes`` (id) and ``edges`` between them.

    Starts at 1 / n, takes at most 100 steps, and stops after the step that changes the ranks by less
    than n * 1e-6 in all. An empty graph gives an empty result. A graph that is small by count is
    ranked by one task; the result is the same.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    return _rank_one_task(nodes, edges) if n + edges.count() <= one_task else _rank_loop(nodes, edges, n)


class Subgraph:
    """A graph of selected papers: ``nodes`` with degrees and PageRank within it, and ``edges``."""

    def __init__(self, papers: DataFrame, edges: DataFrame, selected: DataFrame):
        """``papers`` has id and created_at; ``selected`` has id and distance (NULL in a library graph).
        ``edges`` may be ``raw_edges``: only those between selected papers are made distinct."""
        self.selected = cut(selected.join(papers.select("id", "created_at"), "id"))
        self.inner = cut(induced(edges, self.selected, self.selected.count()).distinct())

    def nodes(self) -> DataFrame:
        """(id, distance, created_at, in_degree, out_degree, pagerank)."""
        ranks = pagerank(self.selected, self.inner)
        return self.selected.join(degrees(self.inner, self.selected), "id").join(ranks, "id")

    def ordered_nodes(self) -> DataFrame:
        """The nodes by distance, then time of creation, then id."""
        return self.nodes().orderBy(F.asc_nulls_first("distance"), "created_at", "id")

    def places(self) -> DataFrame:
        """(id, place): each node's place from 0 on in the order of the nodes."""
        order = [F.asc_nulls_first("distance"), F.asc("created_at"), F.asc("id")]
        return numbered(self.selected, order, to="place").select("id", "place")

    def edges(self) -> DataFrame:
        """(citing, cited) with what orders them: the places of both ends in the order of the nodes."""
        place = lambda end: self.selected.select(
            F.col("id").alias(end),
            F.struct(F.coalesce("distance", F.lit(0)), "created_at", "id").alias(f"{end}_place"),
        )
        return self.inner.join(place("citing"), "citing").join(place("cited"), "cited")

    def ordered_edges(self) -> DataFrame:
        return self.edges().orderBy("citing_place", "cited_place").select("citing", "cited")


def neighborhood(
    paper: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    depth: int = 1,
    direction: Direction = Direction.both,
    raw: bool = False,
) -> Subgraph:
    """The papers within ``depth`` steps of the seeds, with all citations between them. ``raw`` says that
    ``edges`` are ``raw_edges``."""
    return Subgraph(paper, edges, distances(edges, seeds, depth, direction, paper if raw else None))


def library_graph(paper: DataFrame, edges: DataFrame) -> Subgraph:
    """The Library's papers, with the citations between them."""
    members = paper.where(F.col("library_added_at").isNotNull()).select("id", F.lit(None).cast("int").alias("distance"))
    return Subgraph(paper, edges, members)


def shortest_path(edges: DataFrame, source: DataFrame, target: Column, paper: DataFrame | None = None) -> DataFrame:
    """(path): ids on the shortest way along citations from ``source`` (one row, id) to ``target`` (a
    literal or scalar), ends included; no row if there is none. Of several, the smallest in the order of ids.

    The search goes on from both ends, a step at a time from the one with fewer nodes, until they meet or
    one has no more: every shortest path then has a node in the last step of either. Each step keeps, for
    every node first reached, the smallest path from there to its end, which that of a node beyond extends.
    With ``paper``, edges are ``raw_edges``, as in ``distances``.
    """
    level = {
        "citing": cut(source.select("id", F.array("id").alias("path"))),
        "cited": cut(source.select(target.alias("id"), F.array(target).alias("path"))),
    }
    seen = {end: of.select("id") for end, of in level.items()}
    rows, steps = {"citing": 1, "cited": 1}, 1
    while True:
        back = level["cited"].select("id", F.slice("path", 2, steps).alias("rest"))
        path = level["citing"].join(back, "id").agg(F.min(F.concat("path", "rest"))).first()[0]  # one path
        if path is not None or not all(rows.values()):
            found = [] if path is None else [(path,)]
            return source.sparkSession.createDataFrame(found, source.select(F.array("id").alias("path")).schema)
        steps += 1
        own = min(rows, key=rows.get)
        other = "cited" if own == "citing" else "citing"
        side = _sized(level[own].select(F.col("id").alias(own), "path"), rows[own] * steps)  # ids in all
        near = edges.join(side, own).groupBy(F.col(other).alias("id")).agg(F.min("path").alias("path"))
        near = near.join(seen[own], "id", "left_anti")
        near = near if paper is None else near.join(paper.select("id"), "id", "left_semi")
        path = F.concat("path", F.array("id")) if own == "citing" else F.concat(F.array("id"), "path")
        level[own] = cut(near.select("id", path.alias("path")))
        rows[own] = level[own].count()
        seen[own] = seen[own].unionByName(level[own].select("id"))


def _ends(citation: DataFrame, of: DataFrame, own: str, other: str) -> DataFrame:
    """(id): the other ends of the citations of the papers ``of`` (id), which are few: rows are filtered
    as they are scanned, and only what is left is made distinct."""
    rows = raw_edges(citation).join(F.broadcast(of.select(F.col("id").alias(own))), own, "left_semi")
    return rows.select(F.col(other).alias("id")).distinct()


def references(citation: DataFrame, paper: DataFrame, of: DataFrame) -> DataFrame:
    """Papers that the papers ``of`` (id), as many as one asks about at once, cite; both ends stored."""
    return paper.join(_ends(citation, _stored(of, paper), "citing", "cited"), "id", "left_semi")


def cited_by(citation: DataFrame, paper: DataFrame, of: DataFrame) -> DataFrame:
    """Papers that cite the papers ``of`` (id), as many as one asks about at once; both ends stored."""
    return paper.join(_ends(citation, _stored(of, paper), "cited", "citing"), "id", "left_semi")


def _stored(of: DataFrame, paper: DataFrame) -> DataFrame:
    return paper.select("id").join(F.broadcast(of.select("id")), "id", "left_semi")
