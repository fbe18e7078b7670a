"""Queries on the citation graph: on the stored citations, and on the deep graph of ``relations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import citations, graph, layout
from quillgraph.operators.ranks import numbered
from quillgraph.queries.relations import DEEP, DEEP_SEED, EDGES, SEED, deep_citations, deep_edges, deep_papers, deep_seed, edges, most_citing
from quillgraph.schema import Direction
from quillgraph.session import cut
from quillgraph.tables import table


def _bfs(depth, direction):
    end = "citing" if direction == Direction.references else "cited"
    return lambda s, d: graph.distances(
        cut(graph.raw_edges(deep_citations(s, d))),
        deep_seed(s, d, end),
        depth,
        direction,
        deep_papers(s, d),
    )


def _neighborhood(s, d, depth=2, way=Direction.both):
    """Papers around the seed; citations are filtered, made distinct and checked where they are used."""
    raw = cut(graph.raw_edges(deep_citations(s, d)))
    seed = deep_seed(s, d, "citing" if way == Direction.references else "cited")
    return graph.neighborhood(deep_papers(s, d), raw, seed, depth, way, raw=True)


def _library(s, d):
    return graph.library_graph(table(s, d, "paper"), edges(s, d))


def _nodes(sub):
    nodes = sub.nodes().join(sub.places(), "id")
    return nodes.select("id", "distance", "in_degree", "out_degree", F.round("pagerank", 9).alias("pagerank"), "place")


def _ordered(sub):
    """Edges with their place in the order of their ends."""
    ranked = numbered(sub.edges(), ["citing_place", "cited_place"], to="place")
    return ranked.select("citing", "cited", "place")


def _rank(paper, e):
    return graph.pagerank(paper, cut(e)).select("id", F.round("pagerank", 9).alias("pagerank"))


def _paths(s, d):
    """Paths from the seed to the farthest paper within 7 steps (the least of them), to itself, and to the
    least paper that nobody cites, to which there is no path and so no row."""
    e, seed, paper = cut(deep_edges(s, d)), cut(deep_seed(s, d, "citing")), deep_papers(s, d)
    reached = graph.distances(e, seed, 7, Direction.references)
    far = cut(reached.orderBy(F.desc("distance"), "id").limit(1).select("id"))
    lost = cut(paper.select("id").join(e.select(F.col("cited").alias("id")), "id", "left_anti").agg(F.min("id").alias("id")))
    rows = None
    for kind, target in (("far", far), ("none", lost), ("same", seed)):
        path = graph.shortest_path(e, seed, target.scalar()).select(
            F.lit(kind).alias("kind"),
            F.array_join("path", " ").alias("path"),
            (F.size("path") - 1).alias("length"),
        )
        rows = path if rows is None else rows.unionByName(path)
    return rows


def _upsert(s, d):
    """Incoming edges: every stored one, as it is and turned round."""
    e = cut(edges(s, d))  # incoming ones, and those that are known
    ways = F.array(F.struct("citing", "cited"), F.struct(F.col("cited").alias("citing"), F.col("citing").alias("cited")))
    return citations.classify(e.select(F.inline(ways)), e, table(s, d, "paper"))


def _sides(sub):
    return layout.sides(sub.selected, sub.inner, sub.selected.where("distance = 0").select("id"))


def _columns(s, d):
    sub = _neighborhood(s, d, 3)
    return layout.columns(sub.selected.join(_sides(sub), "id"))


def _sizes(s, d):
    sub = _library(s, d)
    return sub.nodes().select("id", F.round(layout.node_size(sub.selected.count()), 6).alias("size"))


def _rings(s, d):
    nodes = _library(s, d).nodes().select("id", F.round("pagerank", 9).alias("pagerank"))
    return layout.rings(nodes).select("id", "ring")


def _referring(s, d, side, of):
    return side(table(s, d, "citation"), table(s, d, "paper"), of).select("id", "title", "created_at")


QUERIES = {
    "all_citations": lambda s, d: numbered(edges(s, d), ["citing", "cited"]),
    "references": lambda s, d: _referring(s, d, graph.references, most_citing(s, d)),
    "cited_by": lambda s, d: _referring(s, d, graph.cited_by, edges(s, d).groupBy("cited").count().orderBy(F.desc("count"), "cited").limit(1).select(F.col("cited").alias("id"))),
    "edge_upsert": _upsert,
    "bfs_refs": _bfs(3, Direction.references),
    "bfs_cites": _bfs(3, Direction.citations),
    "bfs_both": _bfs(3, Direction.both),
    "neighborhood_nodes": lambda s, d: _nodes(_neighborhood(s, d)),
    "neighborhood_references": lambda s, d: _nodes(_neighborhood(s, d, 3, Direction.references)),
    "induced_edges": lambda s, d: _ordered(_neighborhood(s, d)),
    "library_graph_nodes": lambda s, d: _nodes(_library(s, d)),
    "library_graph_edges": lambda s, d: _ordered(_library(s, d)),
    "pagerank_all": lambda s, d: _rank(table(s, d, "paper"), edges(s, d)),
    "pagerank_deep": lambda s, d: _rank(deep_papers(s, d), deep_edges(s, d)),
    "shortest_path": _paths,
    "side_assignment": lambda s, d: _sides(_neighborhood(s, d, 3)),
    "layout_columns": _columns,
    "node_size": _sizes,
    "concentric_rings": _rings,
}


def _reach(depth: int, way: str) -> str:
    step = {
        "references": "SELECT cited, d + 1 FROM b JOIN e ON e.citing = b.id",
        "citations": "SELECT citing, d + 1 FROM b JOIN e ON e.cited = b.id",
        "both": "SELECT y, d + 1 FROM b JOIN u ON u.x = b.id",
    }[way]
    return f"""
      WITH RECURSIVE {DEEP}, {DEEP_SEED.format("citing" if way == "references" else "cited")},
      u AS (SELECT citing AS x, cited AS y FROM e UNION SELECT cited, citing FROM e),
      b(id, d) AS (SELECT id, 0 FROM s UNION {step} WHERE d < {depth}),
      reached AS (SELECT id, min(d) AS distance FROM b GROUP BY id),
      nodes AS (
        SELECT reached.id, distance, created_at, row_number() OVER (ORDER BY distance, created_at, reached.id) - 1 AS place
        FROM reached JOIN dp ON dp.id = reached.id)
    """


_SUB = "ge AS (SELECT * FROM e WHERE citing IN (SELECT id FROM nodes) AND cited IN (SELECT id FROM nodes))"
_LIBRARY = f"""
  WITH {EDGES}, nodes AS (
    SELECT id, CAST(NULL AS INTEGER) AS distance, row_number() OVER (ORDER BY created_at, id) - 1 AS place
    FROM paper WHERE library_added_at IS NOT NULL)
"""


def _ranks(steps: int) -> str:
    """Chained steps of PageRank over ``nodes`` and ``ge``; once a step stops, the later ones keep it."""
    out = [
        _SUB,
        "n AS (SELECT count(*) AS n FROM nodes)",
        "o AS (SELECT citing, count(*) AS c FROM ge GROUP BY 1)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS v, false AS done FROM nodes, n)",
    ]
    for k in range(1, steps + 1):
        out.append(f"""
          u{k} AS MATERIALIZED (
            SELECT r.id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(f.s, 0) + m / n) AS u, r.v, r.done, n
            FROM r{k - 1} r LEFT JOIN (
              SELECT cited AS id, sum(q.v / o.c) AS s FROM ge JOIN r{k - 1} q ON q.id = ge.citing JOIN o ON o.citing = ge.citing GROUP BY 1) f ON f.id = r.id,
            (SELECT coalesce(sum(v), 0) AS m FROM r{k - 1} WHERE id NOT IN (SELECT citing FROM o)), n),
          r{k} AS MATERIALIZED (
            SELECT id, CASE WHEN done THEN v ELSE u END AS v, done OR stop AS done
            FROM u{k}, (SELECT sum(abs(u - v)) < max(n) * 1e-6 AS stop FROM u{k}))""")
    return ", ".join(out) + f", rank AS (SELECT id, v FROM r{steps})"


_NODES = """
  SELECT nodes.id, distance, (SELECT count(*) FROM ge WHERE cited = nodes.id) AS in_degree,
         (SELECT count(*) FROM ge WHERE citing = nodes.id) AS out_degree, round(v, 9) AS pagerank, place
  FROM nodes JOIN rank ON rank.id = nodes.id
"""
_PLACED = """
  SELECT ge.citing, ge.cited, row_number() OVER (ORDER BY a.place, z.place) - 1 AS place
  FROM ge JOIN nodes a ON a.id = ge.citing JOIN nodes z ON z.id = ge.cited
"""
# The side of each node. One reached neither way takes that of the first node beside it; as nodes are
# ordered by distance that one comes before it, and has its side when the node is visited.
_SIDE = """
  f(id, d) AS (SELECT id, 0 FROM s UNION SELECT ge.cited, d + 1 FROM f JOIN ge ON ge.citing = f.id WHERE d < 40),
  h(id, d) AS (SELECT id, 0 FROM s UNION SELECT ge.citing, d + 1 FROM h JOIN ge ON ge.cited = h.id WHERE d < 40),
  f2 AS (SELECT id, min(d) AS d FROM f GROUP BY 1), h2 AS (SELECT id, min(d) AS d FROM h GROUP BY 1),
  own AS (
    SELECT nodes.*, CASE WHEN f2.d IS NULL AND h2.d IS NULL THEN NULL WHEN h2.d IS NULL OR f2.d < h2.d THEN 'references'
                         WHEN f2.d IS NULL OR h2.d < f2.d THEN 'citations' ELSE 'both' END AS side
    FROM nodes LEFT JOIN f2 ON f2.id = nodes.id LEFT JOIN h2 ON h2.id = nodes.id),
  beside AS (SELECT citing AS id, cited AS other FROM ge UNION SELECT cited, citing FROM ge),
  giver AS (SELECT beside.id, arg_min(other, place) AS other FROM beside JOIN nodes ON nodes.id = other GROUP BY 1),
  chain(id, top) AS (SELECT id, id FROM own UNION SELECT chain.id, giver.other FROM chain JOIN own ON own.id = top AND own.side IS NULL JOIN giver ON giver.id = top),
  sided AS (SELECT chain.id, own.side FROM chain JOIN own ON own.id = chain.top WHERE own.side IS NOT NULL)
"""
_STEPS = 45

SQL = {
    "all_citations": f"WITH {EDGES} SELECT *, row_number() OVER (ORDER BY citing, cited) - 1 AS rank FROM e",
    "references": f"WITH {EDGES}, {SEED} SELECT id, title, created_at FROM paper WHERE id IN (SELECT cited FROM e WHERE citing IN (SELECT id FROM s))",
    "cited_by": f"""
      WITH {EDGES}, t AS (SELECT cited FROM e GROUP BY cited ORDER BY count(*) DESC, cited LIMIT 1)
      SELECT id, title, created_at FROM paper WHERE id IN (SELECT citing FROM e WHERE cited IN (SELECT cited FROM t))
    """,
    "edge_upsert": f"""
      WITH {EDGES}, n AS (SELECT cited AS citing, citing AS cited FROM e UNION SELECT citing, cited FROM e)
      SELECT citing, cited, CASE WHEN (citing, cited) IN (SELECT (citing, cited) FROM e) THEN 'confirmed' ELSE 'created' END AS outcome FROM n
    """,
    "bfs_refs": _reach(3, "references") + "SELECT id, distance FROM nodes",
    "bfs_cites": _reach(3, "citations") + "SELECT id, distance FROM nodes",
    "bfs_both": _reach(3, "both") + "SELECT id, distance FROM nodes",
    "neighborhood_nodes": f"{_reach(2, 'both')}, {_ranks(_STEPS)} {_NODES}",
    "neighborhood_references": f"{_reach(3, 'references')}, {_ranks(_STEPS)} {_NODES}",
    "induced_edges": f"{_reach(2, 'both')}, {_SUB} {_PLACED}",
    "library_graph_nodes": f"{_LIBRARY}, {_ranks(_STEPS)} {_NODES}",
    "library_graph_edges": f"{_LIBRARY}, {_SUB} {_PLACED}",
    "pagerank_all": f"WITH {EDGES}, nodes AS (SELECT id FROM paper), {_ranks(_STEPS)} SELECT id, round(v, 9) AS pagerank FROM rank",
    "pagerank_deep": f"WITH {DEEP}, nodes AS (SELECT id FROM dp), {_ranks(_STEPS)} SELECT id, round(v, 9) AS pagerank FROM rank",
    "shortest_path": f"""
      {_reach(7, "references")},
      t AS (SELECT id, distance FROM nodes ORDER BY distance DESC, id LIMIT 1),
      g AS (SELECT e.citing, e.cited FROM e JOIN nodes a ON a.id = e.citing JOIN nodes z ON z.id = e.cited AND z.distance = a.distance + 1),
      back(id, d, path) AS (
        SELECT id, distance, [id] FROM t
        UNION ALL SELECT g.citing, d - 1, list_prepend(g.citing, path) FROM back JOIN g ON g.cited = back.id WHERE d > 0)
      SELECT 'far' AS kind, array_to_string(min(path), ' ') AS path, len(min(path)) - 1 AS length FROM back WHERE d = 0
      UNION ALL SELECT 'same', id, 0 FROM s
    """,
    "side_assignment": f"{_reach(3, 'both')}, {_SUB}, {_SIDE} SELECT id, side FROM sided",
    "layout_columns": f"""
      {_reach(3, "both")}, {_SUB}, {_SIDE},
      q AS (SELECT nodes.id, distance, created_at, side FROM nodes JOIN sided ON sided.id = nodes.id),
      w AS (
        SELECT *, row_number() OVER (PARTITION BY side, distance ORDER BY created_at, id) - 1 AS k, count(*) OVER (PARTITION BY side, distance) AS n FROM q)
      SELECT id,
        CASE WHEN distance = 0 THEN 0
             WHEN side = 'both' THEN CASE WHEN (k // 30) % 2 = 1 THEN (k // 30 + 1) // 2 ELSE -(k // 30) // 2 END * 200
             ELSE CASE WHEN side = 'references' THEN 1 ELSE -1 END * (distance * 260 + (k // 30) * 200) END::BIGINT AS x,
        CASE WHEN distance = 0 THEN 0 WHEN side = 'both' THEN 80 + (k % 30) * 56
             ELSE (k % 30 - (least(30, n - (k // 30) * 30) - 1) / 2.0) * 56 END::DOUBLE AS y
      FROM w
    """,
    "node_size": f"{_LIBRARY}, {_ranks(_STEPS)} SELECT id, round(least(greatest(16 + 20 * sqrt(v * n), 16), 56), 6) AS size FROM rank, n",
    "concentric_rings": f"""
      {_LIBRARY}, {_ranks(_STEPS)}, q AS (SELECT id, round(v, 9) AS v FROM rank), z AS (SELECT min(v) AS low, max(v) AS high FROM q)
      SELECT id, CASE WHEN high = low THEN 0 ELSE floor((high - v) / ((high - low) / 10)) END::INTEGER AS ring FROM q, z
    """,
}
