"""Graph operators on the demo graph, on small shapes, and against plain Python on random graphs."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import citations, graph, layout, papers
from quillgraph.operators.ranks import numbered
from quillgraph.queries import graphs
from quillgraph.schema import Direction

DEMO = "AB AE BC EC CD ED EJ FA FG FI GB GK HD HJ IC IH JD KE KL LC"
LIBRARY = "ACFH"


def frames(spark, edges, library="", nodes=None):
    nodes = nodes or sorted({x for e in edges for x in e})
    at = datetime(2024, 1, 1)
    paper = spark.createDataFrame(
        [(n, n, 2000, at + timedelta(seconds=i), at if n in library else None) for i, n in enumerate(nodes)],
        "id string, title string, publication_year int, created_at timestamp, library_added_at timestamp",
    )
    return paper, spark.createDataFrame([tuple(e) for e in edges], "citing string, cited string")


@pytest.fixture(scope="module")
def demo(spark):
    paper, edges = frames(spark, DEMO.split(), LIBRARY)
    return paper.cache(), edges.cache()


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def ranks(sub):
    return {r.id: r.pagerank for r in sub.nodes().collect()}


def path(spark, edges, a, b):
    rows = graph.shortest_path(edges, seed(spark, a), F.lit(b)).collect()
    return list(rows[0].path) if rows else None


def test_demo_paths(spark, demo):
    _, edges = demo
    assert path(spark, edges, "A", "D") == ["A", "E", "D"] and path(spark, edges, "D", "A") is None and path(spark, edges, "B", "B") == ["B"]


def test_demo_most_cited(demo):
    assert [
        (r.id, r.citations) for r in papers.most_cited(demo[1], 5).collect()
    ] == [("C", 4), ("D", 4), ("B", 2), ("E", 2), ("J", 2)]


def test_demo_library(demo):
    sub = graph.library_graph(*demo)
    assert [(e.citing, e.cited) for e in sub.ordered_edges().collect()] == [("F", "A")]
    assert ranks(sub) == pytest.approx({"A": 0.381443, "C": 0.206186, "F": 0.206186, "H": 0.206186}, abs=1e-6)


@pytest.mark.parametrize(
    "start, depth, way, order, edges, some",
    [
        ("C", 1, "both", "CBDEIL", 6, {"D": 0.375917, "C": 0.311062, "B": 0.078255}),
        (
            "A",
            2,
            "references",
            "ABECDJ",
            8,
            {"D": 0.379849, "C": 0.206093, "B": 0.112307, "J": 0.110632, "A": 0.078812},
        ),
        ("D", 1, "citations", "DCEHJ", 7, {"D": 0.459947, "J": 0.184826, "C": 0.138845, "E": 0.108191}),
        ("A", 0, "both", "A", 0, {"A": 1.0}),
    ],
)
def test_demo_neighborhoods(spark, demo, start, depth, way, order, edges, some):
    sub = graph.neighborhood(*demo, seed(spark, start), depth, Direction(way))
    nodes = sub.ordered_nodes().collect()
    assert "".join(n.id for n in nodes) == order
    assert {n.id: n.pagerank for n in nodes if n.id in some} == pytest.approx(some, abs=1e-6)
    inner = sub.ordered_edges().collect()
    place = {n.id: i for i, n in enumerate(nodes)}
    assert len(inner) == edges and [
        (place[e.citing], place[e.cited]) for e in inner
    ] == sorted((place[e.citing], place[e.cited]) for e in inner)
    assert {n.id: (n.in_degree, n.out_degree) for n in nodes} == {
        n.id: (sum(e.cited == n.id for e in inner), sum(e.citing == n.id for e in inner)) for n in nodes
    }


def test_small_shapes(spark):
    paper, edges = frames(spark, ["ab"], "ab")
    assert ranks(graph.library_graph(paper, edges)) == pytest.approx({"a": 0.350877, "b": 0.649123}, abs=1e-6)
    paper, edges = frames(spark, ["ab", "bc", "ca"], "abc")
    assert ranks(graph.library_graph(paper, edges)) == pytest.approx(dict.fromkeys("abc", 1 / 3))
    assert {
        r.id: r.distance for r in graph.distances(edges, seed(spark, "a"), 5, Direction.references).collect()
    } == {"a": 0, "b": 1, "c": 2}
    _, edges = frames(spark, ["ab", "bc", "cd", "ad"])
    assert path(spark, edges, "a", "d") == ["a", "d"]
    paper, edges = frames(spark, ["ab"])
    empty = graph.library_graph(paper, edges)
    assert empty.nodes().count() == 0 and empty.ordered_edges().count() == 0
    with pytest.raises(ValueError):
        graph.distances(edges, seed(spark, "a"), -1)


def plain_rank(nodes, edges):
    index = {n: i for i, n in enumerate(nodes)}
    out, n = [[] for _ in nodes], len(nodes)
    for a, b in edges:
        out[index[a]].append(index[b])
    rank = [1 / n] * n
    for _ in range(100):
        new = [(1 - 0.85) / n + 0.85 * sum(rank[i] for i in range(n) if not out[i]) / n] * n
        for i, targets in enumerate(out):
            for j in targets:
                new[j] += 0.85 * rank[i] / len(targets)
        change = sum(abs(x - y) for x, y in zip(new, rank))
        rank = new
        if change < n * 1e-6:
            break
    return dict(zip(nodes, rank))


def random_graph(seed_, n=30, p=0.08):
    rng = random.Random(seed_)
    nodes = [f"n{i:02}" for i in range(n)]
    return nodes, [(a, b) for a, b in itertools.permutations(nodes, 2) if rng.random() < p]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_pagerank_in_one_task_and_in_steps(spark, one_task):
    nodes, edges = random_graph(3, 16, 0.12)
    paper, rows = frames(spark, edges, nodes=nodes)
    got = {r.id: r.pagerank for r in graph.pagerank(paper, rows, one_task).collect()}
    assert got == pytest.approx(plain_rank(nodes, edges), abs=1e-9)


@pytest.mark.parametrize("number", range(4))
def test_random_graphs(spark, number):
    nodes, edges = random_graph(number)
    paper, rows = frames(spark, edges, nodes=nodes)
    got = graph._rank_arrays(
        30,
        np.array([nodes.index(a) for a, _ in edges]),
        np.array([nodes.index(b) for _, b in edges]),
    )
    assert dict(zip(nodes, got)) == pytest.approx(plain_rank(nodes, edges), abs=1e-9)
    ahead = {a: sorted(b for x, b in edges if x == a) for a in nodes}
    reach, level = {nodes[0]: [nodes[0]]}, [nodes[0]]
    while level:
        following = []
        for a in level:
            for b in ahead[a]:
                if b not in reach:
                    reach[b] = [*reach[a], b]
                    following.append(b)
        level = following
    found = {r.id: r.distance for r in graph.distances(rows, seed(spark, nodes[0]), 30, Direction.references).collect()}
    assert found == {k: len(v) - 1 for k, v in reach.items()}
    far = max(reach, key=lambda k: (len(reach[k]), k))
    assert path(spark, rows, nodes[0], far) == reach[far]


def test_stored_edges_and_upserts(spark):
    paper, _ = frames(spark, ["ab"], nodes=["a", "b", "c"])
    stored = spark.createDataFrame(
        [("a", "b"), ("a", "b"), ("a", "a"), (None, "b"), ("a", None), ("a", "gone")],
        "citing_paper_id string, cited_paper_id string",
    )
    edges = graph.stored_edges(stored, paper)
    assert [tuple(r) for r in edges.collect()] == [("a", "b")]
    new = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("b", "c"), ("c", "c"), ("a", "gone"), (None, "a")],
        "citing string, cited string",
    )
    got = {(r.citing, r.cited): r.outcome for r in citations.classify(new, edges, paper).collect()}
    assert got == {
        ("a", "b"): "confirmed",
        ("b", "c"): "created",
        ("c", "c"): "self",
        ("a", "gone"): "unknown_paper",
        (None, "a"): "unknown_paper",
    }
    assert {tuple(r) for r in citations.upsert(new, edges, paper).collect()} == {("a", "b"), ("b", "c")}


def test_every_stored_edge_gets_outcomes_both_ways(spark, tmp_path):
    # Ids below and from 8 on, also as the first digit of a citing paper; one edge is stored both ways.
    stored = ["03", "30", "37", "79", "97", "f2", "2f", "89"]
    stored = [tuple(e) for e in stored] + [("3", "7"), ("5", "5"), ("6", None), ("6", "gone")]
    paper, _ = frames(spark, [], nodes="02356789f")
    paper.write.parquet(f"{tmp_path}/paper.parquet")
    spark.createDataFrame(stored, "citing_paper_id string, cited_paper_id string").write.parquet(
        f"{tmp_path}/citation.parquet",
    )
    valid = {e for e in stored if e[0] != e[1] and None not in e and "gone" not in e}
    want = {(b, a): "created" for a, b in valid} | dict.fromkeys(valid, "confirmed")
    got = graphs.QUERIES["edge_upsert"](spark, str(tmp_path)).collect()
    assert {(r.citing, r.cited): r.outcome for r in got} == want and len(got) == len(want)


def test_references_and_cited_by(spark, demo):
    paper, edges = demo
    rows = edges.union(edges).unionByName(spark.createDataFrame([("F", "gone"), ("C", "C"), ("gone", "C"), (None, "C")], edges.schema))
    rows = rows.withColumnsRenamed({"citing": "citing_paper_id", "cited": "cited_paper_id"})
    assert sorted(r.id for r in graph.references(rows, paper, seed(spark, "F")).collect()) == list("AGI")
    assert sorted(r.id for r in graph.cited_by(rows, paper, seed(spark, "C")).collect()) == list("BEIL")
    assert graph.references(rows, paper, seed(spark, "gone")).count() == 0
    # The same rows, neither distinct nor checked, give the same graphs and paths.
    raw = graph.raw_edges(rows)
    one, two = graph.neighborhood(paper, raw, seed(spark, "C"), 2, raw=True), graph.neighborhood(paper, edges, seed(spark, "C"), 2)
    assert sorted(one.nodes().collect()) == sorted(two.nodes().collect())
    assert one.ordered_edges().collect() == two.ordered_edges().collect()
    assert graph.shortest_path(raw, seed(spark, "A"), F.lit("D"), paper).first().path == ["A", "E", "D"]


def test_a_long_path_is_followed_to_its_end(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    _, edges = frames(spark, chain)
    assert len(path(spark, edges, "n000", "n060")) == 61 and path(spark, edges, "n060", "n000") is None


@pytest.mark.parametrize("by", [(), ("g",)])
def test_places_are_those_of_a_sort(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(40), i) for i in range(300)] + [(None, 1, 300), ("a", None, 301)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r.i: r.rank for r in numbered(df, ["v", "i"], by).collect()}
    seen = {}
    for g, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        key = g if by else None
        assert got[i] == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + 1
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_drawing(spark, demo):
    paper, edges = demo
    sub = graph.neighborhood(paper, edges, seed(spark, "C"), 1)
    side = {r.id: r.side for r in layout.sides(sub.selected, sub.inner, seed(spark, "C")).collect()}
    assert side == {
        "C": "both",
        "B": "citations",
        "E": "citations",
        "I": "citations",
        "L": "citations",
        "D": "references",
    }
    many = [("s", f"r{i:02}") for i in range(35)]
    paper, edges = frames(spark, many)
    sub = graph.neighborhood(paper, edges, seed(spark, "s"), 1)
    placed = {
        r.id: (r.x, r.y) for r in layout.columns(
            sub.selected.join(layout.sides(sub.selected, sub.inner, seed(spark, "s")), "id"),
        ).collect()
    }
    assert placed["s"] == (0, 0.0) and placed["r00"] == (260, -14.5 * 56) and placed["r30"] == (460, -2 * 56.0)
    ranked = graph.library_graph(*frames(spark, ["ab", "cb"], "abc")).nodes()
    assert all(16 <= r.s <= 56 for r in ranked.select(layout.node_size(3).alias("s")).collect())
    assert {r.id: r.ring for r in layout.rings(ranked).collect()} == {"b": 0, "a": 10, "c": 10}


def test_undecided_nodes_inherit_a_side(spark):
    # x cites a reference of the seed: it is reached neither along nor against references.
    paper, edges = frames(spark, ["sr", "xr", "yx"])
    sub = graph.neighborhood(paper, edges, seed(spark, "s"), 3)
    assert {
        r.id: r.side for r in layout.sides(sub.selected, sub.inner, seed(spark, "s")).collect()
    } == {"s": "both", "r": "references", "x": "references", "y": "references"}


def sequential_sides(nodes, edges, start):
    """Node after node and pass after pass; ``nodes`` are (id, distance) in their order."""
    def reach(step):
        dist, queue = {start: 0}, [start]
        for x in queue:
            for y in step.get(x, ()):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        return dist

    out, back, near = {}, {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    f, h = reach(out), reach(back)
    side = {}
    for x, _ in nodes:
        a, b = f.get(x, 10**9), h.get(x, 10**9)
        side[x] = None if a == b == 10**9 else "references" if a < b else "citations" if b < a else "both"
    order = {x: i for i, (x, _) in enumerate(nodes)}
    changed = True
    while changed:
        changed = False
        for x, _ in nodes:
            known = [y for y in near.get(x, ()) if side[y] is not None]
            if side[x] is None and known:
                side[x], changed = side[min(known, key=order.get)], True
    return {x: s or "both" for x, s in side.items()}


@pytest.mark.parametrize("number, one_task", [(0, 0), (1, 0), (0, 10**6), (1, 10**6), (2, 10**6)])
def test_sides_are_the_sequential_ones(spark, number, one_task):
    rng = random.Random(number)
    nodes, edges = random_graph(number + 20, 28, 0.05)
    # Distances need not be those from the start, so that sides come from anywhere in the order.
    placed = sorted((rng.randrange(4), x) for x in nodes)
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(x, d, at) for d, x in placed], "id string, distance int, created_at timestamp")
    got = {r.id: r.side for r in layout.sides(rows, spark.createDataFrame(edges, "citing string, cited string"), seed(spark, nodes[0]), one_task).collect()}
    assert got == sequential_sides([(x, d) for d, x in placed], edges, nodes[0])


def test_degrees_and_totals(spark, demo):
    paper, edges = demo
    got = {r.id: (r.in_degree, r.out_degree) for r in papers.degrees(edges, paper).collect()}
    assert got["C"] == (4, 1) and got["F"] == (0, 3) and len(got) == 12
    assert papers.totals(paper, edges).first().asDict() == {"papers": 12, "library": 4, "citations": 20}
