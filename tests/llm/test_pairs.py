"""Co-occurrence, equal records, best records and similar sets against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from quillgraph.llm import blocks, cooccurrence, formatting, similar_sets, survivors

CITATION = "id string, citing_paper_id string, cited_paper_id string, created_at timestamp, n int, item string, basket string, _n int, code long, u string, v string"


def citations(spark, pairs):
    return spark.createDataFrame(
        [(str(i), a, b, None, 1, "x", "y", 2, 3, "u", "v") for i, (a, b) in enumerate(pairs)],
        CITATION,
    )


def random_lists(seed, papers=60, lists=50, hot=0.5):
    rng = random.Random(seed)
    pairs = []
    for i in range(lists):
        items = {
            f"p{rng.randrange(papers):03}" for _ in range(rng.randint(1, 14))
        } | ({"p000"} if rng.random() < hot else set())
        pairs += [(f"c{i:03}", x) for x in items]
        if rng.random() < 0.3:  # a list much like it, and an exact copy
            other = sorted(items)[1:]
            pairs += [(f"d{i:03}", x) for x in other] + [(f"e{i:03}", x) for x in items]
    pairs += pairs[:20] + [(None, "p001"), ("c000", None), (None, None), ("p005", "p005")]
    rng.shuffle(pairs)
    return pairs


def lists_of(pairs, least=5):
    out = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            out[a].add(b)
    return {a: s for a, s in out.items() if len(s) >= least}


@pytest.mark.parametrize("block, hot", [(3, 100), (256, 100), (3, 5)])
def test_pairs_within_any_block_size(spark, block, hot):
    rows = [("k", i) for i in range(20)] + [("one", 1)] + [("k", 3)] + [("two", 1), ("two", 9)]
    got = blocks.pairs_within(spark.createDataFrame(rows, "key string, m int"), "key", "m", block, hot).collect()
    want = [("k", a, b) for a, b in itertools.combinations(range(20), 2)] + [("two", 1, 9)]
    assert sorted((r.key, r.a, r.b) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_cooccurrence_is_brute_force(spark, seed):
    pairs = random_lists(seed)
    lists = lists_of(pairs)
    n = Counter(x for s in lists.values() for x in s)
    both = Counter(p for s in lists.values() for p in itertools.combinations(sorted(s), 2))
    got = cooccurrence.reference_list_pairs(citations(spark, pairs)).collect()
    assert {
        (r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.baskets) for r in got
    } == {(a, b): (k, n[a], n[b], len(lists)) for (a, b), k in both.items()}
    assert all(abs(r.lift - r.n_ab * r.baskets / (r.n_a * r.n_b)) < 1e-9 and abs(2**r.pmi - r.lift) < 1e-9 for r in got)
    strict = cooccurrence.reference_list_pairs(citations(spark, pairs), 2, 2).collect()
    want = {p for p, k in both.items() if k >= 2 and k * len(lists) >= 2 * n[p[0]] * n[p[1]]}
    assert {(r.a, r.b) for r in strict} == want


@pytest.mark.parametrize("least", [1, 2, 4])
def test_huge_baskets_lose_no_pair(spark, least):
    rng = random.Random(8)
    lists = {f"b{i}": set(rng.sample(range(40), 6)) for i in range(60)} | {
        "h1": set(range(30)),
        "h2": set(range(15, 40)),
        "h3": set(range(40)),
    }
    both = Counter(p for s in lists.values() for p in itertools.combinations(sorted(s), 2))
    members = spark.createDataFrame([(b, c) for b, s in lists.items() for c in s], "basket string, code long")
    got = {(r.a, r.b): r.n_ab for r in cooccurrence.pair_counts(members, least, 10).collect()}
    assert got == {p: n for p, n in both.items() if n >= least}


@pytest.mark.parametrize("least, lift", [(1, None), (4, None), (6, 2)])
def test_any_number_of_huge_baskets(spark, least, lift):
    rng = random.Random(5)
    lists = {f"b{i}": set(rng.sample(range(60), 5)) for i in range(80)}
    lists |= {f"h{i}": {0} | set(rng.sample(range(20 * (i % 3), 20 * (i % 3) + 30), 20)) for i in range(14)}
    lists |= {f"t{i}": {0, *range(70, 110)} for i in range(7)}  # the same forty in seven of them
    n = Counter(x for s in lists.values() for x in s)
    both = Counter(p for s in lists.values() for p in itertools.combinations(sorted(s), 2))
    rows = [(b, c, n[c]) for b, s in lists.items() for c in s]
    members = spark.createDataFrame(rows, "basket string, code long, n long")
    got = {(r.a, r.b): r.n_ab for r in cooccurrence.pair_counts(members, least, 10, len(lists), lift).collect()}
    good = lambda p, k: k >= least and (lift is None or k * len(lists) >= lift * n[p[0]] * n[p[1]])
    assert {p: k for p, k in got.items() if good(p, k)} == {p: k for p, k in both.items() if good(p, k)}
    assert all(both[p] == k for p, k in got.items())


def test_huge_baskets_with_nothing_in_common_make_no_pairs(spark):
    rows = [(f"h{i}", f"x{i}-{j}") for i in range(10) for j in range(20_000)] + [(f"h{i}", "hot") for i in range(10)]
    held = spark.createDataFrame(rows, "basket string, item string")
    assert cooccurrence.cooccurrence(held, "basket", "item", 5, 6).count() == 0


def test_cooccurrence_of_nothing(spark):
    assert cooccurrence.reference_list_pairs(citations(spark, []), 6, 4).count() == 0
    assert cooccurrence.reference_list_pairs(citations(spark, [("a", "b"), (None, None)])).count() == 0


PAPER = "id string, title string, publication_year int, created_at timestamp, library_added_at timestamp, key string, form string, raw string, copies int"


def papers(spark, rows):
    at = datetime(2024, 1, 1)
    full = [(i, t, y, at + timedelta(days=d) if d is not None else None, None, "k", "f", "r", 1) for i, t, y, d in rows]
    return spark.createDataFrame(full, PAPER)


def test_titles_equal_but_for_formatting(spark):
    rows = [
        (
            "a",
            "The  Tale, of Straße!",
            2001,
            0,
        ), ("b", "the tale​ of STRASSE", 2001, 0), ("c", "The Tale of Strasse", None, 0),
        (
            "d",
            "«The-Tale_of\nstrasse»",
            None,
            0,
        ), ("e", "Other", 2001, 0), ("f", None, 2001, 0), ("g", "  ", 2001, 0), ("h", "[Untitled]", 2001, 0),
        ("i", "untitled", 2001, 0), ("j", "???", 2001, 0), ("k", " \t", 2001, 0), (
            "a",
            "The  Tale, of Straße!",
            2001,
            0,
        ), (None, "Other", 2001, 0),
    ]
    encoded = formatting.encoded_papers(papers(spark, rows))
    assert {(r.id_a, r.id_b) for r in formatting.copies(encoded).collect()} == {("a", "b"), ("c", "d")}
    assert {(r.id, r.copies) for r in formatting.collapse(encoded).collect()} == {("a", 2), ("c", 2), ("e", 2)}


def test_very_long_titles(spark):
    long = "Word " * 200_000
    rows = [("a", long, 2000, 0), ("b", long.upper() + ".", 2000, 0), ("c", long + "x", 2000, 0)]
    assert [tuple(r) for r in formatting.copies(formatting.encoded_papers(papers(spark, rows))).collect()] == [("a", "b")]
    best = survivors.best_papers(papers(spark, rows), identifiers(spark, [(i, "doi", "1") for i in "abc"])).first()
    assert (best.members, best.title_id) == (3, "c")


def test_a_large_group_of_copies_is_whole(spark):
    rows = [(f"{i:04}", "Same  title" + "." * (i % 5), 2000, 0) for i in range(600)]
    assert formatting.copies(formatting.encoded_papers(papers(spark, rows))).count() == 600 * 599 // 2


def test_hot_values_are_looked_up_apart(spark):
    rows = [(f"{i:04}", ["Hot title", "hot TITLE!", "Unknown", None][i % 4], 2000, 0) for i in range(400)]
    rows += [(f"x{i:04}", f"Title {i // 2}", 2000 + i % 2, 0) for i in range(4400)] + [(f"y{i}", f"title {i}.", 2000, 0) for i in range(50)]
    encoded = formatting.encoded_papers(papers(spark, rows))
    got = {r.id: r.copies for r in formatting.collapse(encoded).collect()}
    assert got["0000"] == 200 and len(got) == 1 + 4400 and sum(got.values()) == 200 + 4400 + 50
    assert formatting.copies(encoded).count() == 200 * 199 // 2 + 50


def test_records_in_any_layout(spark):
    rows = [
        ("r1", '{"display_name": "On Tea; or, Venue: none", "publication_year": 2001, "venue": "Acta"}'),
        ("r2", "Venue = acta.\nDISPLAY-NAME =  On tea or venue none \npublication year = 2001"),
        ("r3", "publication_year=2001; display_name=ON TEA, or venue—none; venue=ACTA"),
        ("r4", '{"venue": null, "display name": "On Tea", "publication_year": "2001"}'),
        ("r5", "display_name: On Tea | publication_year: 2001 | venue: "),
        ("r6", '{"display_name": "On Tea", "publication_year": 2001}'),
        (
            "r7",
            '{"display_name": "On Te',
        ), ("r8", "display_name=On Te"), ("r9", None), ("r10", ""), ("r11", "no record at all"),
        (
            "r12",
            '{"display_name": "A \\"quoted\\" \\u00e9", "publication_year": 2001.0, "venue": ""}',
        ), ("r13", "venue: | display_name: a quoted é | publication_year: 2001"),
    ]
    raw = spark.createDataFrame(
        [(*r, None, "x") for r in rows],
        "record_id string, payload string, fetched_at timestamp, venue string",
    )
    got = {(r.id_a, r.id_b) for r in formatting.copies(formatting.encoded_records(raw)).collect()}
    assert got == {("r1", "r2"), ("r1", "r3"), ("r2", "r3"), ("r4", "r5"), ("r4", "r6"), ("r5", "r6"), ("r12", "r13")}
    assert formatting.found(papers(spark, []), raw.limit(0)).count() == 0


IDENTIFIER = "id string, paper_id string, scheme string, value string, normalized_value string, u string, v string, _k0 string"


def identifiers(spark, rows):
    return spark.createDataFrame([(str(i), p, s, v, v, "u", "v", "k") for i, (p, s, v) in enumerate(rows)], IDENTIFIER)


def test_best_record_of_each_group(spark):
    long = "A Long and Complete Title of Some Work: With a Subtitle"
    rows = [
        ("b1", long, 1700, 0), (
            "b2",
            "A long and complete title of some work: with",
            2001,
            5,
        ), ("b3", "Unknown", 2002, 9), ("b4", None, None, 12),
        ("c1", "Short", 2000, 3), ("c2", "Short", 2000, 3), ("c3", "sho", 9999, 8), ("d1", None, None, 1), ("d2", "???", 20199, 2),
        ("x1", "alone", 2000, 1), ("e1", "Tea", 2000, None), ("e2", "Cup", None, None),
    ]
    ids = [
        ("b1", "doi", "1"), ("b2", "doi", "1"), ("b2", "arxiv", "7"), ("b3", "arxiv", "7"), ("b3", "mag", "3"), ("b4", "mag", "3"), ("b4", "mag", "3"),
        ("c1", "doi", "2"), ("c2", "doi", "2"), ("c3", "doi", "2"), ("d1", "doi", "3"), ("d2", "doi", "3"), ("x1", "arxiv", "1"), ("x1", "doi", None),
        ("gone", "arxiv", "1"), ("e1", "doi", "5"), ("e2", "doi", "5"), (None, "doi", "1"), ("c1", "doi", None), ("d1", "doi", None), ("b1", "doi", " "), ("x1", "doi", " "),
    ]
    got = {
        r.group_id: (r.members, r.title_id, r.year_id) for r in survivors.best_papers(
            papers(spark, rows),
            identifiers(spark, ids),
        ).collect()
    }
    assert got == {"b1": (4, "b1", "b3"), "c1": (3, "c1", "c1"), "d1": (2, None, None), "e1": (2, "e1", "e1")}
    record = {
        r.group_id: (r.title, r.publication_year) for r in survivors.best_records(
            papers(spark, rows),
            identifiers(spark, ids),
        ).collect()
    }
    assert record["b1"] == (long, 2002) and record["d1"] == (None, None)
    assert survivors.best_papers(papers(spark, []), identifiers(spark, [])).count() == 0


@pytest.mark.parametrize("by_field", [True, False])
def test_layers_are_peeled_by_brute_force(spark, by_field):
    rng = random.Random(6)
    at = datetime(2024, 1, 1)
    rows = [
        (f"g{rng.randrange(25)}", f"r{i:03}", rng.random() < 0.4, rng.random() < 0.4, at + timedelta(days=rng.randrange(12)), rng.randrange(3))
        for i in range(160)
    ]
    df = spark.createDataFrame(rows + rows[:9], "g string, id string, a boolean, b boolean, at timestamp, trust int")
    from pyspark.sql import functions as F

    out = survivors.survivors(df, "g", "id", {"a": F.col("a"), "b": F.col("b")}, F.col("at"), F.col("trust"), by_field)
    got = {r.g: (r.a_id, r.a_layer, r.b_id, r.b_layer) for r in out.collect()}
    deep = 0
    for g in {r[0] for r in rows}:
        tops = {}  # of records with the same fields and trust, the latest
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[4] - at).days, r[1])):
            tops.setdefault((r[2], r[3], r[5]), r)
        left, layers = list(tops.values()), {}
        dims = lambda r: ((r[2], r[3]) if by_field else (r[2] + r[3],)) + (r[5], r[4])
        beats = lambda y, x: dims(y) != dims(x) and all(p >= q for p, q in zip(dims(y), dims(x)))
        number = 0
        while left:
            number += 1
            top = [x for x in left if not any(beats(y, x) for y in left)]
            layers |= {x: number for x in top}
            left = [x for x in left if x not in top]
        want = []
        for f in (2, 3):
            able = sorted((n, -(x[4] - at).days, -x[5], x[1]) for x, n in layers.items() if x[f])
            want += [able[0][3], able[0][0]] if able else [None, None]
        assert list(got[g]) == want
        deep += any(n is not None and n > 1 for n in (got[g][1], got[g][3]))
    assert (deep == 0) if by_field else (deep > 0)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [
        (f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(55)
    ] + [(f"z{i:03}", f"z{i + 1:03}") for i in range(40)] + [(None, "n01"), ("n01", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {
        r.node: r.component for r in survivors.components(spark.createDataFrame(links, "u string, v string")).collect()
    }
    assert got == {x: find(x) for x in parent}


def test_beginnings(spark):
    rng = random.Random(4)
    texts = {
        ("g", "".join(rng.choice("ab") for _ in range(rng.randint(1, 24)))) for _ in range(120)
    } | {("h", "a"), ("h", "b")}
    texts |= {(g, t[: rng.randint(1, len(t))]) for g, t in list(texts)}
    got = {
        (r.g, r.t) for r in survivors.beginnings(
            spark.createDataFrame(sorted(texts), "g string, t string"),
            "g",
            "t",
        ).collect()
    }
    assert got == {(g, t) for g, t in texts if any(h == g and s != t and s.startswith(t) for h, s in texts)}


def jaccard_pairs(lists, threshold):
    return {(a, b) for a, b in itertools.combinations(sorted(lists), 2) if len(lists[a] & lists[b]) / len(lists[a] | lists[b]) >= threshold}


@pytest.mark.parametrize("held", [similar_sets.HELD, 9])
def test_similar_lists_are_brute_force(spark, held):
    pairs = random_lists(7, papers=40, lists=60)
    found = similar_sets.similar_reference_lists(citations(spark, pairs), 0.6, held)
    lists = lists_of(pairs)
    want = jaccard_pairs(lists, 0.6)
    assert {(r.a, r.b) for r in found.pairs().collect()} == want and want
    classes = defaultdict(list)
    for a, s in sorted(lists.items()):
        classes[frozenset(s)].append(a)
    links = {c[0]: sum(1 for t, d in classes.items() if d[0] != c[0] and len(s & t) / len(s | t) >= 0.6) for s, c in classes.items()}
    got = {r.basket: (r.class_id, r.links) for r in found.summary().collect()}
    assert {b: links[classes[frozenset(lists[b])][0]] for b in lists} == {b: k for b, (_, k) in got.items()}
    assert all(c == classes[frozenset(lists[b])][0] for b, (c, _) in got.items())


@pytest.mark.parametrize("carried, held", [(8, 60_000), (8, 4), (5, 3)])
def test_large_sets_are_in_the_forest_too(spark, monkeypatch, carried, held):
    monkeypatch.setattr(similar_sets, "CARRIED_ITEMS", carried)
    pairs = random_lists(11, papers=30, lists=40)
    found = similar_sets.similar_reference_lists(citations(spark, pairs), 0.6, held)
    assert {(r.a, r.b) for r in found.pairs().collect()} == jaccard_pairs(lists_of(pairs), 0.6)


@pytest.mark.parametrize("split", [3, 1000])
def test_baskets_of_any_size(spark, split):
    pairs = random_lists(4) + [("big", f"p{i % 7:03}") for i in range(40)]
    got = defaultdict(set)
    for r in cooccurrence.baskets(citations(spark, pairs), "citing_paper_id", "cited_paper_id", 5, split=split).collect():
        got[r.basket, r.n].add(r.item)
    want = defaultdict(set)
    for a, b in pairs:
        if a and b:
            want[a].add(b)
    assert got == {(a, len(s)): s for a, s in want.items() if len(s) >= 5}


def test_similar_lists_of_nothing(spark):
    assert similar_sets.similar_reference_lists(citations(spark, [])).pairs().count() == 0
    assert similar_sets.similar_reference_lists(citations(spark, [("a", "b"), (None, "c")])).summary().count() == 0


def test_trees_reach_the_recall():
    for threshold in (0.4, 0.6, 0.8):
        trees = similar_sets.tree_count(threshold)
        assert 1 - (1 - threshold**similar_sets.DEPTH) ** trees >= similar_sets.RECALL
    assert similar_sets.tree_count(1.0) == 1


def test_verifier_loses_no_similar_pair():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, size=rng.integers(5, 20))).astype(np.int32) for _ in range(80)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    sets = similar_sets._Sets([np.zeros(80, np.int32)] * 4 + [np.arange(80), np.diff(starts)], starts, np.concatenate(rows).astype(np.int16))
    p, q = np.triu_indices(80, 1)
    p, q = similar_sets._Verifier(sets, 0.3).similar(p, q)
    want = {(i, j) for i, j in itertools.combinations(range(80), 2) if len(
        np.intersect1d(rows[i], rows[j]),
    ) / len(np.union1d(rows[i], rows[j])) >= 0.3}
    assert set(zip(p.tolist(), q.tolist())) == want
