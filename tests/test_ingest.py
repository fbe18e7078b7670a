"""Scans, documents, works, imports and expansion as table operations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import audit, documents, expand, identity, importing, papers, scan
from quillgraph.operators import works as W
from quillgraph.schema import TABLES, Direction

COPY = "id string, normalized_path string, content_hash string, file_size long, file_mtime_ns long, missing_since timestamp, source_id string"
LISTING = "normalized_path string, file_size long, file_mtime_ns long, readable boolean"
SOURCE = "id string, normalized_path string, available boolean"


def scan_model(listing, copies, sources):
    """Source after source, as a sequential scan would."""
    seen, states, counts = set(), {}, {}
    order = sorted(sources, key=lambda s: s[1])
    known = {c[1]: c for c in copies}
    under = lambda p, root: p.startswith(root.rstrip("/") + "/")
    for sid, root, able in order:
        counts[sid] = dict.fromkeys(("found", "new", "changed", "reappeared", "missing"), 0)
        for p, size, time, readable in listing if able else ():
            if not under(p, root):
                continue
            counts[sid]["found"] += 1
            if p in seen:
                continue
            seen.add(p)
            c = known.get(p)
            if not readable:
                states[p] = "unreadable"
                continue
            if c is None:
                states[p] = "new"
            else:
                states[p] = "changed" if c[2] is None or (c[3], c[4]) != (size, time) else "same"
                counts[sid]["reappeared"] += c[5] is not None
            if states[p] != "same":
                counts[sid][states[p]] += 1
    for sid, root, able in order:
        for p, c in known.items():
            if able and p not in seen and p not in states and under(p, root):
                states[p] = "missing" if c[5] is None else "gone"
                counts[sid]["missing"] += c[5] is None
    return states, counts


@pytest.mark.parametrize("number", range(3))
def test_scan_is_the_sequential_one(spark, number):
    rng = random.Random(number)
    roots = ["/a", "/a/b", "/a/b/c", "/d", "/a/bc", "/e/"]
    sources = [(f"s{i}", r, rng.random() < 0.7) for i, r in enumerate(roots)]
    paths = [f"{rng.choice(['/a', '/a/b', '/a/b/c', '/d', '/a/bc', '/e', '/z'])}/f{i}.pdf" for i in range(60)]
    listing = [(p, rng.randint(1, 2), 5, rng.random() < 0.95) for p in paths[:45]]
    from datetime import datetime

    copies = [(
        f"d{i}",
        p,
        rng.choice(["h", "h", None]),
        rng.randint(1, 2),
        5,
        rng.choice([None, None, datetime(2024, 1, 1)]),
        "x",
    ) for i, p in enumerate(paths[20:])]
    listed = [r for r in listing if any(able and r[0].startswith(root.rstrip("/") + "/") for _, root, able in sources)]
    tables = spark.createDataFrame(listed, LISTING), spark.createDataFrame(copies + copies[:3], COPY), spark.createDataFrame(sources, SOURCE)
    diff = scan.scan_diff(*tables)
    states, counts = scan_model(listed, copies, sources)
    assert {r.normalized_path: r.state for r in diff.collect()} == states
    got = {
        r.source_id: {
            k: r[k] for k in ("found", "new", "changed", "reappeared", "missing")
        } for r in scan.scan_counters(tables[0], diff, tables[2]).collect()
    }
    assert got == counts


def test_scan_of_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in (LISTING, COPY, SOURCE)]
    assert scan.scan_diff(*empty).count() == 0
    one = spark.createDataFrame([("s", "/a", False)], SOURCE)
    assert [
        tuple(r)[3:] for r in scan.scan_counters(empty[0], scan.scan_diff(empty[0], empty[1], one), one).collect()
    ] == [(0, 0, 0, 0, 0)]


def test_ancestors(spark):
    df = spark.createDataFrame([("/a/b/c.pdf",), ("/c.pdf",), (None,)], "p string")
    assert [
        r.a for r in df.select(scan.ancestors(F.col("p")).alias("a")).collect()
    ] == [["/", "/a", "/a/b"], ["/"], None]


def keys(*pairs):
    return [(s, v, v) for s, v in pairs]


IDENTIFIER = "id string, paper_id string, scheme string, value string, normalized_value string"
KEYS = "array<struct<scheme:string,value:string,normalized_value:string>>"


def identifiers(spark, rows):
    return spark.createDataFrame([(str(i), p, s, v, v) for i, (p, s, v) in enumerate(rows)], IDENTIFIER)


HELD = [
    ("p1", "doi", "1"),
    ("p1", "doi", "1"),
    ("p1", "arxiv", "7"),
    ("p2", "doi", "2"),
    (None, "doi", "9"),
    ("p3", "doi", None),
]


def test_resolution(spark):
    groups = [
        ("a", keys(("doi", "1"))),
        ("b", keys(("doi", "1"), ("arxiv", "7"))),
        ("c", keys(("doi", "1"), ("doi", "2"), ("doi", "3"))),
        ("d", keys(("doi", "3"), ("arxiv", "8"))),
        ("e", []),
        ("f", keys(("doi", "9"))),
    ]
    got = {
        r.g: r for r in identity.resolve(
            spark.createDataFrame(groups, f"g string, identifiers {KEYS}"),
            identifiers(spark, HELD),
            "g",
        ).collect()
    }
    assert {g: r.status for g, r in got.items()} == {
        "a": "matched",
        "b": "matched",
        "c": "ambiguous",
        "d": "new",
        "e": "insufficient",
        "f": "new",
    }
    assert got["a"].paper_id == "p1" and got["c"].paper_id is None and got["c"].candidate_paper_ids == ["p1", "p2"]
    assert [tuple(u) for u in got["c"].unassigned] == keys(("doi", "3")) and [
        u.normalized_value for u in got["d"].unassigned
    ] == ["3", "8"]
    assert got["e"].candidate_paper_ids == [] and got["e"].unassigned == []


def test_conflicts_and_records(spark):
    held = identifiers(spark, [*HELD, ("p4", "doi", "1")])
    assert [
        tuple(r) for r in identity.conflicts(held).orderBy("paper_id").collect()
    ] == [("doi", "1", "p1"), ("doi", "1", "p4")]
    paper = spark.createDataFrame(
        [("p1", "T", 2000, None, None), ("p9", "", None, None, None)],
        "id string, title string, publication_year int, created_at timestamp, library_added_at timestamp",
    )
    rows = {r.id: r for r in papers.paper_records(paper, held).collect()}
    assert [
        (i.scheme, i.normalized_value) for i in rows["p1"].identifiers
    ] == [("arxiv", "7"), ("doi", "1")] and rows["p9"].identifiers == []
    labels = {
        r.id: (r.a, r.b) for r in papers.paper_records(paper, held).select(
            "id",
            papers.paper_label().alias("a"),
            papers.short_label().alias("b"),
        ).collect()
    }
    assert labels == {"p1": ("T", "T"), "p9": ("p9", "p9")}
    found = papers.paper_records(paper, held).where(papers.text_filter(" DOI: 1")).collect()
    assert [r.id for r in found] == ["p1"]


def identify_model(docs, held):
    held = {(s, v): p for p, s, v in held if p and v}
    out = {}
    for d, ids in docs:
        owners = sorted({held[k] for k in ids if k in held})
        if not ids:
            out[d] = ("unidentified", None)
        elif len(owners) > 1 or len(ids) > 1 and not (len(owners) == 1 and all(k in held for k in ids)):
            out[d] = ("ambiguous", None, owners)
        else:
            paper = owners[0] if owners else f"new:{ids[0]}"
            out[d] = ("linked" if owners else "created", paper)
            held.update(dict.fromkeys(ids, paper))
    return out


@pytest.mark.parametrize("number", range(3))
def test_identification_is_the_sequential_one(spark, number):
    rng = random.Random(number)
    pool = [("doi", str(i)) for i in range(1, 12)] + [("arxiv", "7")]
    docs = [(f"d{i:02}", list(dict.fromkeys(rng.choices(pool, k=rng.choice([0, 1, 1, 1, 2, 3]))))) for i in range(40)]
    df = spark.createDataFrame(
        [(d, i, keys(*ids)) for i, (d, ids) in enumerate(docs)],
        f"document_id string, order int, identifiers {KEYS}",
    )
    got = {r.document_id: r for r in documents.identify(df, identifiers(spark, HELD)).collect()}
    want = identify_model(docs, HELD)
    assert {d: r.status for d, r in got.items()} == {d: w[0] for d, w in want.items()}
    made = {}
    for d, w in want.items():  # the same documents share a paper
        if w[1] is not None:
            assert made.setdefault(w[1], got[d].paper_id) == got[d].paper_id
            assert not w[1].startswith("p") or w[1] == got[d].paper_id
        elif w[0] == "ambiguous":
            assert len(got[d].candidate_paper_ids) == len(w[2])
    total = documents.summary(documents.identify(df, identifiers(spark, HELD))).first()
    assert total.linked + total.ambiguous + total.unidentified == 40


WORKS = [
    (
        "W1",
        [("openalex", "W1"), ("doi", "https://doi.org/10.1/S")],
        "Seed",
        2020,
        ["https://openalex.org/W2", "W3", "W2", "bad", "W77"],
        2,
    ),
    (
        "W2",
        [("openalex", "W2"), ("doi", "10.1/two")],
        "Ref one",
        2019,
        ["W6"],
        1,
    ), ("W3", [("openalex", "W3")], "Ref two", 2018, [], 1),
    ("W4", [("openalex", "W4"), ("arxiv", "2401.00001")], "Citer one", 2021, ["W1"], 0), (
        "W5",
        [("openalex", "W5"), ("arxiv", "2401.00001")],
        "Citer two",
        2022,
        ["W1", "W4"],
        9,
    ),
    ("W6", [("openalex", "W6")], "Ref three", 2010, None, 1), (
        "W8",
        [("openalex", "nonsense")],
        None,
        None,
        None,
        None,
    ),
]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(
        WORKS,
        "work_id string, identifiers array<struct<scheme:string,value:string>>, title string, publication_year int, referenced_works array<string>, cited_by_count long",
    ).cache()


def test_provider_records(spark):
    payloads = [
        '{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.5/A", "display_name": " T ", "publication_year": 2001, "referenced_works": ["W2"], "locations": [{"landing_page_url": "https://arxiv.org/abs/2401.00001"}]}',
        '{"id": "W2", "doi": "10.48550/arXiv.2401.00002", "display_name": "", "publication_year": true}',
        '{"id": "W3", "doi": null, "publication_year": 2001.5, "locations": [{"landing_page_url": "http://arxiv.org/abs/2401.00003v2"}, {"landing_page_url": "https://doi.org/10.48550/arXiv.2401.00003"}, {}]}',
        '{"id": "W4", "doi": "broken", "locations": [{"landing_page_url": "http://arxiv.org/abs/2401.00003"}, {"landing_page_url": "http://arxiv.org/abs/2401.00004"}]}',
        '{"id": "A5"}', "not json", None, '{"id": "W1"}',
    ]
    rows = {
        r.work_id: r for r in W.parse_works(
            spark.createDataFrame([(p,) for p in payloads[:-1]], "payload string")
        ).collect()
    }
    assert set(rows) == {"W1", "W2", "W3", "W4"}
    assert [
        tuple(i) for i in rows["W1"].identifiers
    ] == [("openalex", "W1"), ("doi", "10.5/A")] and rows["W1"].title == "T" and rows["W1"].publication_year == 2001
    assert [tuple(i) for i in rows["W2"].identifiers] == [
        ("openalex", "W2"),
        ("doi", "10.48550/arXiv.2401.00002"),
        ("arxiv", "2401.00002"),
    ]
    assert rows["W2"].title is None and rows["W2"].publication_year is None and rows["W3"].publication_year is None
    assert [tuple(i) for i in rows["W3"].identifiers] == [
        ("openalex", "W3"),
        ("arxiv", "2401.00003"),
    ] and [tuple(i) for i in rows["W4"].identifiers] == [("openalex", "W4")]
    assert W.parse_works(spark.createDataFrame([(p,) for p in payloads], "payload string")).count() == 4


def test_lookup_order_and_arxiv_guard(spark, works):
    asked = [
        ("a", keys(("arxiv", "2401.00001"))),
        ("b", keys(("arxiv", "x"), ("doi", "10.1/s"))),
        ("c", keys(("doi", "10.1/two"), ("openalex", "W6"))),
        ("d", keys(("mag", "1"))),
        ("e", []),
        # Only the first identifier of a scheme is asked for.
        ("f", keys(("doi", "10.9/none"), ("doi", "10.1/s"), ("openalex", "W99"))),
        ("g", keys(("doi", "10.9/none"), ("openalex", "W99"), ("openalex", "W2"))),
    ]
    got = {
        r.k: r.work_id for r in W.lookup(
            spark.createDataFrame(asked, f"k string, identifiers {KEYS}"),
            works,
            "k",
        ).collect()
    }
    assert got == {"b": "W1", "c": "W6"}


def test_arxiv_pages_are_asked_for_one_way_after_the_other(spark):
    page = lambda way, i: f"{way}://arxiv.org/abs/2401.0000{i}"
    rows = [
        ("W1", [page("http", 1), page("https", 1)]),
        ("W2", [page("https", 2)]),
        ("W3", [page("http", 3), page("http", 4)]),
        ("W4", [page("https", 3), page("http", 4), page("http", 4)]),
        ("W5", [page("https", 5)]),
        ("W6", [page("https", 5), "http://arxiv.org/pdf/2401.00006"]),
        ("W7", None),
    ]
    known = spark.createDataFrame(rows, "work_id string, landing_pages array<string>").withColumn(
        "identifiers", F.array().cast("array<struct<scheme:string,value:string>>")
    )
    asked = [(str(i), keys(("arxiv", f"2401.0000{i}"))) for i in range(1, 7)]
    hits = W.lookup(spark.createDataFrame(asked, f"k string, identifiers {KEYS}"), known, "k").collect()
    # Several works under the http page are no answer, though one is under the https page.
    assert {r.k: r.work_id for r in hits} == {"1": "W1", "2": "W2", "3": "W3"}


def test_references_citations_and_search(works):
    of = works.where("work_id = 'W1'")
    refs = W.fetch_references(of, works, 10).orderBy("pos").collect()
    assert [(r.pos, r.other_id, r.title) for r in refs] == [
        (0, "W2", "Ref one"),
        (1, "W3", "Ref two"),
        (4, "W77", None),
    ]
    assert [tuple(i) for i in refs[2].identifiers] == [("openalex", "W77")]
    assert [r.other_id for r in W.fetch_references(of, works, 3).orderBy("pos").collect()] == ["W2", "W3"]
    assert [r.other_id for r in W.fetch_citations(of, works, 10).orderBy("pos").collect()] == ["W5", "W4"]
    assert [r.other_id for r in W.fetch_citations(of, works, 1).collect()] == ["W5"]
    assert [r.work_id for r in W.search(works, "ref two", 5).collect()] == ["W3"]


def test_imports(spark, works):
    held = identifiers(spark, [("p1", "doi", "10.1/s"), ("p2", "openalex", "W2"), ("p3", "doi", "10.1/two")])
    asked = [
        ("a", keys(("doi", "10.1/s"), ("mag", "5"))),
        ("b", keys(("openalex", "W2"))),
        ("c", keys(("openalex", "W3"))),
        ("d", keys(("openalex", "W99"))),
        ("e", keys(("arxiv", "2401.00001"))),
    ]
    got = {
        r.k: r for r in importing.import_status(
            spark.createDataFrame(asked, f"k string, identifiers {KEYS}"),
            works,
            held,
            "k",
        ).collect()
    }
    assert {k: r.status for k, r in got.items()} == {
        "a": "matched",
        "b": "ambiguous",
        "c": "created",
        "d": None,
        "e": None,
    }
    assert got["a"].paper_id == "p1" and [i.normalized_value for i in got["a"].added] == ["W1"] and [
        i.normalized_value for i in got["a"].ignored
    ] == ["5"]
    assert got["b"].candidate_paper_ids == ["p2", "p3"] and got["c"].paper_id is not None
    status = {r.work_id: r.status for r in importing.candidates(works, held).collect()}
    assert status == {"W1": "existing", "W2": "ambiguous", "W3": "new", "W4": "new", "W5": "new", "W6": "new"}


def test_metadata(spark, works):
    held = identifiers(
        spark,
        [
            ("p1", "doi", "10.1/s"),
            ("p2", "openalex", "W2"),
            ("p3", "doi", "10.1/two"),
            ("p4", "openalex", "W3"),
            ("p5", "mag", "1"),
        ],
    )
    paper = spark.createDataFrame(
        [("p1", None, 1999), ("p2", "Old", None), ("p3", None, None), ("p4", "Mine", None), ("p5", None, None)],
        "id string, title string, publication_year int",
    )
    got = {r.paper_id: r for r in importing.metadata_fill(paper, held, works).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "p1": "updated",
        "p2": "conflict",
        "p3": "conflict",
        "p4": "updated",
    }
    assert (
        got["p1"].title,
        got["p1"].publication_year,
        got["p1"].title_set,
        got["p1"].year_set,
    ) == ("Seed", 1999, True, False)
    assert (
        got["p4"].title,
        got["p4"].publication_year,
        got["p4"].title_set,
        got["p4"].year_set,
    ) == ("Mine", 2018, False, True)
    assert [i.normalized_value for i in got["p1"].added] == ["W1"] and got["p2"].title == "Old"


def work(i, *more):
    return expand.Work(f"W{i}", [("openalex", f"W{i}", f"W{i}"), *more])


def test_walk_within_a_budget():
    refs, cites = {"W0": [work(i) for i in range(1, 11)]}, {"W0": [work(i) for i in range(11, 21)]}
    asked = []

    def prepare(level, ways, limit):
        def near(centre, outgoing, share):
            asked.append((centre.work_id, outgoing, share))
            return (refs if outgoing else cites).get(centre.work_id, [])[:share]

        return near

    found = expand.walk(work(0), prepare, Direction.both, 1, 7)
    assert [k[1] for k in found.works] == ["W0", "W1", "W2", "W3", "W11", "W12", "W13"]
    assert found.truncated and len(found.edges) == 6 and asked == [("W0", True, 3), ("W0", False, 3)]
    whole = expand.walk(work(0), prepare, Direction.both, 1, 100)
    assert len(whole.works) == 21 and not whole.truncated
    assert len(expand.walk(work(0), prepare, Direction.references, 1, 100).works) == 11
    assert expand.walk(work(0), prepare, Direction.both, 2, 1).truncated


def test_a_budget_cuts_the_list_as_given(spark):
    rows = [
        ("W1", ["W2", "w2", "W3", "W4"], 0),
        ("W2", ["bad", "W5", "W1"], 0),
        *((f"W{i}", None, 0) for i in (3, 4, 5)),
    ]
    known = spark.createDataFrame(rows, "work_id string, referenced_works array<string>, cited_by_count long").selectExpr(
        "*", "array(struct('openalex' AS scheme, work_id AS value)) AS identifiers", "CAST(NULL AS STRING) AS title", "CAST(NULL AS INT) AS publication_year"
    )
    go = lambda most, depth=1: expand.walk(work(1), expand.offline_neighbours(known), Direction.both, depth, most)
    # Of a budget of five, two are the references' share: W2 and its repeat, so one work.
    first = go(5)
    assert [k[1] for k in first.works] == ["W1", "W2"] and not first.truncated
    assert [k[1] for k in go(8).works] == ["W1", "W2", "W3", "W4"]
    # W2's share of three holds a broken id, W5 and the seed.
    deep = go(7, 2)
    assert list(deep.works)[-1] == ("openalex", "W5") and (("openalex", "W2"), ("openalex", "W1")) in deep.edges


def test_walk_over_tables(works):
    seed = expand.Work("W1", [("openalex", "W1", "W1")])
    found = expand.walk(seed, expand.offline_neighbours(works), Direction.both, 2, 50)
    assert {(a[1], b[1]) for a, b in found.edges} == {
        ("W1", "W2"),
        ("W1", "W3"),
        ("W1", "W77"),
        ("W5", "W1"),
        ("W4", "W1"),
        ("W2", "W6"),
        ("W5", "W4"),
    }
    assert not found.truncated


def test_storing_a_walk_in_order():
    doi = lambda v: ("doi", v, v)
    walk = expand.Walk(
        {("openalex", f"W{w.work_id[1:]}"): w for w in (
            work(0),
            work(1, doi("a")),
            work(2, doi("a"), doi("b")),
            work(3, doi("b"), doi("z")),
            work(4, doi("q"), doi("z")),
        )}
    )
    key = lambda i: ("openalex", f"W{i}")
    walk.edges = dict.fromkeys([(key(0), key(1)), (key(0), key(2)), (key(2), key(1)), (key(3), key(0)), (key(4), key(0))])
    made = iter("xyz")
    out = expand.fold(walk, key(0), "seed", {("doi", "z"): "old", ("doi", "q"): "old"}, lambda k: next(made))
    # W2 meets the paper made for W1; W3 shares one identifier with that and one with a stored paper.
    assert out.created == ["x"] and out.matched == ["x", "old"] and [k for k, _ in out.skipped] == [key(3)]
    assert out.edges == [("seed", "x"), ("old", "seed")] and out.fills == {"x": (None, None), "old": (None, None)}
    assert [a[:2] + a[3:] for a in out.added] == [
        ("x", "openalex", "W1"), ("x", "doi", "a"), ("x", "openalex", "W2"), ("x", "doi", "b"), ("old", "openalex", "W4"),
    ]


def test_next_steps(spark):
    hints = "document_id int, pos int, scheme string, normalized_value string, paper_id string"
    matches = [
        (1, 0, "doi", "10.1/a", "p2"), (1, 1, "doi", "10.1/b", "p1"), (1, 2, "arxiv", "2401.1", None), (1, 3, "doi", "10.1/a", "p2"),
        (2, 0, "arxiv", "2401.2", None), (2, 1, "doi", "10.1/c", None), (3, 0, "mag", "7", None),
    ]
    from datetime import datetime

    paper = spark.createDataFrame([("p1", datetime(2024, 1, 1)), ("p2", datetime(2024, 1, 2))], "id string, created_at timestamp")
    every = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "document_id int")
    rows = documents.next_steps(every, spark.createDataFrame(matches, hints), paper).orderBy("document_id", "rank").collect()
    assert [tuple(r) for r in rows] == [
        (1, 1, "link", "p1"), (1, 2, "link", "p2"), (1, 3, "import", "arxiv:2401.1"), (2, 1, "import", "arxiv:2401.2"),
        (2, 2, "import", "doi:10.1/c"), (3, 1, "search", None), (4, 1, "search", None),
    ]


def test_node_labels(spark):
    ids = "array<struct<scheme:string,normalized_value:string,value:string>>"
    rows = [("aaaaaaaabb", "t" * 41, []), ("b", "", [("doi", "10.1/a", "https://doi.org/10.1/A")]), ("ccccccccdd", None, [])]
    df = spark.createDataFrame(rows, f"id string, title string, identifiers {ids}")
    assert [r.l for r in df.select(papers.short_label().alias("l")).collect()] == ["t" * 40 + "…", "doi:10.1/a", "cccccccc"]


def test_audit(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    frames = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    assert {r.violations for r in audit.violations(frames).collect()} == {0}
    frames["citation"] = spark.createDataFrame(
        [("1", "a", "b", at), ("2", "a", "b", at), ("3", "a", "a", at), ("4", None, "a", at)],
        TABLES["citation"],
    )
    frames["paper"] = spark.createDataFrame([("a", None, None, at, None)], TABLES["paper"])
    got = {r.rule: r.violations for r in audit.violations(frames).collect()}
    assert (
        got["citation repeated"],
        got["citation of itself"],
        got["citation without an end"],
        got["cited paper not stored"],
    ) == (1, 1, 1, 2)
