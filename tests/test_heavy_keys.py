"""Aggregation per key with keys that hold most rows."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillgraph.operators import heavy_keys as H

SCHEMA = "id string, citing_paper_id string, cited_paper_id string, created_at timestamp, n int, citing string, cited string, first_at string, _heavy int, citations int"


def table(spark, rows):
    return spark.createDataFrame(
        [(str(i), a, b, t, 1, "x", "y", "z", 2, 3) for i, (a, b, t) in enumerate(rows)],
        SCHEMA,
    )


def rows_of(hot=400, others=60):
    at = datetime(2024, 1, 1)
    rows = [(f"c{i}", "hot", at + timedelta(hours=i)) for i in range(hot)] + [
        (f"c{i}", f"p{i % 20}", at - timedelta(hours=i)) for i in range(others)
    ]
    rows += rows[:50] + [
        (None, "hot", at),
        ("c1", None, at),
        (None, None, None),
        ("p3", "p3", at),
        ("c9000", "p3", None),
        ("c9001", "late", None),
    ]
    rows += [("c0", "hot", at + timedelta(days=900))]
    return rows


def plain(rows):
    out = defaultdict(dict)
    for a, b, t in rows:
        if a is not None and b is not None and a != b:
            out[b].setdefault(a, []).append(t)
    result = {}
    for b, by in out.items():
        times = [t for ts in by.values() for t in ts if t is not None]
        result[b] = (len(by), min(times, default=None), max(times, default=None))
    return result


def test_summary_is_brute_force_with_and_without_heavy_keys(spark):
    rows = rows_of()
    for share in (1 / 2000, 0.3, 2.0):
        got = {
            r.cited_paper_id: (
                r.citations,
                r.first_at,
                r.last_at,
            ) for r in H.cited_paper_summary(table(spark, rows), share, 7).collect()
        }
        assert got == plain(rows)


def test_most_cited_is_exact_at_the_limit(spark):
    rows = [(f"c{i}", f"p{i}", None) for i in range(39)] + [("d", "p0", None)]
    assert {r.cited_paper_id for r in H.most_cited(table(spark, rows)).collect()} == {f"p{i}" for i in range(39)}
    rows = [(f"c{i}", f"p{i}", None) for i in range(41)] + [("d", "p0", None)]
    assert {r.cited_paper_id for r in H.most_cited(table(spark, rows)).collect()} == {"p0"}


def test_empty_tables(spark):
    assert H.most_cited(table(spark, [])).count() == 0
    assert H.cited_paper_summary(table(spark, [(None, None, None)])).count() == 0
    assert H.heavy_keys(table(spark, []), "cited_paper_id").count() == 0


def test_salts_spread_heavy_and_missing_keys_only(spark):
    df = spark.createDataFrame(
        [("hot", i) for i in range(1000)] + [(None, i) for i in range(50)] + [("one", 1), ("two", 2)],
        "k string, v int",
    )
    got = {
        r.k: (r.n, r.top) for r in H.salted_aggregate(
            df,
            "k",
            [F.col("v")],
            {"n": F.count(F.lit(1)), "top": F.max("v")},
            {"n": F.sum, "top": F.max},
            share=0.5,
        ).collect()
    }
    assert got == {"hot": (1000, 999), None: (50, 49), "one": (1, 1), "two": (1, 2)}
    assert [r.k for r in H.heavy_keys(df, "k", 0.5).collect()] == ["hot"]


def test_semi_join_with_and_without_heavy_keys(spark):
    rows = [("hot", i) for i in range(60)] + [("lost", i) for i in range(60)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    among = spark.createDataFrame([("hot",), ("hot",), ("k3",), ("k4",), (None,)], "k string")
    want = sorted((k, v) for k, v in rows if k in ("hot", "k3", "k4"))
    for heavy in (H.heavy_keys(df, "k", 0.2), df.limit(0)):
        assert sorted(tuple(r) for r in H.keyed_semi_join(df, "k", among, heavy).collect()) == want
