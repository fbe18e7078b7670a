"""Normalisers, text folding and hints as column expressions."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import hints, normalize
from quillgraph.functions.text import fold, strip
from quillgraph.operators import identity


def apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


BLANKS = ["", " ", "\t", "\n", "\x1f", "\u00a0", "\u2003 ", "\u3000"]


def mixed(text, rng):
    return "".join(c.upper() if rng.random() < 0.5 else c.lower() for c in text)


def spelled(prefixes, body, ends=("",)):
    """A value behind every prefix, in any case, between any blanks."""
    rng = random.Random(9)
    return [rng.choice(BLANKS) + mixed(p, rng) + body + e + rng.choice(BLANKS) for p in ("", *prefixes) for e in ends]


def test_dois(spark):
    for typed, normal in (("10.7717/PeerJ.4375", "10.7717/peerj.4375"), ("10.1/ÖSE(2)<7>", "10.1/Öse(2)<7>"), ("10.9.8/x/Y", "10.9.8/x/y")):
        values = spelled(normalize.DOI_PREFIXES, typed)
        assert apply(spark, normalize.normalize_doi, values) == [normal] * len(values)
    wrong = [None, *BLANKS, "11.7717/x", "10.7717", "10./x", "10.7717/", "10.77 17/x", "10.7717/x y", "10.7717/x\ny", "doi:  10.7717/x", "doi:DOI:10.7717/x", "ftp://doi.org/10.7717/x", "see 10.7717/x"]
    assert apply(spark, normalize.normalize_doi, wrong) == [None] * len(wrong)


def test_arxiv_ids(spark):
    before = ["arxiv:", "https://arxiv.org/abs/", "http://arxiv.org/abs/", "https://arxiv.org/pdf/", "http://arxiv.org/pdf/"]
    for body in ("1706.03762", "0704.0001", "cond-mat/0207270", "math.AG/0601001"):
        values = spelled(before, body, ("", "v1", "v12", ".pdf", "v3.pdf"))
        assert apply(spark, normalize.normalize_arxiv, values) == [body] * len(values)
    wrong = [None, *BLANKS, "1706.037", "1706.037620", "170.03762", "1706.03762v", "1706.03762.PDF", "1706.03762 v2", "arxiv: 1706.03762", "arxiv:arxiv:1706.03762", "Cond-mat/0207270", "cond-mat/020727", "math.ag/0601001", "1706.03762\n1"]
    assert apply(spark, normalize.normalize_arxiv, wrong) == [None] * len(wrong)


def test_work_ids(spark):
    before = ["openalex:", "https://openalex.org/", "http://openalex.org/", "https://api.openalex.org/works/", "https://openalex.org/works/"]
    for body in ("W7", "w2100837269"):
        values = spelled(before, body)
        assert apply(spark, normalize.normalize_openalex, values) == [body.upper()] * len(values)
    wrong = [None, *BLANKS, "W", "7", "V7", "W7a", "W 7", "openalex:openalex:W7", "https://openalex.org/authors/W7"]
    assert apply(spark, normalize.normalize_openalex, wrong) == [None] * len(wrong)


def test_schemes_generic_values_and_titles(spark):
    names = ["ISBN", " s2-corpus.id_7 ", "9x", *BLANKS, None, "two words", "-isbn", ".x", "isbn!", "ïsbn"]
    assert apply(spark, normalize.normalize_scheme, names) == ["isbn", "s2-corpus.id_7", "9x"] + [None] * (len(names) - 3)
    values = ["\t Hal-00Aa \u3000", *BLANKS, None]
    assert apply(spark, normalize.normalize_generic, values) == ["Hal-00Aa"] + [None] * (len(values) - 1)
    assert apply(spark, normalize.clean_title, ["\x1c On  Tea\x1d ", *BLANKS, None]) == ["On  Tea"] + [None] * (len(BLANKS) + 1)


def test_folding(spark):
    same = ["Große  Straßen, vol. 2", "GROSSE\u200bSTRASSEN (Vol 2)", "«große-straßen_vol\n2»", "g.r.o.s.s.e.s.t.r.a.s.s.e.n vol2"]
    assert len(set(apply(spark, fold, same))) == 1
    assert apply(spark, fold, [None, "", " …!?", "A+B"]) == [None, "", "", "a+b"]
    assert apply(spark, strip, ["\t x \x1f"]) == ["x"]


def test_identifier_lists(spark):
    lists = {
        "many": [("Doi", "doi:10.2/B"), ("HAL", " h1 "), ("doi", "10.2/b"), ("a b", "x"), ("arxiv", "nothing"), ("hal", "h1"), ("ARXIV", "1706.03762v5")],
        "none": None,
        "empty": [],
    }
    df = spark.createDataFrame(list(lists.items()), "k string, ids array<struct<scheme:string,value:string>>")
    rows = df.select("k", identity.normalized_identifiers(F.col("ids")).alias("good"), identity.invalid_identifiers(F.col("ids")).alias("bad"))
    got = {r.k: ([tuple(x) for x in r.good], [tuple(x) for x in r.bad]) for r in rows.collect()}
    assert got == {
        "many": (
            [("doi", "doi:10.2/B", "10.2/b"), ("hal", " h1 ", "h1"), ("arxiv", "1706.03762v5", "1706.03762")],
            [("a b", "x"), ("arxiv", "nothing")],
        ),
        "none": ([], []),
        "empty": ([], []),
    }


def test_file_names(spark):
    named = {
        "/x/0704.0001v3.pDf": ("0704.0001v3", "0704.0001"), "1706.03762.pdf": ("1706.03762", "1706.03762"),
        "/1706.03762/x.pdf": None, "/x/1706.03762 (1).pdf": None, "/x/1706.03762.txt": None, "/x/v1706.03762.pdf": None,
        "/x/10.2_b.pdf": None, "/x/": None, "": None,
    }
    got = apply(spark, hints.filename_hints, list(named))
    assert [(h[0].value, h[0].normalized_value) if h else None for h in got] == list(named.values())
    assert not apply(spark, hints.filename_hints, [None])[0]


def peeled(value):
    """Mark by mark from the end; a closing bracket stays if there is an opening one."""
    while value and value[-1] in ".,;:)]}" and not (value[-1] == ")" and "(" in value):
        value = value[:-1]
    return value


def test_trailing_punctuation(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab(.,;:)]}") for _ in range(rng.randrange(9))) for _ in range(300)] + [None]
    assert apply(spark, hints.strip_trailing_punctuation, values) == [None if v is None else peeled(v) for v in values]


def test_what_looks_like_a_doi(spark):
    good = ["10.7717/peerj.4375", " 10.7717/x ", "DOI:anything", "https://dx.doi.org/"]
    bad = ["", "10.77/x", "10.1234567890/x", "see 10.7717/x", "10.7717/x y", "10.7717/<x>", "urn:doi:10.7717/x"]
    assert apply(spark, hints.looks_like_doi, good + bad) == [True] * len(good) + [False] * len(bad)


def by_place(text):
    """All stamps and DOIs by two searches, in the order of their places."""
    import re

    found = [(m.start(), "arxiv", m[1]) for m in re.finditer(rf"arXiv:({hints.ARXIV_ID})", text, re.I)]
    found += [(m.start(), "doi", m[0]) for m in re.finditer(r'\b10\.\d{4,9}/[^\s"<>]+', text)]
    return list(dict.fromkeys((s, v) for _, s, v in sorted(found)))


PIECES = ["arXiv:1706.03762", "ARXIV:0704.0001v2", "10.7717/", "10.48550/", "x", " ", "/", "v10.1234/y", ".", '"', "<", "(", "10.1234/z", "é", "\n", "0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_first_page_marks_are_those_of_two_searches(text):
    assert hints.text_matches(text) == by_place(text)


def test_document_hints(spark):
    page = "1706.03762 arXiv:1706.03762v5 cites (10.7717/PeerJ.4375). Also 10.48550/arXiv:0704.0001, 10.7717/peerj.4375"
    rows = [
        (1, page, {"/Doi": "doi:10.7717/PEERJ.4375", "/Author": "10.5/x"}, ["10.9999/xmp", "doi:10.7717/peerj.4375"]),
        (2, None, None, None),
        (3, "nothing", {"DOI": "unreadable"}, []),
    ]
    df = spark.createDataFrame(rows, "i int, t string, info map<string,string>, x array<string>")
    df = df.withColumn("m", hints.located(F.col("t")))
    each = df.select("i", hints.document_hints(F.lit("/x/0704.0001.pdf"), F.col("info"), F.col("x"), F.col("m")).alias("h"))
    got = {r.i: [(h.normalized_value, h.origin) for h in r.h] for r in each.collect()}
    own = ("0704.0001", "filename")
    assert got == {
        1: [
            own, ("10.7717/peerj.4375", "pdf_metadata"), ("10.9999/xmp", "pdf_metadata"), ("1706.03762", "pdf_text"),
            ("10.7717/peerj.4375", "pdf_text"), ("10.48550/arxiv:0704.0001", "pdf_text"), ("0704.0001", "pdf_text"),
        ],
        2: [own],
        3: [own],
    }
    chosen = {r.i: [x.normalized_value for x in r.s] for r in each.select("i", hints.select_identifiers(F.col("h")).alias("s")).collect()}
    assert chosen == {1: ["0704.0001", "10.7717/peerj.4375", "10.9999/xmp", "1706.03762"], 2: ["0704.0001"], 3: ["0704.0001"]}


def test_weak_hints_count_only_alone(spark):
    df = spark.createDataFrame([("see 10.7717/a, 10.7717/b",)], "t string").withColumn("m", hints.located(F.col("t")))
    rows = df.select(hints.document_hints(F.lit("x.pdf"), matches=F.col("m")).alias("h")).select(hints.select_identifiers(F.col("h")).alias("s"))
    assert [x.normalized_value for x in rows.first().s] == ["10.7717/a", "10.7717/b"]


XMP = [
    ("<x prism:doi='10.2/attr' other:doi='10.2/no'>", ["10.2/attr"]),
    ("<PRISM:DOI>10.2/a</prism:doi><pdfx:doi a='>'>10.2/b</pdfx:doi>", ["10.2/a", "'>10.2/b"]),
    ("<pdfx:doi>10.2/a<i> b</i></pdfx:doi >", ["10.2/a  b"]),
    ("<dc:identifier><rdf:Seq><rdf:li> 10.2222/b </rdf:li><rdf:li>isbn 7</rdf:li><rdf:li>DOI:q</rdf:li></rdf:Seq></dc:identifier>", ["10.2222/b", "DOI:q"]),
    ("<dc:identifier>10.22/short</dc:identifier><dc:identifier/><dc:title>10.2222/t</dc:title>", []),
    ("<crossmark:doi>10.2/never closed <pdfx:doi>10.2/c</pdfx:doi>", ["10.2/c"]),
    ("<pdfx:doi>10.2/d</pdfx:doi><y crossmark:DOI = \"10.2/e\"/><prism:doi>10.2/f</prism:doi>", ["10.2/d", "10.2/e", "10.2/f"]),
    ("<rdf:li>10.2222/alone</rdf:li> < > <> </> <!-- -->", []),
    ("", []),
    (None, []),
]


def test_xmp(spark):
    for xml, values in XMP:
        assert hints.xmp_values(xml) == values, xml
    df = hints.with_xmp_values(spark.createDataFrame([(i, xml) for i, (xml, _) in enumerate(XMP)], "i int, xmp string"))
    got = {r.i: [h.normalized_value for h in r.h] for r in df.select("i", hints.xmp_hints(F.col("xmp_values")).alias("h")).collect()}
    assert got[3] == ["10.2222/b"] and got[6] == ["10.2/d", "10.2/e", "10.2/f"] and got[8] == got[9] == []
