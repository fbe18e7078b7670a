"""Use cases on stored tables, from files to JSON."""

from __future__ import annotations

import http.client
import json
import os
import urllib.error
import urllib.parse
from datetime import datetime, timezone
from enum import Enum
from io import BytesIO, StringIO

import pytest
from pyspark.sql import functions as F

from quillgraph import api, cli, errors
from quillgraph.library import Library
from quillgraph.operators import expand
from quillgraph.plans.inspect import operators, pushed_filters, scanned_columns
from quillgraph.schema import Direction
from quillgraph.serialize import dumps, failure, json_lines, success, to_json_value, write_success
from quillgraph.sources import files
from quillgraph.sources.catalog import Catalog, StaleSnapshot
from quillgraph.sources.provider import TableProvider, WebProvider, http_transport, read_works
from tests.test_ingest import WORKS


@pytest.fixture
def library(spark, tmp_path):
    own = Library(spark, str(tmp_path / "db"))
    assert own.initialize() and not own.initialize()
    return own


@pytest.fixture(scope="module")
def provider(spark):
    return TableProvider(
        spark.createDataFrame(
            WORKS,
            "work_id string, identifiers array<struct<scheme:string,value:string>>, title string, publication_year int, referenced_works array<string>, cited_by_count long",
        ),
    )


def test_catalog(spark, tmp_path):
    with pytest.raises(errors.DatabaseNotInitialized):
        Catalog(spark, str(tmp_path / "none")).table("paper")
    catalog = Catalog(spark, str(tmp_path / "db"))
    catalog.initialize()
    at = catalog.pointer()
    row = spark.createDataFrame([("a", None, None, datetime(2024, 1, 1), None)], catalog.table("paper").schema)
    catalog.commit({"paper": row}, at)
    assert catalog.table("paper").count() == 1 and catalog.table("paper", at).count() == 0
    with pytest.raises(StaleSnapshot):
        catalog.commit({"paper": row}, at)
    # Two writers that both saw the same state: the number is given once.
    late = catalog.pointer()
    catalog.commit({}, late, {"paper": row})
    with pytest.raises(StaleSnapshot):
        catalog._write(late["snapshot"] + 1, late)
    now = catalog.pointer()
    assert catalog.table("paper").count() == 2 and len(now["tables"]["paper"]) == 2
    assert catalog.clean_up(1) == 1 and catalog.table("paper").count() == 2 and catalog.pointer() == now
    catalog._write(now["snapshot"] + 1, now | {"schema_version": 99, "snapshot": now["snapshot"] + 1})
    with pytest.raises(errors.DatabaseNotInitialized):
        catalog.tables()


def test_papers_citations_and_graphs(library):
    a = library.create_paper([("DOI", "10.1/A"), ("doi", "10.1/a")], "  First ")
    b, c = library.create_paper([("arxiv", "2401.00001v3")]), library.create_paper(title=" ")
    assert [(i.scheme, i.normalized_value) for i in library.paper(a).identifiers] == [("doi", "10.1/a")]
    assert library.paper(a).title == "First" and library.paper(c).title is None
    with pytest.raises(errors.IdentifierConflict) as conflict:
        library.create_paper([("doi", "https://doi.org/10.1/A")])
    assert conflict.value.conflicts == [("doi", "10.1/a", a)]
    with pytest.raises(errors.InvalidIdentifier):
        library.create_paper([("doi", "x")])
    with pytest.raises(errors.PaperNotFound):
        library.paper("nobody")
    assert library.add_to_library(a) and not library.add_to_library(a) and library.add_to_library(b)
    assert library.remove_from_library(b) and not library.remove_from_library(b)
    assert library.add_citation(a, b) and not library.add_citation(a, b) and library.add_citation(b, c)
    for bad, error in (((a, a), errors.SelfCitation), ((a, "nobody"), errors.PaperNotFound)):
        with pytest.raises(error):
            library.add_citation(*bad)
    assert library.path(a, c) == [a, b, c] and library.path(a, a) == [a]
    with pytest.raises(errors.CitationPathNotFound):
        library.path(c, a)
    assert [r.id for r in library.citations_of(b, Direction.citations).collect()] == [a]
    graph = library.neighborhood(a, 2)
    assert [
        (n["paper"].id, n["distance"]) for n in graph["nodes"].collect()
    ] == [(a, 0), (b, 1), (c, 2)] and graph["edges"].count() == 2
    assert [n["paper"].id for n in library.library_graph()["nodes"].collect()] == [a]
    assert library.totals().asDict() == {"papers": 3, "library": 1, "citations": 2}
    status, text = api.answer(library, f"/api/graph/neighborhood/{a.upper()}", "depth=2&direction=references")
    shown = json.loads(text)["data"]
    assert status == 200 and shown["nodes"][0]["paper"]["in_library"] is True and shown["depth"] == 2
    assert shown["nodes"][0]["paper"]["created_at"].endswith("+00:00") and [e["cited_paper_id"] for e in shown["edges"]] == [b, c]
    for query, kind in (("depth=3", "InvalidParameter"), ("depth=x", "InvalidParameter"), ("direction=up", "InvalidParameter")):
        status, text = api.answer(library, f"/api/graph/neighborhood/{a}", query)
        assert (status, json.loads(text)["error"]["type"]) == (400, kind)
    assert api.answer(library, f"/papers/{a}/graph", "depth=0")[0] == 400
    assert api.answer(library, "/api/graph/neighborhood/00000000-0000-0000-0000-000000000000")[0] == 404
    assert api.answer(library, "/nothing")[0] == 404
    page = {r.id: (r.references, r.citations) for r in api.papers_page(library)["papers"].collect()}
    assert page == {a: (1, 0), b: (1, 1), c: (0, 1)}
    front = json.loads(api.answer(library, "/")[1])["data"]
    assert front["totals"]["papers"] == 3 and {m["id"] for m in front["most_cited"]} == {b, c}
    one = api.paper_page(library, b)
    assert [r.id for r in one["references"].collect()] == [c] and [r.id for r in one["cited_by"].collect()] == [a]
    assert json.loads(api.answer(library, "/documents", "unlinked=1")[1])["data"] == {"documents": [], "unlinked": True}
    started = []
    body = api.application(library)({"PATH_INFO": "/graph"}, lambda status, headers: started.append(status))
    assert started == ["200 OK"] and json.loads(body[0])["data"]["kind"] == "library"
    api.application(library)({"REQUEST_METHOD": "POST"}, lambda status, headers: started.append(status))
    assert started[1].startswith("405")


def test_arguments_of_forms():
    assert api.expansion("2", "both", "50") == {"depth": 2, "direction": "both", "max_nodes": 50}
    assert api.chosen_identifier("doi", " 10.1/a") == ("doi", " 10.1/a")
    for wrong in (lambda: api.expansion("0", "both", "50"), lambda: api.expansion("1", "both", "200"), lambda: api.chosen_identifier("mag", "1"), lambda: api.chosen_identifier("doi", " ")):
        with pytest.raises(api.InvalidParameter):
            wrong()


def test_no_tables_is_an_answer(spark, tmp_path):
    status, text = api.answer(Library(spark, str(tmp_path / "none")), "/api/graph/library")
    assert (status, json.loads(text)["error"]["type"]) == (503, "DatabaseNotInitialized")


def test_scans(library, tmp_path):
    root = tmp_path / "files"
    (root / "inner").mkdir(parents=True)
    (root / "2401.12345v2.pdf").write_bytes(b"one")
    (root / "inner" / "Paper.PDF").write_bytes(b"two")
    (root / "note.txt").write_bytes(b"x")
    (root / "link.pdf").symlink_to(root / "2401.12345v2.pdf")
    (root / "broken.pdf").symlink_to(root / "nowhere")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "2401.12345.pdf").write_bytes(b"three")
    (root / "dir").symlink_to(tmp_path / "other")
    outer, inner = library.add_source(str(root)), library.add_source(str(root / "inner") + "/")
    assert library.add_source(str(root)).id == outer.id
    with pytest.raises(errors.SourceNotADirectory):
        library.add_source(str(root / "note.txt"))
    first = library.scan()
    assert [(s.found, s.new, s.changed, s.missing) for s in first["sources"].collect()] == [(3, 3, 0, 0), (1, 0, 0, 0)]
    assert [r.status for r in first["identifications"].collect()] == ["created", "unidentified", "unidentified"]
    assert first["new_document_ids"].count() == 3 and first["changed_document_ids"].count() == 0
    assert not library.papers().where("in_library").count()
    again = library.scan()
    assert [
        (s.found, s.new, s.changed, s.reappeared, s.missing) for s in again["sources"].collect()
    ] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    (root / "inner" / "Paper.PDF").write_bytes(b"changed content")
    os.rename(root / "2401.12345v2.pdf", root / "moved.pdf")
    (root / "link.pdf").unlink()
    third = library.scan()
    assert [(s.found, s.new, s.changed, s.missing) for s in third["sources"].collect()] == [(2, 1, 1, 2), (1, 0, 0, 0)]
    (root / "2401.12345v2.pdf").write_bytes(b"one")
    assert library.scan([outer.id])["sources"].first().reappeared == 1
    assert library.scan([])["sources"].count() == 0
    with pytest.raises(errors.SourceNotFound):
        library.scan(["nobody"])
    by_name = {os.path.basename(r.path): r for r in library.documents().collect()}
    assert by_name["moved.pdf"].content_hash == files.PREFIX + "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"
    os.rename(root, tmp_path / "away")
    gone = library.scan()
    assert [(s.available, s.found, s.missing) for s in gone["sources"].collect()] == [(False, 0, 0)] * 2
    os.rename(tmp_path / "away", root)
    library.remove_source(str(inner.normalized_path))
    assert [r.id for r in library.sources().collect()] == [outer.id]

    document = by_name["2401.12345v2.pdf"]
    seen = library.inspect(document.id)
    assert seen["available"] and [
        (h.scheme, h.strong) for h in seen["hints"]
    ] == [("arxiv", True)] and len(seen["candidates"]) == 1 and seen["next_steps"] == []
    holder = seen["candidates"][0].id
    assert library.unlink(holder, document.id)
    assert library.inspect(document.id)["next_steps"] == [{"step": "link", "target": holder}]
    assert library.link(holder, document.id)
    assert library.inspect(by_name["Paper.PDF"].id)["next_steps"] == [{"step": "search", "target": None}]
    assert api.document_page(library, document.id)["importable_hints"] == []
    paper = library.create_paper(title="By hand")
    free = by_name["moved.pdf"]
    assert library.link(paper, free.id) and not library.link(paper, free.id)
    assert [r.id for r in library.documents(paper_id=paper).collect()] == [free.id]
    assert library.unlink(paper, free.id) and not library.unlink(paper, free.id)
    assert library.identify([free.id]).first().status == "unidentified"
    assert {r.status for r in library.identify().collect()} <= {"unidentified", "linked"}
    with pytest.raises(errors.DocumentNotFound):
        library.identify(["nobody"])
    with pytest.raises(errors.DocumentNotFound):
        library.inspect("nobody")


def test_imports_and_expansion(library, provider):
    created = library.import_paper(provider, [("doi", "10.1/S"), ("mag", "5")])
    assert created["status"] == "created" and [i[2] for i in created["identifiers_ignored"]] == ["5"]
    seed = created["paper_id"]
    assert library.import_paper(provider, [("openalex", "W1")])["status"] == "matched"
    with pytest.raises(errors.WorkNotFound):
        library.import_paper(provider, [("doi", "10.9/none")])
    with pytest.raises(ValueError):
        library.import_paper(provider, [])
    with pytest.raises(errors.InvalidIdentifier):
        library.import_paper(provider, [("openalex", "x")])
    out = library.expand(provider, seed, Direction.both, 1)
    # Two citing works report the same arXiv id, so the second meets the paper made for the first.
    assert (
        out["citations_created"],
        out["citations_confirmed"],
        len(out["papers_created"]),
        out["truncated"],
    ) == (4, 0, 4, False)
    again = library.expand(provider, seed, Direction.both, 1)
    assert (
        again["citations_created"],
        again["citations_confirmed"],
        again["papers_created"],
        len(again["papers_matched"]),
    ) == (0, 4, [], 4)
    assert library.expand(provider, seed, Direction.both, 2, 3)["truncated"]
    assert library.totals().library == 0
    by_title = {c["title"]: c["status"] for c in library.search(provider, " ref ", 10)}
    assert by_title == {"Ref one": "existing", "Ref two": "existing", "Ref three": "new"}
    for query, limit in (("  ", 5), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            library.search(provider, query, limit)
    bare = library.create_paper([("doi", "10.1/other")])
    with pytest.raises(errors.ProviderWorkNotFound):
        library.fetch_metadata(provider, bare)
    with pytest.raises(errors.PaperNotIdentifiable):
        library.expand(provider, library.create_paper(title="x"))
    third = library.create_paper([("openalex", "W6")], "Mine")
    got = library.fetch_metadata(provider, third)
    assert got["status"] == "updated" and (got["title_set"], got["publication_year_set"]) == (False, True)
    assert (library.paper(third).title, library.paper(third).publication_year) == ("Mine", 2010)


def test_command_line(spark, tmp_path, capsys, provider):
    db = str(tmp_path / "db")

    def call(*words, code=0, of=None):
        assert cli.main(["--db", db, *words, "--json"], spark, of) == code
        return json.loads(capsys.readouterr().out)

    assert call("paper", "list", code=1)["error"]["type"] == "DatabaseNotInitialized"
    assert call("init")["data"] == {"created": True}
    a = call("paper", "create", "--doi", "10.1/a", "--title", "A")["data"]["paper_id"]
    b = call("paper", "create", "arxiv:2401.00001")["data"]["paper_id"]
    assert call("citation", "add", a, b)["data"] == {"created": True}
    assert call("path", a, b)["data"] == {"paper_ids": [a, b], "length": 1}
    assert call("lib", "add", a)["data"] == {"changed": True}
    assert call("graph", "library")["data"]["nodes"][0]["paper"]["id"] == a
    assert call("show", "nobody", code=1)["error"]["type"] == "PaperNotFound"
    assert [r["id"] for r in call("citation", "list", a)["data"]] == [b] and len(call("paper", "list")["data"]) == 2
    assert call("citation", "list")["data"] == [{"citing": a, "cited": b}] and call("doc", "list")["data"] == []
    assert cli.main(["--db", db, "graph", "library"], spark) == 0 and "pagerank: 1.0000" in capsys.readouterr().out
    assert call("expand", a, code=2)["error"]["type"] == "ValueError"
    out = call("paper", "import", "--doi", "10.1/S", "mag:5", of=provider)
    assert out["data"]["status"] == "created" and out["warnings"] == [w for w in out["warnings"] if "mag:5" in w] != []
    seed = out["data"]["paper_id"]
    assert "budget of 2" in call("expand", seed, "--max-nodes", "2", of=provider)["warnings"][0]
    assert cli.main(["--db", db, "expand", seed, "-n", "2"], spark, provider) == 0 and "budget" in capsys.readouterr().err
    for words in (["no-such-command"], ["graph", "neighborhood", a, "--depth", "-1"], ["expand", a, "--depth", "0"]):
        with pytest.raises(SystemExit):
            cli.main(["--db", db, *words], spark)


def test_warnings():
    done = {"status": "matched", "identifiers_ignored": []}
    assert cli.warnings_of("paper import", done) == []
    assert len(cli.warnings_of("doc import", {"status": "ambiguous", "identifiers_ignored": [("doi", "X", "x")]})) == 2
    assert len(cli.warnings_of("paper import", {"status": "unconfirmed", "identifiers_ignored": []})) == 1
    assert len(cli.warnings_of("paper fetch", {"status": "conflict"})) == 1
    expanded = {"truncated": True, "seed_metadata": {"status": "unconfirmed"}}
    assert len(cli.warnings_of("expand", expanded, 20)) == 2 and "20" in cli.warnings_of("expand", expanded, 20)[0]


class Colour(Enum):
    red = "r"


def test_json(spark):
    value = {"at": datetime(2024, 1, 1, 12, tzinfo=timezone.utc), "c": Colour.red, "t": (1, None), "f": 0.5}
    assert to_json_value(value) == {"at": "2024-01-01T12:00:00+00:00", "c": "r", "t": [1, None], "f": 0.5}
    assert failure(errors.PaperNotFound("x")) == {
        "ok": False,
        "error": {"type": "PaperNotFound", "message": "paper not found: x"},
    }
    with pytest.raises(TypeError):
        to_json_value(object())
    with pytest.raises(ValueError):
        to_json_value({"at": datetime(2024, 1, 1)})
    df = spark.sql("SELECT timestamp'2024-01-01 12:00:00.5' AS at, CAST(NULL AS STRING) AS none, array(1) AS a")
    row = {"at": "2024-01-01T12:00:00.500000+00:00", "none": None, "a": [1]}
    assert json.loads(json_lines(df).first().json) == row
    for data, plain in ((df, [row]), (df.limit(0), []), ({"x": [1], "rows": df.union(df), "none": df.limit(0)}, {"x": [1], "rows": [row] * 2, "none": []})):
        out = StringIO()
        write_success(out, data, ["w"])
        assert json.loads(out.getvalue()) == {"ok": True, "data": plain, "warnings": ["w"]}
    assert json.loads(dumps(success({"a": 1}))) == {"ok": True, "data": {"a": 1}, "warnings": []}


class _Answers:
    def __init__(self, *answers):
        self.answers, self.requests = list(answers), []

    def __call__(self, request, timeout):
        self.requests.append(request)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        if isinstance(answer, tuple):
            raise urllib.error.HTTPError(request.full_url, answer[0], "x", answer[1], None)
        return BytesIO(answer)


def test_transport():
    waits = []
    busy = _Answers((429, {"Retry-After": "99"}), (503, {}), (500, {"Retry-After": "soon"}), b'{"a": 1}')
    assert http_transport("s cret", busy, waits.append)("http://x/y") == {"a": 1} and waits == [30.0, 2.0, 4.0]
    assert busy.requests[0].full_url == "http://x/y?api_key=s+cret" and busy.requests[0].get_header("Accept") == "application/json"
    assert busy.requests[0].get_header("User-agent")
    assert http_transport(None, _Answers((404, {})), waits.append)("http://x") is None
    broken = [
        _Answers((400, {})), _Answers(*[(500, {})] * 4), _Answers(b"no json"), _Answers(b"[1]"), _Answers(b"\xff"),
        _Answers(http.client.IncompleteRead(b"s cret")), _Answers(OSError("s cret")),
    ]
    for answers in broken:
        with pytest.raises(errors.ProviderError) as e:
            http_transport("s cret", answers, waits.append)("http://x?q=1")
        assert "s cret" not in str(e.value) and "s+cret" not in str(e.value) and not answers.answers


class Service:
    """A provider's web service in memory; remembers what it was asked."""

    def __init__(self, works, cited=(), page=2):
        self.works, self.cited, self.page, self.asked = works, list(cited), page, []

    def __call__(self, url):
        parts = urllib.parse.urlsplit(url)
        query = {k: v[0] for k, v in urllib.parse.parse_qs(parts.query).items()}
        self.asked.append((urllib.parse.unquote(parts.path), query))
        key = urllib.parse.unquote(parts.path).removeprefix("/works").removeprefix("/")
        if key:
            return next((w for w in self.works if key in (w.get("id"), f"doi:{w.get('doi')}")), None)
        kind, _, value = query.get("filter", "search:").partition(":")
        if kind == "openalex_id":
            return {"results": [w for w in self.works if w["id"] in value.split("|")][::-1]}
        if kind == "cites":
            start = 0 if query["cursor"] == "*" else int(query["cursor"])
            some = self.cited[start : start + self.page]
            return {"results": some, "meta": {"next_cursor": str(start + self.page) if some else None}}
        if kind == "search":
            return {"results": self.works}
        return {"results": [w for w in self.works if value in [p["landing_page_url"] for p in w.get("locations", [])]]}


def record(i, **more):
    return {"id": f"W{i}", "display_name": f"T{i}", **more}


def paged(*urls):
    return [{"landing_page_url": u} for u in urls]


def test_web_provider_looks_up_by_one_identifier_a_scheme(spark):
    two = "http://arxiv.org/abs/2401.00002"
    service = Service([
        record(1, doi="10.1/a b"), record(2, locations=paged(two)), record(3, locations=paged(two, "https://arxiv.org/abs/2401.00003")),
    ])
    provider = WebProvider(spark, "http://x/", service)
    found = lambda *keys: (w := provider.lookup_work(list(keys))) and w.work_id
    assert found(("doi", "10.9/none"), ("doi", "10.1/x"), ("openalex", "W9")) is None
    assert [p for p, _ in service.asked] == ["/works/W9", "/works/doi:10.9/none"]
    assert found(("arxiv", "2401.00003v2"), ("openalex", "bad")) == "W3" and found(("arxiv", "2401.00002")) is None
    assert [q["filter"] for _, q in service.asked[2:]] == [
        "locations.landing_page_url:http://arxiv.org/abs/2401.00003", "locations.landing_page_url:https://arxiv.org/abs/2401.00003",
        "locations.landing_page_url:http://arxiv.org/abs/2401.00002",
    ]
    assert found() is None and found(("mag", "1")) is None and found(("openalex", "w2")) == "W2"


def test_web_provider_reads_references_and_pages_of_citations(spark):
    raw = ["W2", "https://openalex.org/w2", 7, "bad", *[f"W{i}" for i in range(3, 70)]]
    service = Service(
        [record(1, referenced_works=raw), *(record(i) for i in range(2, 60))],
        [record(80), record(81), record(80), {"id": "A1"}, "no record", record(82), record(83)],
    )
    provider = WebProvider(spark, "http://x", service)
    seed = provider.lookup_work([("openalex", "W1")])
    assert [w.work_id for w in provider.fetch_references(seed, 5)] == ["W2", "W3"]
    every = provider.fetch_references(seed, 1000)
    assert [w.work_id for w in every] == [f"W{i}" for i in range(2, 70)] and (every[0].title, every[-1].title) == ("T2", None)
    batches = [len(q["filter"].split("|")) for _, q in service.asked if q.get("filter", "").startswith("openalex_id:")]
    assert batches == [2, 50, 18]
    assert [w.work_id for w in provider.fetch_citations(seed, 10)] == ["W80", "W81", "W82", "W83"]
    asked = [q for _, q in service.asked if q.get("filter") == "cites:W1"]
    assert [q["cursor"] for q in asked] == ["*", "2", "4", "6", "8"] and {q["per_page"] for q in asked} == {"10"}
    assert [w.work_id for w in provider.fetch_citations(seed, 2)] == ["W80", "W81"] and provider.fetch_citations(seed, 0) == []
    assert [w.work_id for w in provider.search_works("tea & cake", 3)] == ["W1", "W2", "W3"] and provider.search_works(" ", 3) == []
    walk = expand.walk(seed, provider.neighbours, Direction.both, 1, 8)
    # Four of the budget's seven go to references, of whose list two are W2 and two are none.
    assert [k[1] for k in walk.works] == ["W1", "W2", "W80", "W81", "W82", "W83"] and not walk.truncated
    nothing = WebProvider(spark, "http://x", lambda url: {"results": "none", "referenced_works": 5})
    assert nothing.lookup_work([("openalex", "W1")]) is None and nothing.fetch_references(seed, 5) == [] and nothing.fetch_citations(seed, 5) == []


def fake_transport(url):
    from urllib.parse import parse_qs, urlparse

    ids = parse_qs(urlparse(url).query)["filter"][0].removeprefix("openalex_id:").split("|")
    return {"results": [{"id": i, "display_name": f"Title of {i}"} for i in ids]}


def test_works_from_a_web_service(spark):
    ids = [f"W{i}" for i in range(1, 121)]
    rows = read_works(spark, "http://x", ids, "tests.test_library:fake_transport")
    assert {r.work_id: r.title for r in rows.collect()} == {i: f"Title of {i}" for i in ids}
    assert read_works(spark, "http://x", []).count() == 0


def test_streaming(spark, tmp_path):
    from quillgraph.streaming.scans import ANNOUNCED, ROWS, citation_counts, scan_stream

    library = Library(spark, str(tmp_path / "db"))
    library.initialize()
    library.add_source(str(tmp_path))
    folder = str(tmp_path / "announced")
    one = spark.createDataFrame(
        [(f"{tmp_path}/a.pdf", 1, 1, True, "sha256:a"), (f"{tmp_path}/b.pdf", 1, 1, True, "sha256:b")],
        ROWS,
    )
    announce = lambda path, day: spark.createDataFrame([(path, datetime(2024, 1, day))], ANNOUNCED).write.mode("append").parquet(folder)
    listed = lambda name: str(tmp_path / "listings" / name)
    # A listing in several files, as any number of tasks write it.
    many = one.unionByName(spark.createDataFrame([(f"{tmp_path}/{i}.pdf", 1, 1, True, f"sha256:{i}") for i in range(4)], ROWS))
    many.repartition(4).write.parquet(listed("one"))
    announce(listed("one"), 1)
    seen = []
    run = lambda: scan_stream(
        spark,
        library.catalog,
        folder,
        str(tmp_path / "state"),
        lambda n,
        s: seen.append(s),
    ).awaitTermination(120)
    run()
    many.where("normalized_path NOT LIKE '%b.pdf'").repartition(3).write.parquet(listed("two"))
    many.write.parquet(listed("three"))  # not announced, so not complete
    announce(listed("two"), 2)
    run()
    assert seen == [{"new": 6}, {"same": 5, "missing": 1}]
    assert {
        (r.content_hash, r.missing_since is None) for r in library.documents().collect() if r.content_hash > "sha256:a"
    } == {("sha256:b", False)}

    spark.createDataFrame(
        [
            ("a", "x", datetime(2024, 1, 2)),
            ("a", "x", datetime(2024, 1, 2, 5)),
            ("b", "x", datetime(2024, 1, 3)),
            ("x", "x", datetime(2024, 1, 3)),
        ],
        "citing_paper_id string, cited_paper_id string, created_at timestamp",
    ).write.parquet(str(tmp_path / "c"))
    stream = citation_counts(
        spark.readStream.schema(
            "citing_paper_id string, cited_paper_id string, created_at timestamp",
        ).parquet(str(tmp_path / "c")),
    )
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.cited_paper_id, r.citations) for r in spark.table("counts").collect()] == [("x", 2)]


def test_plans(spark, tmp_path):
    rows = [("a", "b", datetime(2024, 1, 1)), ("c", "b", datetime(2024, 1, 2))]
    spark.createDataFrame(
        [(str(i), *r) for i, r in enumerate(rows)],
        "id string, citing_paper_id string, cited_paper_id string, created_at timestamp",
    ).write.parquet(str(tmp_path / "citation"))
    from quillgraph.operators.heavy_keys import most_cited

    df = most_cited(spark.read.parquet(str(tmp_path / "citation")))
    found = operators(df)
    assert not found["CartesianProduct"] and not found["BroadcastNestedLoopJoin"] and not found["BatchEvalPython"]
    assert all(columns <= {"citing_paper_id", "cited_paper_id"} for columns in scanned_columns(df))  # no id, no time
    assert any("IsNotNull(cited_paper_id)" in f for f in pushed_filters(df))


def test_the_core_does_not_need_the_folder_for_training_data():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    code = "import sys; sys.modules['quillgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and not any(n[:2] in ('p1', 'p8') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    inside = [p for p in (root / "quillgraph").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in inside if "quillgraph.llm" in p.read_text()]


def test_listing_helpers(spark, tmp_path):
    assert files.hash_file(str(tmp_path / "none.pdf")) is None
    assert files.normalize_local_path("~/a/../b") == os.path.join(os.path.expanduser("~"), "b")
    frame = files.hash_documents(spark.createDataFrame([(str(tmp_path / "none.pdf"),)], "normalized_path string"))
    assert frame.where(F.col("content_hash").isNull()).count() == 1
