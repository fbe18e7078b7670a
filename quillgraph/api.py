"""Graphs and page contents over HTTP: a status and a result per address, and a small WSGI server.

Arguments are checked against whitelists before anything is read. Graphs are answered as the envelopes
of the command line; the queries behind the pages give DataFrames and rows for any template.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable
from typing import Any
from urllib.parse import parse_qs

from pyspark.sql import functions as F

from quillgraph import errors as E
from quillgraph.library import Library
from quillgraph.operators import documents
from quillgraph.schema import Direction
from quillgraph.serialize import dumps, failure, write_success

# What a graph's address and the forms of the pages may ask for.
API_DEPTHS, PAGE_DEPTHS = (0, 1, 2), (1, 2)
BUDGETS = (20, 50, 100)
SCHEMES = ("doi", "arxiv", "openalex")
_ID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


class InvalidParameter(E.LibraryError):
    """An argument that is not on its list."""


def status_of(error: Exception) -> int:
    if isinstance(error, (E.PaperNotFound, E.DocumentNotFound, E.SourceNotFound)):
        return 404
    return 503 if isinstance(error, (E.DatabaseNotInitialized, E.DatabaseMigrationFailed)) else 400


def one_of(name: str, raw: str, allowed: Iterable[Any]) -> Any:
    """The allowed value that is written as ``raw``; whole numbers may be written in any usual way."""
    for value in allowed:
        if isinstance(value, int):
            if re.fullmatch(r"\s*[+-]?\d+\s*", raw) and int(raw) == value:
                return value
        elif str(value) == raw:
            return value
    raise InvalidParameter(f"{name} must be one of {', '.join(str(v) for v in allowed)}")


def library_graph(library: Library) -> dict:
    return library.library_graph()


def neighborhood_graph(library: Library, paper_id: str, depth: str = "1", direction: str = "both", depths=API_DEPTHS) -> dict:
    return library.neighborhood(paper_id, one_of("depth", depth, depths), one_of("direction", direction, list(Direction)))


def expansion(depth: str, direction: str, max_nodes: str) -> dict:
    """The arguments of an expansion as a form gives them."""
    return {
        "depth": one_of("depth", depth, PAGE_DEPTHS),
        "direction": one_of("direction", direction, list(Direction)),
        "max_nodes": one_of("max_nodes", max_nodes, BUDGETS),
    }


def chosen_identifier(scheme: str, value: str) -> tuple[str, str]:
    """The identifier to import as a form gives it."""
    if not value.strip():
        raise InvalidParameter("value must not be blank")
    return one_of("scheme", scheme, SCHEMES), value


# --- pages ----------------------------------------------------------------------------------------


def dashboard(library: Library) -> dict:
    return {"totals": library.totals(), "most_cited": library.most_cited()}


def papers_page(library: Library) -> dict:
    """All papers, each with how many papers it cites and how many cite it."""
    counts = library.counts().select("id", F.col("out_degree").alias("references"), F.col("in_degree").alias("citations"))
    return {"papers": library.papers().join(counts, "id").orderBy("created_at", "id")}


def paper_page(library: Library, paper_id: str) -> dict:
    return {
        "paper": library.paper(paper_id),
        "references": library.citations_of(paper_id, Direction.references),
        "cited_by": library.citations_of(paper_id, Direction.citations),
        "documents": library.documents(paper_id),
    }


def documents_page(library: Library, unlinked: str = "") -> dict:
    """Copies with the label of their paper; those without a paper alone where ``unlinked`` is 1."""
    return {"documents": library.labelled_documents(unlinked == "1"), "unlinked": unlinked == "1"}


def document_page(library: Library, document_id: str) -> dict:
    seen = library.inspect(document_id)
    linked = seen["document"].paper_id
    able = [h for h in seen["hints"] if h.paper_id is None and h.scheme in documents.ASKABLE]
    return {**seen, "linked_paper": library.paper(linked) if linked else None, "importable_hints": able}


def paper_graph_page(library: Library, paper_id: str, depth: str = "1", direction: str = "both") -> dict:
    return neighborhood_graph(library, paper_id, depth, direction, PAGE_DEPTHS)


#: Addresses, the arguments they take from the query, and what answers them.
ROUTES: list[tuple[str, tuple[str, ...], Callable[..., dict]]] = [
    (r"/api/graph/library", (), library_graph),
    (rf"/api/graph/neighborhood/({_ID})", ("depth", "direction"), neighborhood_graph),
    (r"/", (), dashboard),
    (r"/papers", (), papers_page),
    (rf"/papers/({_ID})", (), paper_page),
    (rf"/papers/({_ID})/graph", ("depth", "direction"), paper_graph_page),
    (r"/graph", (), library_graph),
    (r"/documents", ("unlinked",), documents_page),
    (rf"/documents/({_ID})", (), document_page),
]


def answer(library: Library, path: str, query: str = "") -> tuple[int, str]:
    """(status, JSON) of an address."""
    given = {k: v[0] for k, v in parse_qs(query, keep_blank_values=True).items()}
    for shape, takes, page in ROUTES:
        if found := re.fullmatch(shape, path):
            try:
                result = page(library, *(g.lower() for g in found.groups()), **{k: given[k] for k in takes if k in given})
                out = io.StringIO()
                write_success(out, result)
                return 200, out.getvalue()
            except (E.LibraryError, ValueError) as e:
                return status_of(e), dumps(failure(e))
    return 404, dumps({"ok": False, "error": {"type": "NotFound", "message": f"no such address: {path}"}})


def application(library: Library) -> Callable:
    """The addresses as a WSGI application, for reading only."""

    def app(environ: dict, start_response: Callable) -> list[bytes]:
        if environ.get("REQUEST_METHOD", "GET") not in ("GET", "HEAD"):
            error = {"type": "MethodNotAllowed", "message": "addresses are for reading only"}
            status, text = 405, dumps({"ok": False, "error": error})
        else:
            status, text = answer(library, environ.get("PATH_INFO", "/"), environ.get("QUERY_STRING", ""))
        reasons = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 503: "Service Unavailable"}
        start_response(f"{status} {reasons[status]}", [("Content-Type", "application/json; charset=utf-8")])
        return [text.encode()]

    return app


def serve(library: Library, host: str = "127.0.0.1", port: int = 8000) -> None:
    """For local use only."""
    from wsgiref.simple_server import make_server

    with make_server(host, port, application(library)) as server:
        server.serve_forever()
