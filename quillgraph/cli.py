"""Command line: ``python -m quillgraph --db FOLDER COMMAND ...``.

Every command is one use case and its output, as text or, with ``--json``, as an envelope. A failed
use case exits with 1, wrong usage with 2. Warnings are part of the envelope, or go to standard error.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row

from quillgraph.errors import LibraryError
from quillgraph.library import Library
from quillgraph.operators import works as W
from quillgraph.schema import Direction, ImportStatus, MetadataStatus
from quillgraph.serialize import dumps, failure, to_json_value, write_success
from quillgraph.session import local_session, ship
from quillgraph.sources.provider import Provider, TableProvider, WebProvider, http_transport

SCHEMES = ("doi", "arxiv", "openalex")


def default_folder() -> str:
    """The stored tables' place: QUILLGRAPH_DB, else the user's data folder."""
    data = os.environ.get("XDG_DATA_HOME") or str(Path.home() / ".local/share")
    return os.environ.get("QUILLGRAPH_DB") or str(Path(data) / "quillgraph")


def _pair(text: str) -> tuple[str, str]:
    scheme, found, value = text.partition(":")
    if not found:
        raise argparse.ArgumentTypeError("an identifier is SCHEME:VALUE")
    return scheme, value


def _least(bound: int):
    def number(text: str) -> int:
        value = int(text)
        if value < bound:
            raise argparse.ArgumentTypeError(f"must be at least {bound}")
        return value

    return number


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgraph", description=__doc__.splitlines()[0])
    top.add_argument("--db", default=None, help="folder of the stored tables")
    top.add_argument("--works", default=None, help="Parquet folder of a provider's records (column payload)")
    top.add_argument("--service", default=None, help="base URL of a provider's web service; QUILLGRAPH_KEY is its key")
    top.add_argument("--json", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    groups: dict[str, argparse._SubParsersAction] = {}

    def add(name: str, *arguments: tuple) -> None:
        """A command, or one of a group: ``paper list``."""
        group, _, own = name.rpartition(" ")
        if group and group not in groups:
            groups[group] = commands.add_parser(group).add_subparsers(dest="action", required=True)
        p = (groups[group] if group else commands).add_parser(own)
        p.set_defaults(name=name)
        p.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
        for names, options in arguments:
            p.add_argument(*names, **options)

    paper, target, document = (("paper_id",), {}), (("target_id",), {}), (("document_id",), {})
    way = (("--direction",), {"choices": [d.value for d in Direction], "default": "both"})
    depth = lambda least: (("--depth", "-d"), {"type": _least(least), "default": 1})
    keys = [(("identifiers",), {"nargs": "*", "type": _pair, "metavar": "SCHEME:VALUE"})]
    keys += [((f"--{s}",), {"action": "append", "default": []}) for s in SCHEMES]
    add("init")
    add("show", paper)
    add("search", (("query",), {}), (("--limit",), {"type": int, "default": 10}))
    add("paper create", *keys, (("--title",), {}))
    add("paper import", *keys)
    add("paper fetch", paper)
    add("paper list")
    add("lib add", paper)
    add("lib remove", paper)
    add("citation add", paper, target)
    add("citation list", (("paper_id",), {"nargs": "?"}), (("--direction",), {"choices": ["references", "citations"], "default": "references"}))
    add("graph neighborhood", paper, depth(0), way)
    add("graph library")
    add("path", paper, target)
    add("src add", (("path",), {}))
    add("src list")
    add("src remove", (("source",), {}))
    add("scan", (("--source",), {"action": "append"}))
    add("doc list", (("--paper",), {}), (("--unlinked",), {"action": "store_true"}))
    add("doc show", document)
    add("doc link", document, paper)
    add("doc unlink", document, paper)
    add("doc import", document, *keys)
    add("doc identify", (("document_id",), {"nargs": "*"}))
    add("expand", paper, way, depth(1), (("--max-nodes", "-n"), {"type": _least(1), "default": 200}))
    add("serve", (("--host",), {"default": "127.0.0.1"}), (("--port",), {"type": int, "default": 8000}))
    return top


def _keys(a: argparse.Namespace) -> list[tuple[str, str]]:
    return [*a.identifiers, *((s, v) for s in SCHEMES for v in getattr(a, s))]


def run(library: Library, a: argparse.Namespace, provider: Provider | None) -> object:
    """The result of a command, as rows or plain values."""
    match a.name:
        case "init":
            return {"created": library.initialize()}
        case "show":
            return library.paper(a.paper_id)
        case "search":
            return library.search(provider, a.query, a.limit)
        case "paper create":
            return {"paper_id": library.create_paper(_keys(a), a.title)}
        case "paper import":
            return library.import_paper(provider, _keys(a))
        case "paper fetch":
            return library.fetch_metadata(provider, a.paper_id)
        case "paper list":
            return library.papers()
        case "lib add":
            return {"changed": library.add_to_library(a.paper_id)}
        case "lib remove":
            return {"changed": library.remove_from_library(a.paper_id)}
        case "citation add":
            return {"created": library.add_citation(a.paper_id, a.target_id)}
        case "citation list":
            return library.citations_of(a.paper_id, Direction(a.direction)) if a.paper_id else library.all_citations()
        case "graph neighborhood":
            return library.neighborhood(a.paper_id, a.depth, Direction(a.direction))
        case "graph library":
            return library.library_graph()
        case "path":
            ids = library.path(a.paper_id, a.target_id)
            return {"paper_ids": ids, "length": len(ids) - 1}
        case "src add":
            return library.add_source(a.path)
        case "src list":
            return library.sources()
        case "src remove":
            library.remove_source(a.source)
            return {"removed": a.source}
        case "scan":
            return library.scan(a.source)
        case "doc list":
            return library.documents(a.paper, a.unlinked)
        case "doc show":
            return library.inspect(a.document_id)
        case "doc link":
            return {"changed": library.link(a.paper_id, a.document_id)}
        case "doc unlink":
            return {"changed": library.unlink(a.paper_id, a.document_id)}
        case "doc import":
            return library.import_paper(provider, _keys(a), a.document_id)
        case "doc identify":
            return library.identify(a.document_id or None)
        case "expand":
            return library.expand(provider, a.paper_id, Direction(a.direction), a.depth, a.max_nodes)
    raise ValueError(a.name)


def warnings_of(name: str, result: object, max_nodes: int = 0) -> list[str]:
    """What a result leaves open, in words."""
    if not isinstance(result, dict):
        return []
    out = []
    if name in ("paper import", "doc import"):
        if result["status"] == ImportStatus.ambiguous:
            out.append("the work's identifiers belong to several papers; nothing was stored")
        if result["status"] == ImportStatus.unconfirmed:
            out.append("the provider's work has none of the given identifiers; nothing was stored")
        if result["identifiers_ignored"]:
            ignored = " ".join(f"{scheme}:{normal}" for scheme, _, normal in result["identifiers_ignored"])
            out.append(f"the provider's work does not have these identifiers, which were left out: {ignored}")
    if name == "expand" and result["truncated"]:
        out.append(f"the budget of {max_nodes} works was used up; a larger one may find more")
    about = result["seed_metadata"] if name == "expand" else result if name == "paper fetch" else {}
    if about.get("status") == MetadataStatus.unconfirmed:
        out.append("the provider's work has no identifier of the paper; nothing was stored")
    if about.get("status") == MetadataStatus.conflict:
        out.append("identifiers of the provider's work belong to another paper; nothing was stored")
    return out


def _lines(value: object, indent: str = "") -> Iterator[str]:
    """Text for a person, line by line; a DataFrame is read a partition at a time."""
    if isinstance(value, DataFrame):
        for row in value.toLocalIterator():
            yield from _lines(to_json_value(row), indent + "  ")
            yield ""
    elif isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, DataFrame) or isinstance(v, (dict, list)) and v:
                yield f"{indent}{k}:"
                yield from _lines(v, indent + "  ")
            else:
                yield f"{indent}{k}: {_plain(v)}"
    elif isinstance(value, list):
        for v in value:
            if isinstance(v, dict):
                yield from _lines(v, indent + "  ")
                yield ""
            else:
                yield f"{indent}- {_plain(v)}"
    else:
        yield f"{indent}{_plain(value)}"


def _plain(value: object) -> str:
    return "-" if value is None or value == [] else f"{value:.4f}" if isinstance(value, float) else str(value)


def _readable(result: object) -> object:
    """A result whose values are plain, DataFrames aside."""
    if isinstance(result, dict):
        return {k: v if isinstance(v, DataFrame) else to_json_value(v) for k, v in result.items()}
    return result if isinstance(result, DataFrame) else to_json_value(result)


def main(arguments: list[str] | None = None, spark=None, provider: Provider | None = None) -> int:
    a = parser().parse_args(arguments)
    session = spark or local_session("*", app="quillgraph")
    ship(session)
    try:
        library = Library(session, a.db or default_folder())
        if a.works:
            provider = TableProvider(W.parse_works(session.read.parquet(a.works)))
        elif a.service:
            provider = WebProvider(session, a.service, http_transport(os.environ.get("QUILLGRAPH_KEY") or None))
        if provider is None and a.name in ("search", "paper import", "paper fetch", "doc import", "expand"):
            raise ValueError(f"{a.name} needs --works or --service")
        if a.name == "serve":
            from quillgraph.api import serve

            library.totals()  # fails at once where there are no tables
            serve(library, a.host, a.port)
            return 0
        result = run(library, a, provider)
        warnings = warnings_of(a.name, result, getattr(a, "max_nodes", 0))
    except (LibraryError, ValueError) as e:
        print(dumps(failure(e)) if a.json else f"{type(e).__name__}: {e}", file=sys.stdout if a.json else sys.stderr)
        return 2 if isinstance(e, ValueError) and not isinstance(e, LibraryError) else 1
    if a.json:
        write_success(sys.stdout, result, warnings)
    else:
        for warning in warnings:
            print(f"warning: {warning}", file=sys.stderr)
        for line in _lines(_readable(result)):
            print(line)
    return 0
