"""The use cases: a library of papers in a catalog of stored tables.

Each writing use case reads one snapshot, computes the changed tables, or rows that are added, and makes
them current at once. What may be large, a graph or what a scan found, is given as DataFrames.
Finding something never makes it a member of the Library; only ``add_to_library`` does.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillgraph import errors as E
from quillgraph.functions import hints as H
from quillgraph.functions.normalize import clean_title
from quillgraph.operators import documents, expand, graph, identity, papers, scan
from quillgraph.schema import CITATION, PAPER, PAPER_IDENTIFIER, SCAN_SOURCE, CandidateStatus, Direction, ImportStatus, MetadataStatus
from quillgraph.session import cut
from quillgraph.sources import files, pdf
from quillgraph.sources.catalog import Catalog

IDENTIFIERS = "array<struct<scheme:string,value:string>>"
Pairs = list[tuple[str, str]]


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _new_id() -> str:
    return str(uuid.uuid4())


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)

    def initialize(self) -> bool:
        return self.catalog.initialize()

    # --- reading --------------------------------------------------------------------------------

    def _t(self) -> dict[str, DataFrame]:
        return self.catalog.tables()

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _require_paper(self, tables: dict[str, DataFrame], *ids: str) -> None:
        known = {r.id for r in tables["paper"].where(F.col("id").isin(*ids)).select("id").collect()}
        for i in ids:
            if i not in known:
                raise E.PaperNotFound(i)

    def _edges(self, tables: dict[str, DataFrame]) -> DataFrame:
        return graph.stored_edges(tables["citation"], tables["paper"])

    def papers(self) -> DataFrame:
        """All papers with identifiers, by time of creation, then id."""
        t = self._t()
        return papers.paper_records(t["paper"], t["paper_identifier"]).orderBy("created_at", "id")

    def paper(self, paper_id: str) -> Row:
        t = self._t()
        found = papers.paper_records(t["paper"], t["paper_identifier"], self._ids(paper_id)).collect()
        if not found:
            raise E.PaperNotFound(paper_id)
        return found[0]

    def totals(self) -> Row:
        t = self._t()
        return papers.totals(t["paper"], self._edges(t)).first()

    def counts(self) -> DataFrame:
        """(id, in_degree, out_degree) of every paper, over all citations."""
        t = self._t()
        return papers.degrees(self._edges(t), t["paper"])

    def most_cited(self, count: int = 5) -> DataFrame:
        return papers.most_cited(self._edges(self._t()), count)

    def citations_of(self, paper_id: str, direction: Direction) -> DataFrame:
        t = self._t()
        self._require_paper(t, paper_id)
        side = graph.references if direction == Direction.references else graph.cited_by
        found = side(t["citation"], t["paper"], self._ids(paper_id))
        return papers.paper_records(t["paper"], t["paper_identifier"], found.select("id")).orderBy("created_at", "id")

    def all_citations(self) -> DataFrame:
        return self._edges(self._t()).orderBy("citing", "cited")

    def path(self, source: str, target: str) -> list[str]:
        """Ids of a shortest way along citations; equal ends give the one paper."""
        t = self._t()
        self._require_paper(t, source, target)
        edges = graph.raw_edges(t["citation"])
        rows = graph.shortest_path(edges, self._ids(source), F.lit(target), t["paper"]).collect()
        if not rows:
            raise E.CitationPathNotFound(f"no citation path from {source} to {target}")
        return list(rows[0].path)

    def neighborhood(self, paper_id: str, depth: int = 1, direction: Direction = Direction.both) -> dict:
        if depth < 0:
            raise ValueError("depth must not be negative")
        t = self._t()
        self._require_paper(t, paper_id)
        way = Direction(direction)
        edges = graph.raw_edges(t["citation"])
        sub = graph.neighborhood(t["paper"], edges, self._ids(paper_id), depth, way, raw=True)
        return self._graph("neighborhood", t, sub, seed=paper_id, depth=depth, direction=way.value)

    def library_graph(self) -> dict:
        t = self._t()
        return self._graph(
            "library",
            t,
            graph.library_graph(t["paper"], graph.raw_edges(t["citation"])),
            seed=None,
            depth=None,
            direction=None,
        )

    def _graph(self, kind: str, t: dict[str, DataFrame], sub: graph.Subgraph, **about: object) -> dict:
        """A graph whose ``nodes`` and ``edges`` are DataFrames in their order."""
        records = papers.paper_records(t["paper"], t["paper_identifier"], sub.selected.select("id"))
        paper = records.select("id", F.struct(*records.columns).alias("paper"))
        # Nodes are ranked once, and sorted last, so that what is read from them comes in order.
        nodes = cut(sub.nodes()).join(paper, "id").orderBy(F.asc_nulls_first("distance"), "created_at", "id")
        edges = sub.ordered_edges().select(F.col("citing").alias("citing_paper_id"), F.col("cited").alias("cited_paper_id"))
        return {
            "kind": kind,
            "seed_paper_id": about.pop("seed"),
            **about,
            "nodes": nodes.select("paper", "distance", "in_degree", "out_degree", "pagerank"),
            "edges": edges,
        }

    # --- papers ---------------------------------------------------------------------------------

    def _normalized(self, pairs: Pairs) -> list[Row]:
        """Strict: an invalid identifier is an error."""
        row = self.spark.createDataFrame([(pairs,)], f"i {IDENTIFIERS}")
        bad, good = row.select(
            identity.invalid_identifiers(F.col("i")),
            identity.normalized_identifiers(F.col("i")),
        ).first()
        if bad:
            raise E.InvalidIdentifier(bad[0].scheme, bad[0].value)
        return good

    def _holders(self, t: dict[str, DataFrame], keys: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
        if not keys:
            return {}
        asked = self.spark.createDataFrame(keys, "scheme string, normalized_value string").distinct()
        held = identity.holders(t["paper_identifier"]).join(
            F.broadcast(asked),
            ["scheme", "normalized_value"],
        )  # as many as were given
        return {(r.scheme, r.normalized_value): r.paper_id for r in held.orderBy(F.desc("paper_id")).collect()}

    def create_paper(self, identifiers: Pairs = (), title: str | None = None) -> str:
        at, t = self.catalog.pointer(), self._t()
        keys = self._normalized(list(identifiers)) if identifiers else []
        held = self._holders(t, [(k.scheme, k.normalized_value) for k in keys])
        if held:
            raise E.IdentifierConflict([(s, v, p) for (s, v), p in held.items()])
        paper_id = _new_id()
        new = [(paper_id, k.scheme, k.value, k.normalized_value) for k in keys]
        self.catalog.commit({}, at, self._new_rows([(paper_id, title, None)], new))
        return paper_id

    def _new_rows(self, new: list[tuple], keys: list[tuple]) -> dict[str, DataFrame]:
        """Rows of new papers (id, title, year) and of identifiers (paper, scheme, value, normal form)."""
        now, out = _now(), {}
        if new:
            rows = self.spark.createDataFrame([(i, title, year, now, None) for i, title, year in new], PAPER)
            out["paper"] = rows.withColumn("title", clean_title(F.col("title")))
        if keys:
            out["paper_identifier"] = self.spark.createDataFrame([(_new_id(), *k) for k in keys], PAPER_IDENTIFIER)
        return out

    def _filled(self, paper: DataFrame, fills: dict[str, tuple[str | None, int | None]]) -> DataFrame:
        """Papers whose missing titles and years are filled; what is there stays."""
        new = self.spark.createDataFrame(
            [(i, t, y) for i, (t, y) in fills.items()],
            "id string, _title string, _year int",
        )
        joined = paper.join(F.broadcast(new), "id", "left")  # as many as a use case touches
        joined = joined.withColumn("title", F.coalesce("title", clean_title(F.col("_title"))))
        return joined.withColumn("publication_year", F.coalesce("publication_year", "_year")).select(paper.columns)

    def _member(self, paper_id: str, member: bool) -> bool:
        at, t = self.catalog.pointer(), self._t()
        self._require_paper(t, paper_id)
        is_member = t["paper"].where((F.col("id") == paper_id) & papers.in_library()).limit(1).count() > 0
        if is_member == member:
            return False
        value = F.lit(_now()) if member else F.lit(None)
        changed = t["paper"].withColumn(
            "library_added_at",
            F.when(F.col("id") == paper_id, value).otherwise(F.col("library_added_at")),
        )
        self.catalog.commit({"paper": changed}, at)
        return True

    def add_to_library(self, paper_id: str) -> bool:
        return self._member(paper_id, True)

    def remove_from_library(self, paper_id: str) -> bool:
        return self._member(paper_id, False)

    # --- citations ------------------------------------------------------------------------------

    def _citation_rows(self, edges: list[tuple[str, str]]) -> DataFrame:
        now = _now()
        return self.spark.createDataFrame([(_new_id(), a, b, now) for a, b in edges], CITATION)

    def add_citation(self, citing: str, cited: str) -> bool:
        """Whether the citation is new."""
        if citing == cited:
            raise E.SelfCitation(f"paper {citing} cannot cite itself")
        at, t = self.catalog.pointer(), self._t()
        self._require_paper(t, citing, cited)
        if self._known(t, [(citing, cited)]):
            return False
        self.catalog.commit({}, at, {"citation": self._citation_rows([(citing, cited)])})
        return True

    def _known(self, t: dict[str, DataFrame], edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
        """Those of a use case's edges that are stored: they are looked for in the rows as scanned."""
        asked = self.spark.createDataFrame(edges, "citing string, cited string")
        rows = graph.raw_edges(t["citation"]).join(F.broadcast(asked), ["citing", "cited"], "left_semi")
        return {(r.citing, r.cited) for r in rows.distinct().collect()}  # at most those asked for

    # --- sources and scans ----------------------------------------------------------------------

    def sources(self) -> DataFrame:
        return self._t()["scan_source"].orderBy("normalized_path")

    def add_source(self, path: str) -> Row:
        at, t = self.catalog.pointer(), self._t()
        normal = files.normalize_local_path(path)
        known = t["scan_source"].where(F.col("normalized_path") == normal).first()
        if known:
            return known
        if not os.path.isdir(normal):
            raise E.SourceNotADirectory(normal)
        row = self.spark.createDataFrame([(_new_id(), path, normal, _now(), None)], SCAN_SOURCE)
        self.catalog.commit({}, at, {"scan_source": row})
        return row.first()

    def remove_source(self, id_or_path: str) -> None:
        at, t = self.catalog.pointer(), self._t()
        own = (F.col("id") == id_or_path) | (F.col("normalized_path") == files.normalize_local_path(id_or_path))
        if not t["scan_source"].where(own).limit(1).count():
            raise E.SourceNotFound(id_or_path)
        self.catalog.commit({"scan_source": t["scan_source"].where(~own)}, at)

    def scan(self, source_ids: list[str] | None = None) -> dict:
        """Compare sources with what is stored, and identify new and changed documents. None means all
        sources; an empty list none."""
        at, t = self.catalog.pointer(), self._t()
        chosen = t["scan_source"] if source_ids is None else t["scan_source"].where(F.col("id").isin(*source_ids)) if source_ids else t["scan_source"].limit(0)
        chosen = cut(files.availability(chosen))
        rows = chosen.collect()
        for i in source_ids or []:
            if i not in {r.id for r in rows}:
                raise E.SourceNotFound(i)
        listing = cut(files.list_documents(self.spark, [r.normalized_path for r in rows if r.available]))
        diff = cut(scan.scan_diff(listing, t["document_copy"], chosen))
        hashes = cut(files.hash_documents(diff.where(F.col("state").isin("new", "changed")).select("normalized_path")))
        # A file that cannot be hashed was seen, but nothing about it is known or counted.
        unread = hashes.where("content_hash IS NULL").select("normalized_path", F.lit(True).alias("_unread"))
        diff = diff.join(unread, "normalized_path", "left").withColumn(
            "state",
            F.when(F.col("_unread"), "unreadable").otherwise(F.col("state")),
        )
        diff = cut(diff.withColumn("reappeared", F.col("reappeared") & F.col("_unread").isNull()).drop("_unread"))
        now = F.lit(_now())
        copies = cut(scan.apply_scan(t["document_copy"].distinct(), diff, hashes, now))
        counters = cut(scan.scan_counters(listing, diff, chosen)).orderBy("normalized_path")
        stamped = t["scan_source"].join(
            chosen.where("available").select("id", F.lit(True).alias("_scanned")),
            "id",
            "left",
        )
        sources = stamped.withColumn(
            "last_scanned_at",
            F.when(F.col("_scanned"), now).otherwise(F.col("last_scanned_at")),
        ).drop("_scanned")
        touched = diff.where(F.col("state").isin("new", "changed")).select("normalized_path", "state")
        found = cut(
            copies.join(touched, "normalized_path").select(
                F.col("id").alias("document_id"),
                "normalized_path",
                "state",
            ),
        )
        order = F.struct(F.when(F.col("state") == "new", 0).otherwise(1), "normalized_path")
        changed, added, identified = self._identified(t, copies, found.withColumn("order", order))
        self.catalog.commit({"scan_source": sources, **changed}, at, added)
        of = lambda state: found.where(F.col("state") == state).orderBy("normalized_path").select("document_id")
        return {
            "sources": counters,
            "new_document_ids": of("new"),
            "changed_document_ids": of("changed"),
            "identifications": identified,
        }

    # --- documents ------------------------------------------------------------------------------

    def documents(self, paper_id: str | None = None, unlinked_only: bool = False) -> DataFrame:
        t = self._t()
        if paper_id is not None:
            self._require_paper(t, paper_id)
        return documents.documents(t["document_copy"], paper_id, unlinked_only)

    def labelled_documents(self, unlinked_only: bool = False) -> DataFrame:
        """Copies with the label of their paper, in the order of paths."""
        t = self._t()
        rows = t["document_copy"].where("paper_id IS NULL") if unlinked_only else t["document_copy"]
        return documents.with_paper_labels(rows, t["paper"], t["paper_identifier"]).orderBy("normalized_path", "id")

    def _document(self, t: dict[str, DataFrame], document_id: str) -> Row:
        row = t["document_copy"].where(F.col("id") == document_id).first()
        if row is None:
            raise E.DocumentNotFound(document_id)
        return row

    def _hints(self, paths: DataFrame) -> DataFrame:
        """(normalized_path, hints) of files."""
        read = cut(H.with_xmp_values(pdf.read_documents(paths)).withColumn("matches", H.located(F.col("page1_text"))))
        return read.select(
            "normalized_path",
            H.document_hints(
                F.col("normalized_path"),
                F.col("info"),
                F.col("xmp_values"),
                F.col("matches"),
            ).alias("hints"),
        )

    def _identified(
        self,
        t: dict[str, DataFrame],
        copies: DataFrame,
        wanted: DataFrame,
    ) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
        """The tables that change, and rows that are added, by identifying the documents of ``wanted``
        (document_id, normalized_path, order) that are present and not linked, and what came of each."""
        free = copies.where("paper_id IS NULL AND missing_since IS NULL").select(F.col("id").alias("document_id"))
        wanted = cut(wanted.join(free, "document_id", "left_semi"))
        selected = wanted.join(self._hints(wanted), "normalized_path").select(
            "document_id",
            "order",
            H.select_identifiers(F.col("hints")).alias("identifiers"),
        )
        outcome = cut(documents.identify(selected, t["paper_identifier"]))
        links = outcome.where("paper_id IS NOT NULL").select("document_id", "paper_id")
        made = outcome.where("status = 'created'").select("paper_id", F.explode("identifiers").alias("i"))
        now = F.lit(_now())
        paper = made.select(
            F.col("paper_id").alias("id"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("int").alias("publication_year"),
            now.alias("created_at"),
            F.lit(None).cast("timestamp").alias("library_added_at"),
        )
        key = F.regexp_replace(
            F.md5(F.concat_ws(":", F.lit("identifier"), "i.scheme", "i.normalized_value")),
            r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z",
            "$1-$2-$3-$4-$5",
        )
        held = made.select(key.alias("id"), "paper_id", "i.scheme", "i.value", "i.normalized_value")
        changed = {"document_copy": documents.linked(copies, links)}
        order = wanted.select("document_id", "normalized_path", "order")
        shown = outcome.join(order, "document_id").orderBy("order").drop("order")
        return changed, {"paper": paper, "paper_identifier": held}, shown

    def identify(self, document_ids: list[str] | None = None) -> DataFrame:
        """Identify documents in the given order, or, without any, all in the order of paths."""
        at, t = self.catalog.pointer(), self._t()
        copies = t["document_copy"].select(F.col("id").alias("document_id"), "normalized_path")
        if document_ids is None:
            wanted = copies.withColumn("order", F.col("normalized_path"))
        else:
            place = self.spark.createDataFrame(list(enumerate(document_ids)), "order int, document_id string")
            wanted = cut(copies.join(F.broadcast(place), "document_id"))  # as many as were given
            known = {r.document_id for r in wanted.select("document_id").collect()}
            for i in document_ids:
                if i not in known:
                    raise E.DocumentNotFound(i)
        changed, added, out = self._identified(t, t["document_copy"], wanted)
        self.catalog.commit(changed, at, added)
        return out

    def inspect(self, document_id: str) -> dict:
        """What is known to resolve one document, without writing anything."""
        t = self._t()
        document = self._document(t, document_id)
        if document.missing_since is not None or not os.path.isfile(document.path):
            nothing = {"available": False, "hints": [], "assessment": None, "candidates": []}
            return {"document": document, **nothing, "next_steps": self._next_steps(document, [], [])}
        path = self.spark.createDataFrame([(document.path,)], "normalized_path string")
        found = cut(self._hints(path).select(F.lit(document_id).alias("document_id"), "hints"))
        matches = documents.hint_matches(found, t["paper_identifier"]).orderBy("pos").collect()
        ids = list(dict.fromkeys(m.paper_id for m in matches if m.paper_id))
        records = papers.paper_records(
            t["paper"],
            t["paper_identifier"],
            self._ids(*ids),
        ).orderBy("created_at", "id").collect() if ids else []
        assessment = None
        if document.paper_id is None:
            chosen = found.select("document_id", H.select_identifiers(F.col("hints")).alias("identifiers"))
            assessment = identity.resolve(
                chosen,
                t["paper_identifier"],
                "document_id",
            ).select(documents.assess()).first()[0]
        return {
            "document": document,
            "available": True,
            "hints": matches,
            "assessment": assessment,
            "candidates": records,
            "next_steps": self._next_steps(document, matches, records),
        }

    @staticmethod
    def _next_steps(document: Row, matches: list[Row], candidates: list[Row]) -> list[dict]:
        """``documents.next_steps`` of one document, whose hints and candidates are at hand."""
        if document.paper_id is not None:
            return []
        able = [{"step": "link", "target": c.id} for c in candidates]
        able += [
            {"step": "import", "target": f"{m.scheme}:{m.normalized_value}"}
            for m in matches if m.paper_id is None and m.scheme in documents.ASKABLE
        ]
        return able or [{"step": "search", "target": None}]

    def _relink(self, paper_id: str, document_id: str, link: bool) -> bool:
        at, t = self.catalog.pointer(), self._t()
        self._require_paper(t, paper_id)
        document = self._document(t, document_id)
        if (document.paper_id == paper_id) == link:
            return False
        pair = self.spark.createDataFrame([(document_id, paper_id)], "document_id string, paper_id string")
        change = documents.linked if link else documents.unlinked
        self.catalog.commit({"document_copy": change(t["document_copy"], pair)}, at)
        return True

    def link(self, paper_id: str, document_id: str) -> bool:
        return self._relink(paper_id, document_id, True)

    def unlink(self, paper_id: str, document_id: str) -> bool:
        return self._relink(paper_id, document_id, False)

    # --- providers ------------------------------------------------------------------------------

    def _stored(self, t: dict[str, DataFrame], work: expand.Work) -> tuple[list[str], list[tuple[str, str, str]]]:
        """Papers that hold identifiers of a work, and those of its identifiers that nobody holds."""
        held = self._holders(t, [(s, n) for s, _, n in work.keys])
        return sorted(set(held.values())), [k for k in work.keys if (k[0], k[2]) not in held]

    def _apply(
        self,
        t: dict[str, DataFrame],
        work: expand.Work,
        asked: list[Row],
    ) -> tuple[dict, dict[str, DataFrame], dict[str, DataFrame]]:
        """What importing a work comes to: the result, tables that change, and rows that are added."""
        keys = {(s, n) for s, _, n in work.keys}
        row = {
            "paper_id": None,
            "title": work.title,
            "publication_year": work.publication_year,
            "identifiers": [tuple(a) for a in asked],
            "identifiers_added": [],
            "identifiers_ignored": [],
            "candidate_paper_ids": [],
        }
        if not keys & {(a.scheme, a.normalized_value) for a in asked}:
            return row | {"status": ImportStatus.unconfirmed}, {}, {}
        row |= {
            "identifiers": work.keys,
            "identifiers_ignored": [tuple(a) for a in asked if (a.scheme, a.normalized_value) not in keys],
        }
        owners, free = self._stored(t, work)
        row["candidate_paper_ids"] = owners
        if len(owners) > 1:
            return row | {"status": ImportStatus.ambiguous}, {}, {}
        paper_id = owners[0] if owners else _new_id()
        new = [] if owners else [(paper_id, work.title, work.publication_year)]
        added = self._new_rows(new, [(paper_id, *k) for k in free])
        changed = {"paper": self._filled(t["paper"], {paper_id: (work.title, work.publication_year)})} if owners else {}
        return row | {
            "status": ImportStatus.matched if owners else ImportStatus.created,
            "paper_id": paper_id,
            "identifiers_added": free,
        }, changed, added

    def import_paper(self, provider, identifiers: Pairs, document_id: str | None = None) -> dict:
        """Import the work that the identifiers name; with a document, link it to the paper as well."""
        asked = self._normalized(list(identifiers))
        if not asked:
            raise ValueError("at least one identifier is required")
        if document_id is not None:
            self._document(self._t(), document_id)
        work = provider.lookup_work([(a.scheme, a.normalized_value) for a in asked])
        if work is None:
            raise E.WorkNotFound(", ".join(f"{a.scheme}:{a.normalized_value}" for a in asked))
        at, t = self.catalog.pointer(), self._t()  # only now: nothing is held open while a provider is asked
        result, changed, added = self._apply(t, work, asked)
        if document_id is not None:
            result["linked"] = False
        if document_id is not None and result["paper_id"]:
            result["linked"] = self._document(t, document_id).paper_id != result["paper_id"]
            pair = self.spark.createDataFrame(
                [(document_id, result["paper_id"])],
                "document_id string, paper_id string",
            )
            changed["document_copy"] = documents.linked(t["document_copy"], pair)
        if changed or added:
            self.catalog.commit(changed, at, added)
        return result

    def search(self, provider, query: str, limit: int = 10) -> list[dict]:
        if not query.strip():
            raise ValueError("query must not be empty")
        if not 1 <= limit <= 50:
            raise ValueError("limit must be between 1 and 50")
        found, t, out = provider.search_works(query.strip(), limit), self._t(), []
        for work in found:
            if work.keys:
                owners, _ = self._stored(t, work)
                status = CandidateStatus.new if not owners else CandidateStatus.existing if len(owners) == 1 else CandidateStatus.ambiguous
                out.append(
                    {
                        "title": work.title,
                        "publication_year": work.publication_year,
                        "identifiers": work.keys,
                        "status": status,
                        "paper_id": owners[0] if len(owners) == 1 else None,
                        "candidate_paper_ids": owners,
                    },
                )
        return out

    def _seed_work(self, provider, t: dict[str, DataFrame], paper_id: str) -> tuple[set[tuple[str, str]], expand.Work]:
        self._require_paper(t, paper_id)
        own = t["paper_identifier"].where(
            (F.col("paper_id") == paper_id) & F.col("normalized_value").isNotNull(),
        ).select("scheme", "normalized_value").distinct()
        keys = [tuple(r) for r in own.orderBy("scheme", "normalized_value").collect()]
        if not keys:
            raise E.PaperNotIdentifiable(paper_id)
        work = provider.lookup_work(keys)
        if work is None:
            raise E.ProviderWorkNotFound(paper_id)
        return set(keys), work

    def _metadata(self, t: dict[str, DataFrame], paper_id: str, work: expand.Work) -> dict:
        owners, free = self._stored(t, work)
        row = {"paper_id": paper_id, "title_set": False, "publication_year_set": False, "identifiers_added": []}
        if len(owners) > 1 or owners and owners != [paper_id]:
            return row | {"status": MetadataStatus.conflict}
        if not owners:
            return row | {"status": MetadataStatus.unconfirmed}
        old = t["paper"].where(F.col("id") == paper_id).first()
        return row | {
            "status": MetadataStatus.updated,
            "title_set": old.title is None and bool(work.title),
            "publication_year_set": old.publication_year is None and work.publication_year is not None,
            "identifiers_added": free,
        }

    def fetch_metadata(self, provider, paper_id: str) -> dict:
        """Fill what a paper lacks from its work; what is there is never overwritten."""
        _, work = self._seed_work(provider, self._t(), paper_id)
        at, t = self.catalog.pointer(), self._t()
        result = self._metadata(t, paper_id, work)
        if result["status"] == MetadataStatus.updated:
            filled = {"paper": self._filled(t["paper"], {paper_id: (work.title, work.publication_year)})}
            self.catalog.commit(filled, at, self._new_rows([], [(paper_id, *k) for k in result["identifiers_added"]]))
        return result

    def expand(
        self,
        provider,
        paper_id: str,
        direction: Direction = Direction.both,
        depth: int = 1,
        max_nodes: int = expand.DEFAULT_MAX_NODES,
    ) -> dict:
        """Store the works around a paper, as papers, and the citations between them."""
        if depth < 1 or max_nodes < 1:
            raise ValueError("depth and max_nodes must be at least 1")
        own, seed = self._seed_work(provider, self._t(), paper_id)
        if seed.key is None:
            raise E.ProviderWorkNotFound(paper_id)
        shares = bool(own & {(s, n) for s, _, n in seed.keys})
        walk = expand.walk(
            seed,
            provider.neighbours,
            Direction(direction),
            depth,
            max_nodes,
        ) if shares else expand.Walk({seed.key: seed})
        at, t = self.catalog.pointer(), self._t()
        self._require_paper(t, paper_id)
        metadata = self._metadata(t, paper_id, seed)
        result = {
            "seed_paper_id": paper_id,
            "seed_metadata": metadata,
            "papers_created": [],
            "papers_matched": [],
            "citations_created": 0,
            "citations_confirmed": 0,
            "skipped": [],
            "truncated": False,
        }
        if metadata["status"] != MetadataStatus.updated:
            return result
        held = self._holders(t, [(s, n) for w in walk.works.values() for s, _, n in w.keys])
        held.update({(s, n): paper_id for s, _, n in metadata["identifiers_added"]})
        fold = expand.fold(walk, seed.key, paper_id, held, lambda key: _new_id())
        fills, made = fold.fills, set(fold.created)
        keys = [(paper_id, *k) for k in metadata["identifiers_added"]] + fold.added
        added = self._new_rows([(i, *fills[i]) for i in dict.fromkeys(fold.created)], keys)
        old = {i: v for i, v in fills.items() if i not in made and i != paper_id}
        title, year = fills.get(paper_id, (None, None))
        old[paper_id] = seed.title or title, year if seed.publication_year is None else seed.publication_year
        if fold.edges:
            known = self._known(t, fold.edges)
            fresh = [e for e in fold.edges if e not in known]
            if fresh:
                added["citation"] = self._citation_rows(fresh)
            result |= {"citations_created": len(fresh), "citations_confirmed": len(known)}
        self.catalog.commit({"paper": self._filled(t["paper"], old)}, at, added)
        return result | {
            "papers_created": fold.created,
            "papers_matched": fold.matched,
            "skipped": fold.skipped,
            "truncated": walk.truncated,
        }
