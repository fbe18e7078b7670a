"""Queries on works, documents and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import hints
from quillgraph.operators import audit, documents, expand, identity, importing, scan
from quillgraph.operators import works as W
from quillgraph.operators.importing import normalized_once
from quillgraph.queries.relations import (
    ANSWERS, DEEP_WORKS, REQUESTS, SCAN, WORKS, copies, deep_works, identifiers, listing, requests, sources, works,
)
from quillgraph.schema import Direction
from quillgraph.session import cut
from quillgraph.tables import table

_joined = lambda c: F.array_join(c, " ")
_keys = lambda c: F.array_join(
    F.array_sort(F.transform(c, lambda i: F.concat(i["scheme"], F.lit(":"), i["normalized_value"]))),
    " ",
)

#: Works that a walk of the registered query may take.
BUDGET = 50


def _works(s, d):
    """Works with their keys, made once: the queries read them for requests, look-ups and answers."""
    return normalized_once(works(s, d))


def _resolve(s, d):
    groups = W.with_keys(works(s, d)).select("work_id", F.col("keys").alias("identifiers"))
    rows = identity.resolve(groups, table(s, d, "paper_identifier"), "work_id")
    return rows.select(
        "work_id",
        "status",
        "paper_id",
        _joined("candidate_paper_ids").alias("candidates"),
        F.size("unassigned").cast("long").alias("unassigned"),
    )


def _candidates(s, d):
    rows = importing.candidates(_works(s, d), table(s, d, "paper_identifier"))
    choice = importing.import_choice()
    return rows.select(
        "work_id",
        "status",
        "title",
        "paper_id",
        F.concat(choice["scheme"], F.lit(":"), choice["normalized_value"]).alias("import_by"),
    )


def _lookup(s, d):
    known = _works(s, d)
    return W.lookup(requests(s, d, known), known, "request")


def _import(s, d):
    known = _works(s, d)
    rows = importing.import_status(requests(s, d, known), known, table(s, d, "paper_identifier"), "request")
    held = F.when(F.col("status") == "matched", F.col("paper_id"))
    return rows.select(
        "request",
        "status",
        "work_id",
        held.alias("paper_id"),
        "title",
        "publication_year",
        _keys("added").alias("added"),
        _keys("ignored").alias("ignored"),
        _joined("candidate_paper_ids").alias("candidates"),
    )


def _fill(s, d):
    rows = importing.metadata_fill(table(s, d, "paper"), table(s, d, "paper_identifier"), _works(s, d))
    return rows.withColumn("added", _keys("added"))


def _references(s, d):
    known = cut(deep_works(s, d))
    rows = W.fetch_references(known, known, 5)
    return rows.select("work_id", "pos", "other_id", F.size("identifiers").alias("identifiers"), "title", "publication_year")


def _citing(s, d):
    known = cut(deep_works(s, d))
    return W.fetch_citations(known.select("work_id"), known, 3)


def _payloads(s, d):
    """(payload) of a provider's records, one per order: DOIs in several spellings and broken ones, years
    and titles of several kinds, and linked arXiv pages that agree or do not."""
    n = F.col("o_orderkey")
    text = n.cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    of = lambda by, *values: F.element_at(F.array(*values), (n % by + 1).cast("int"))
    five = F.lpad((n % 90000).cast("string"), 5, "0")
    page = lambda c: F.concat(F.lit('{"landing_page_url": '), quoted(c), F.lit("}"))
    doi = of(
        5,
        quoted(F.concat(F.lit("https://doi.org/10.5555/Ab."), text)),
        quoted(F.concat(F.lit(" 10.5555/Ab."), text)),
        quoted(F.concat(F.lit("10.48550/arXiv.2401."), five)),
        quoted(F.lit("10/broken")),
        F.lit("null"),
    )
    same = F.concat(page(F.concat(F.lit("http://arxiv.org/abs/2402."), five)), F.lit(", "), page(F.concat(F.lit("https://doi.org/10.48550/arXiv.2402."), five, F.lit("v2"))))
    other = F.concat(page(F.concat(F.lit("http://arxiv.org/abs/2402."), five)), F.lit(', {}, null, '), page(F.lit("http://arxiv.org/abs/2403.00001")))
    payload = F.concat(
        F.lit('{"id": '),
        of(7, *[quoted(F.concat(F.lit(p), text)) for p in ("https://openalex.org/W", "W", "w", "A")], F.lit("5"), *[quoted(F.concat(F.lit("W"), text))] * 2),
        F.lit(', "doi": '),
        doi,
        F.lit(', "display_name": '),
        of(3, quoted(F.concat(F.lit(" Order "), text)), quoted(F.lit("  ")), F.lit("null")),
        F.lit(', "publication_year": '),
        of(4, F.lit("2001"), F.lit('"2001"'), F.lit("true"), F.lit("2001.5")),
        F.lit(', "locations": ['),
        of(3, same, other, F.lit("")),
        F.lit("]"),
        F.when(n % 11 == 10, F.lit("")).otherwise(F.lit("}")),
    )
    return table(s, d, "orders").select(payload.alias("payload"))


def _records(s, d):
    rows = W.parse_works(_payloads(s, d))
    spelled = F.array_join(F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit(":"), i["value"])), " ")
    return rows.select("work_id", spelled.alias("identifiers"), "title", "publication_year", F.size("landing_pages").alias("pages"))


def _search(s, d):
    return W.search(works(s, d), "for the", 25).select("work_id", "title")


def _filename(s, d):
    rows = copies(s, d).select("id", F.explode(hints.filename_hints(F.col("normalized_path"))).alias("h"))
    return rows.select("id", "h.scheme", "h.value", "h.normalized_value")


def _first_pages(s, d):
    return table(s, d, "documents").select(
        F.col("doc_id").alias("document_id"),
        hints.located(F.col("text")).alias("matches"),
    )


def _text_hints(s, d):
    rows = _first_pages(s, d).select("document_id", F.posexplode(hints.text_hints(F.col("matches"))).alias("pos", "h"))
    return rows.select("document_id", "pos", "h.scheme", "h.value", "h.normalized_value")


def _files(s, d):
    """(document_id, path, info, xmp, text): documents as files, with what a PDF says about itself.

    Every fourth is named by an arXiv id, half of these with a version; Info has a DOI in one of three
    cases, that of the document's paper if it has one, and a broken one in another; XMP gives one as
    attribute, element, list items or general identifier.
    """
    n = F.col("doc_id")
    least = identifiers(s, d).where("scheme = 'doi'").groupBy("paper_id").agg(F.min("normalized_value").alias("own"))
    rows = table(s, d, "documents").select("doc_id", "text", "paper_id").join(least, "paper_id", "left")
    text = n.cast("string")
    five = F.lpad((n % 90000).cast("string"), 5, "0")
    version = F.when(n % 8 == 0, F.lit("v2")).otherwise(F.lit(""))
    name = F.when(n % 4 == 0, F.concat(F.lit("2404."), five, version, F.lit(".PDF"))).otherwise(F.concat(F.lit("note-2404."), five, F.lit(".pdf")))
    doi = F.concat(F.lit("10.5555/Doc."), text)
    info = F.when(n % 3 == 0, F.create_map(F.lit("/Title"), F.lit("10.1/no"), F.lit("/DOI"), F.concat(F.lit("https://doi.org/"), F.coalesce(F.upper("own"), doi)))).when(
        n % 3 == 1,
        F.create_map(F.lit("Doi"), F.lit("broken")),
    )
    xmp = F.element_at(
        F.array(
            F.concat(F.lit('<rdf:Description prism:doi="'), doi, F.lit('" rdf:about="">')),
            F.concat(F.lit("<x><pdfx:DOI>doi:"), F.upper(doi), F.lit("</pdfx:DOI ><pdfx:doi>open")),
            F.concat(F.lit("<dc:identifier><rdf:Bag><rdf:li>urn:7</rdf:li><rdf:li>doi:10.5555/x."), text, F.lit("</rdf:li><rdf:li>"), doi, F.lit("</rdf:li></rdf:Bag></dc:identifier>")),
            F.concat(F.lit("<dc:identifier>see "), doi, F.lit("</dc:identifier><crossmark:DOI><b>"), doi, F.lit("</b></crossmark:DOI>")),
            F.lit(None).cast("string"),
        ),
        (n % 5 + 1).cast("int"),
    )
    return rows.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("/in/10.9/"), name).alias("path"), info.alias("info"), xmp.alias("xmp"), "text")


def _hints(s, d):
    """(document_id, hints), read from the files once."""
    read = hints.with_xmp_values(_files(s, d)).withColumn("matches", hints.located(F.col("text")))
    read = cut(read.drop("text", "xmp"))
    return read.select(
        "document_id",
        hints.document_hints(F.col("path"), F.col("info"), F.col("xmp_values"), F.col("matches")).alias("hints"),
    )


def _document_hints(s, d):
    each = _hints(s, d).select("document_id", F.posexplode("hints").alias("pos", "h"))
    return each.select("document_id", "pos", "h.scheme", "h.normalized_value", "h.origin")


def _selected(s, d):
    return _hints(s, d).select(
        "document_id",
        F.col("document_id").alias("order"),
        hints.select_identifiers(F.col("hints")).alias("identifiers"),
    )


def _identify(s, d):
    rows = documents.identify(_selected(s, d), table(s, d, "paper_identifier"))
    return rows.select(
        "document_id",
        "status",
        "paper_id",
        _keys("identifiers").alias("identifiers"),
        F.size("candidate_paper_ids").cast("long").alias("candidates"),
    )


def _matches(s, d):
    return documents.hint_matches(_hints(s, d), table(s, d, "paper_identifier"))


def _next_steps(s, d):
    every = table(s, d, "documents").select(F.col("doc_id").alias("document_id"))
    return documents.next_steps(every, cut(_matches(s, d)), table(s, d, "paper"))


def _applied(s, d):
    """The copies after a scan whose files have a hash of their own, some of which cannot be read."""
    diff = cut(_diff(s, d))
    stale = diff.where(F.col("state").isin("new", "changed"))
    digest = F.when(F.substring(F.md5("normalized_path"), 2, 1) != "0", F.concat(F.lit("sha256:"), F.md5("normalized_path")))
    known = table(s, d, "document_copy").groupBy("normalized_path").agg(F.max(F.struct(*table(s, d, "document_copy").columns)).alias("c")).select("c.*")
    out = scan.apply_scan(known, diff, stale.select("normalized_path", digest.alias("content_hash")), F.lit("2030-01-01").cast("timestamp"))
    now = F.lit("2030-01-01").cast("timestamp")
    return out.select(
        "id",
        "normalized_path",
        "content_hash",
        "file_size",
        "file_mtime_ns",
        (F.col("last_seen_at") == now).alias("seen"),
        F.when(F.col("missing_since") == now, "now").when(F.col("missing_since").isNotNull(), "before").alias("missing"),
        (F.col("created_at") == now).alias("made"),
    )


def _expand(s, d):
    """(turn, citing, cited, works, truncated): the edges of a budgeted walk over the deep works, both
    ways, two steps deep, in their order, from the work that lists most references."""
    known = cut(deep_works(s, d))
    size = F.size(F.coalesce("referenced_works", F.array().cast("array<string>")))
    first = known.orderBy(F.desc(size), "work_id").first()
    seed = expand.Work(first.work_id, [("openalex", first.work_id, first.work_id)], first.title, first.publication_year)
    found = expand.walk(seed, expand.offline_neighbours(known), Direction.both, 2, BUDGET)
    rows = [(k, a[1], b[1], len(found.works), found.truncated) for k, (a, b) in enumerate(found.edges)]
    return s.createDataFrame(rows, "turn int, citing string, cited string, works int, truncated boolean")


def _diff(s, d):
    return scan.scan_diff(listing(s, d), copies(s, d), sources(s, d))


QUERIES = {
    "resolve_identifiers": _resolve,
    "work_candidates": _candidates,
    "lookup_order": _lookup,
    "import_status": _import,
    "metadata_fill": _fill,
    "walk_references": _references,
    "walk_citations": _citing,
    "expand_budget": _expand,
    "provider_records": _records,
    "provider_search": _search,
    "filename_hints": _filename,
    "text_hints": _text_hints,
    "document_hints": _document_hints,
    "strip_punct": lambda s, d: table(s, d, "documents").select(
        F.col("doc_id").alias("document_id"),
        hints.strip_trailing_punctuation(F.col("text")).alias("stripped"),
    ),
    "select_identifiers": lambda s, d: _selected(s, d).select("document_id", _keys("identifiers").alias("identifiers")),
    "identify_batch": _identify,
    "identify_summary": lambda s, d: documents.summary(
        documents.identify(_selected(s, d), table(s, d, "paper_identifier")),
    ),
    "hint_matches": lambda s, d: _matches(s, d).select(
        "document_id",
        "pos",
        "scheme",
        "normalized_value",
        "origin",
        "strong",
        "paper_id",
    ),
    "importable_hints": lambda s, d: documents.importable(_matches(s, d)).select("document_id", "pos", "scheme", "normalized_value"),
    "next_steps": _next_steps,
    "scan_apply": _applied,
    "scan_diff": lambda s, d: _diff(s, d).select("normalized_path", "document_id", "source_id", "state", "reappeared"),
    "scan_counters": lambda s, d: scan.scan_counters(listing(s, d), _diff(s, d), sources(s, d)),
    "missing_docs": lambda s, d: documents.documents(copies(s, d)).select(
        "id",
        documents.presence().alias("presence"),
    ).where("presence = 'missing'"),
    "documents_unlinked": lambda s, d: documents.documents(
        table(s, d, "document_copy"),
        unlinked_only=True,
    ).select("id", "normalized_path"),
    "document_paper_join": lambda s, d: documents.with_paper_labels(
        table(s, d, "document_copy"),
        table(s, d, "paper"),
        table(s, d, "paper_identifier"),
    ),
    "duplicate_hashes": lambda s, d: audit.equal_contents(table(s, d, "document_copy")),
    "source_prefix_join": lambda s, d: scan.covering(
        copies(s, d).select("normalized_path").distinct(),
        table(s, d, "scan_source"),
    ).select("normalized_path", "source_id"),
}

_STATUS = "CASE WHEN n_keys = 0 THEN 'insufficient' WHEN n_papers = 0 THEN 'new' WHEN n_papers = 1 THEN 'matched' ELSE 'ambiguous' END"
# A text's arXiv stamps and DOIs in their order, without closing punctuation.
_PUNCT = r"CASE WHEN contains({0}, '(') THEN regexp_replace({0}, '[.,;:\]}}]+$', '') ELSE regexp_replace({0}, '[.,;:)\]}}]+$', '') END"
_TEXT = rf"""
  raw AS (
    SELECT doc_id AS document_id, unnest(m) AS mark, generate_subscripts(m, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '(?i:arXiv:\d{{4}}\.\d{{4,5}}(?:v\d+)?)|\b10\.\d{{4,9}}/[^\s\p{{Z}}"<>]+') AS m FROM documents)),
  mark AS (
    SELECT document_id, CASE WHEN mark[1:3] = '10.' THEN 'doi' ELSE 'arxiv' END AS scheme,
           CASE WHEN mark[1:3] = '10.' THEN mark ELSE mark[7:] END AS found, min(i) AS i FROM raw GROUP BY 1, 2, 3),
  cleaned AS (SELECT document_id, scheme, CASE WHEN scheme = 'doi' THEN {_PUNCT.format("found")} ELSE found END AS value, i FROM mark),
  th AS (
    SELECT document_id, scheme, value, CASE WHEN scheme = 'arxiv' THEN regexp_replace(value, 'v\d+$', '') ELSE lower(value) END AS normalized_value,
           row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS pos
    FROM cleaned WHERE CASE WHEN scheme = 'arxiv' THEN regexp_full_match(value, '\d{{4}}\.\d{{4,5}}(v\d+)?')
                            ELSE regexp_full_match(value, '10\.[^/\s]+/[^\s]+') END)
"""
# All hints of the files that the queries make of the documents, in their order.
_HINTS = rf"""
  {_TEXT},
  own_doi AS (SELECT paper_id, min(normalized_value) AS own FROM paper_identifier WHERE scheme = 'doi' AND normalized_value IS NOT NULL GROUP BY 1),
  every_hint AS (
    SELECT doc_id AS document_id, 'arxiv' AS scheme, '2404.' || lpad(CAST(doc_id % 90000 AS VARCHAR), 5, '0') AS v, 'filename' AS origin, 0 AS part, 0 AS i
    FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, 'doi', coalesce(own, '10.5555/doc.' || doc_id), 'pdf_metadata', 1, 0 FROM documents LEFT JOIN own_doi USING (paper_id) WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'doi', '10.5555/doc.' || doc_id, 'pdf_metadata', 2, 1 FROM documents WHERE doc_id % 5 IN (0, 1, 2, 3)
    UNION ALL SELECT doc_id, 'doi', '10.5555/x.' || doc_id, 'pdf_metadata', 2, 0 FROM documents WHERE doc_id % 5 = 2
    UNION ALL SELECT document_id, scheme, normalized_value, 'pdf_text', 3, pos FROM th),
  once AS (SELECT document_id, scheme, v, origin, min(part * 100000000 + i) AS turn FROM every_hint GROUP BY 1, 2, 3, 4),
  hv AS (
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS pos, scheme, v AS normalized_value, origin,
           scheme = 'arxiv' OR origin <> 'pdf_text' AS strong FROM once),
  strong AS (SELECT DISTINCT document_id FROM hv WHERE strong),
  sel AS (SELECT DISTINCT document_id, scheme, normalized_value AS v FROM hv WHERE strong OR document_id NOT IN (SELECT document_id FROM strong)),
  held AS (SELECT DISTINCT scheme, normalized_value AS v, paper_id FROM paper_identifier WHERE normalized_value IS NOT NULL),
  least_held AS (SELECT scheme, v, min(paper_id) AS paper_id FROM held GROUP BY 1, 2),
  matched AS (SELECT hv.*, m.paper_id FROM hv LEFT JOIN least_held m ON m.scheme = hv.scheme AND m.v = hv.normalized_value)
"""
_MINTED = r"regexp_replace(md5('paper:' || {0}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"
_IDENTIFY = f"""
  {_HINTS},
  g AS (
    SELECT d.doc_id AS document_id, count(DISTINCT sel.scheme || ':' || sel.v) AS n, count(DISTINCT held.paper_id) AS papers, min(held.paper_id) AS holder,
           count(DISTINCT CASE WHEN held.paper_id IS NULL THEN sel.scheme || ':' || sel.v END) AS free,
           coalesce(string_agg(DISTINCT sel.scheme || ':' || sel.v, ' ' ORDER BY sel.scheme || ':' || sel.v), '') AS identifiers
    FROM documents d LEFT JOIN sel ON sel.document_id = d.doc_id LEFT JOIN held ON held.scheme = sel.scheme AND held.v = sel.v
    GROUP BY d.doc_id),
  fresh AS (SELECT identifiers, min(document_id) AS first FROM g WHERE n = 1 AND papers = 0 GROUP BY 1),
  seen AS (SELECT s.document_id, count(*) AS more FROM (SELECT document_id, scheme || ':' || v AS k FROM sel) s
           JOIN g ON g.document_id = s.document_id AND g.n > 1 JOIN fresh f ON f.identifiers = s.k AND f.first < s.document_id GROUP BY 1),
  o AS (
    SELECT g.document_id,
           CASE WHEN n = 0 THEN 'unidentified' WHEN papers > 1 OR (n > 1 AND NOT (papers = 1 AND free = 0)) THEN 'ambiguous'
                WHEN papers = 1 OR fresh.first < g.document_id THEN 'linked' ELSE 'created' END AS status,
           CASE WHEN papers = 1 AND (n = 1 OR free = 0) THEN holder WHEN n = 1 AND papers = 0 THEN {_MINTED.format("g.identifiers")} END AS paper_id,
           g.identifiers, CASE WHEN n = 1 AND papers = 0 THEN CASE WHEN fresh.first < g.document_id THEN 1 ELSE 0 END ELSE papers + coalesce(more, 0) END AS candidates
    FROM g LEFT JOIN fresh ON fresh.identifiers = g.identifiers AND g.n = 1 AND g.papers = 0 LEFT JOIN seen ON seen.document_id = g.document_id)
"""
# A walk as one row per step: the works so far with their distances, whose turn it is and which way.
_WALK = f"""
  adj AS (
    SELECT dw.id, coalesce(r.l, []) AS refs, coalesce(c.l, []) AS cites FROM (SELECT id FROM dw UNION SELECT other FROM dr) dw
    LEFT JOIN (SELECT id, list({{'pos': pos, 'id': other}} ORDER BY pos) AS l FROM dr GROUP BY id) r ON r.id = dw.id
    LEFT JOIN (SELECT id, list({{'pos': pos, 'id': other}} ORDER BY pos) AS l FROM dc GROUP BY id) c ON c.id = dw.id),
  walk(i, way, works, dists, edges, truncated, done) AS (
    SELECT 1, 0, [id], [0], CAST([] AS VARCHAR[]), false, false FROM (SELECT dw.id FROM dw LEFT JOIN dl ON dl.id = dw.id GROUP BY dw.id ORDER BY count(dl.id) DESC, dw.id LIMIT 1)
    UNION ALL
    SELECT CASE WHEN way = 1 THEN i + 1 ELSE i END, 1 - way, works || fits, dists || list_transform(fits, lambda x: dists[i] + 1),
           edges || list_transform(list_filter(near, lambda x: list_contains(works || fits, x)), lambda x: CASE WHEN way = 0 THEN works[i] || ' ' || x ELSE x || ' ' || works[i] END),
           truncated OR room <= 0 OR len(near) >= share OR len(fits) < len(fresh), room <= 0
    FROM (
      SELECT *, CASE WHEN room <= 0 THEN CAST([] AS VARCHAR[]) ELSE fresh[1:room] END AS fits FROM (
        SELECT *, list_filter(near, lambda x: NOT list_contains(works, x)) AS fresh FROM (
          SELECT *, CASE WHEN room <= 0 THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_transform(list_filter(
                      CASE WHEN way = 0 THEN refs ELSE cites END, lambda x: x.pos < share), lambda x: x.id), lambda x: x <> works[i]) END AS near FROM (
            SELECT walk.*, adj.*, {BUDGET} - len(works) AS room, CAST(ceil(({BUDGET} - len(works)) / (2.0 - way)) AS BIGINT) AS share
            FROM walk JOIN adj ON adj.id = works[i] WHERE NOT done AND dists[i] < 2))))),
  last_step AS (SELECT edges, len(works) AS works, truncated FROM walk ORDER BY i DESC, way DESC, done DESC LIMIT 1)
"""

SQL = {
    "resolve_identifiers": f"""
      WITH {WORKS}
      SELECT work_id, {_STATUS} AS status, CASE WHEN n_papers = 1 THEN held_by END AS paper_id, candidates, unassigned FROM r
    """,
    "work_candidates": f"""
      WITH {WORKS}, choice AS (
        SELECT work_id, coalesce(min(CASE WHEN scheme = 'openalex' THEN 'openalex:' || v END),
                                 CASE WHEN any_value(n) % 17 <> 0 THEN coalesce('doi:' || any_value(lower(doi)), 'doi:' || any_value(other_doi)) END) AS import_by
        FROM work JOIN k USING (work_id) GROUP BY 1)
      SELECT work_id, CASE WHEN n_papers = 1 THEN 'existing' WHEN n_papers = 0 THEN 'new' ELSE 'ambiguous' END AS status,
             work.title, CASE WHEN n_papers = 1 THEN held_by END AS paper_id, import_by
      FROM r JOIN work USING (work_id) JOIN choice USING (work_id) WHERE n_keys > 0
    """,
    "lookup_order": f"WITH {WORKS}, {ANSWERS}, {REQUESTS} SELECT * FROM hit",
    "import_status": f"""
      WITH {WORKS}, {ANSWERS}, {REQUESTS},
      known AS (SELECT DISTINCT hit.request, req.scheme, req.v, k.v IS NOT NULL AS shared FROM hit JOIN req ON req.request = hit.request
                LEFT JOIN k ON k.work_id = hit.work_id AND k.scheme = req.scheme AND k.v = req.v),
      about AS (SELECT request, bool_or(shared) AS sure, coalesce(string_agg(CASE WHEN NOT shared THEN scheme || ':' || v END, ' ' ORDER BY scheme || ':' || v), '') AS lacking FROM known GROUP BY 1)
      SELECT q.request, CASE WHEN hit.work_id IS NULL THEN NULL WHEN NOT sure THEN 'unconfirmed' WHEN n_papers > 1 THEN 'ambiguous'
                             WHEN n_papers = 0 THEN 'created' ELSE 'matched' END AS status,
             hit.work_id, CASE WHEN sure AND n_papers = 1 THEN held_by END AS paper_id, work.title, work.publication_year,
             CASE WHEN sure AND n_papers < 2 THEN free ELSE '' END AS added, CASE WHEN sure THEN lacking ELSE '' END AS ignored,
             CASE WHEN sure THEN candidates ELSE '' END AS candidates
      FROM (SELECT DISTINCT request FROM req) q LEFT JOIN hit ON hit.request = q.request LEFT JOIN about ON about.request = q.request
      LEFT JOIN r ON r.work_id = hit.work_id LEFT JOIN work ON work.work_id = hit.work_id
    """,
    "metadata_fill": f"""
      WITH {WORKS}, {ANSWERS},
      first_of AS (SELECT paper_id, scheme, min(v) AS v FROM i WHERE scheme IN ('openalex', 'doi', 'arxiv') AND paper_id IN (SELECT id FROM paper) GROUP BY 1, 2),
      hit AS (
        SELECT paper_id, arg_min(work_id, CASE f.scheme WHEN 'openalex' THEN 1 WHEN 'doi' THEN 2 ELSE 3 END) AS work_id
        FROM first_of f JOIN answer a ON a.scheme = f.scheme AND a.v = f.v GROUP BY 1),
      q AS (
        SELECT hit.paper_id, CASE WHEN n_papers > 1 OR (n_papers = 1 AND held_by <> hit.paper_id) THEN 'conflict' WHEN n_papers = 0 THEN 'unconfirmed' ELSE 'updated' END AS status,
               p.title, p.publication_year, work.title AS new_title, work.publication_year AS new_year, free
        FROM hit JOIN r ON r.work_id = hit.work_id JOIN work ON work.work_id = hit.work_id JOIN paper p ON p.id = hit.paper_id)
      SELECT paper_id, status, CASE WHEN status = 'updated' THEN coalesce(title, new_title) ELSE title END AS title,
             CASE WHEN status = 'updated' THEN coalesce(publication_year, new_year) ELSE publication_year END AS publication_year,
             status = 'updated' AND title IS NULL AND new_title IS NOT NULL AS title_set,
             status = 'updated' AND publication_year IS NULL AND new_year IS NOT NULL AS year_set,
             CASE WHEN status = 'updated' THEN free ELSE '' END AS added
      FROM q
    """,
    "walk_references": f"""
      WITH {DEEP_WORKS}
      SELECT dr.id AS work_id, pos, other AS other_id, 1 AS identifiers, CASE WHEN dw.id IS NOT NULL THEN 'Order ' || substr(other, 2) END AS title,
             CASE WHEN dw.id IS NOT NULL THEN year(o_orderdate) END::INTEGER AS publication_year
      FROM dr LEFT JOIN dw ON dw.id = other LEFT JOIN orders ON o_orderkey = dw.key WHERE pos < 5
    """,
    "walk_citations": f"WITH {DEEP_WORKS} SELECT id AS work_id, pos, other AS other_id FROM dc WHERE pos < 3 AND id IN (SELECT id FROM dw)",
    "expand_budget": f"""
      WITH RECURSIVE {DEEP_WORKS}, {_WALK}
      SELECT row_number() OVER (ORDER BY k) - 1 AS turn, split_part(edge, ' ', 1) AS citing, split_part(edge, ' ', 2) AS cited, works, truncated
      FROM (SELECT edge, min(k) AS k, any_value(works) AS works, any_value(truncated) AS truncated
            FROM (SELECT unnest(edges) AS edge, generate_subscripts(edges, 1) AS k, works, truncated FROM last_step) GROUP BY edge)
    """,
    "provider_records": """
      WITH q AS (SELECT o_orderkey AS n, lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') AS five FROM orders WHERE o_orderkey % 11 <> 10 AND o_orderkey % 7 NOT IN (3, 4))
      SELECT 'W' || n AS work_id,
             'openalex:W' || n || CASE n % 5 WHEN 0 THEN ' doi:10.5555/Ab.' || n WHEN 1 THEN ' doi:10.5555/Ab.' || n
                                            WHEN 2 THEN ' doi:10.48550/arXiv.2401.' || five || ' arxiv:2401.' || five
                                            ELSE CASE WHEN n % 3 = 0 THEN ' arxiv:2402.' || five ELSE '' END END AS identifiers,
             CASE WHEN n % 3 = 0 THEN 'Order ' || n END AS title, CASE WHEN n % 4 = 0 THEN 2001 END AS publication_year,
             CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS pages
      FROM q
    """,
    "provider_search": f"""
      WITH {WORKS}
      SELECT work_id, title FROM work WHERE contains(lower(title), 'for') AND contains(lower(title), 'the') ORDER BY length(title), work_id LIMIT 25
    """,
    "filename_hints": r"""
      WITH q AS (SELECT DISTINCT id, regexp_extract(normalized_path, '([^/]*)$', 1) AS name FROM document_copy),
      v AS (SELECT id, regexp_extract(name, '^(\d{4}\.\d{4,5}(v\d+)?)\.[pP][dD][fF]$', 1) AS value FROM q)
      SELECT id, 'arxiv' AS scheme, value, regexp_replace(value, 'v\d+$', '') AS normalized_value FROM v WHERE value <> ''
    """,
    "text_hints": f"WITH {_TEXT} SELECT document_id, pos, scheme, value, normalized_value FROM th",
    "document_hints": f"WITH {_HINTS} SELECT document_id, pos, scheme, normalized_value, origin FROM hv",
    "strip_punct": f"SELECT doc_id AS document_id, {_PUNCT.format('text')} AS stripped FROM documents",
    "select_identifiers": f"""
      WITH {_HINTS}
      SELECT d.doc_id AS document_id, coalesce(string_agg(sel.scheme || ':' || v, ' ' ORDER BY sel.scheme || ':' || v), '') AS identifiers
      FROM documents d LEFT JOIN sel ON sel.document_id = d.doc_id GROUP BY 1
    """,
    "identify_batch": f"WITH {_IDENTIFY} SELECT * FROM o",
    "identify_summary": f"""
      WITH {_IDENTIFY} SELECT count(*) FILTER (status IN ('linked', 'created')) AS linked, count(*) FILTER (status = 'ambiguous') AS ambiguous,
      count(*) FILTER (status = 'unidentified') AS unidentified FROM o
    """,
    "hint_matches": f"WITH {_HINTS} SELECT document_id, pos, scheme, normalized_value, origin, strong, paper_id FROM matched",
    "importable_hints": f"WITH {_HINTS} SELECT document_id, pos, scheme, normalized_value FROM matched WHERE paper_id IS NULL",
    "next_steps": f"""
      WITH {_HINTS}, able AS (
        SELECT DISTINCT document_id, 0 AS kind, 'link' AS step, paper_id AS target, created_at, 0 AS pos FROM matched JOIN paper ON paper.id = paper_id
        UNION ALL SELECT document_id, 1, 'import', scheme || ':' || normalized_value, NULL, pos FROM matched WHERE paper_id IS NULL),
      ranked AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY kind, created_at, pos, target) AS rank, step, target FROM able)
      SELECT doc_id AS document_id, coalesce(rank, 1) AS rank, coalesce(step, 'search') AS step, target FROM documents LEFT JOIN ranked ON document_id = doc_id
    """,
    "scan_apply": f"""
      WITH {SCAN}, one AS (SELECT normalized_path AS np, max(id) AS id FROM c GROUP BY 1), k AS (SELECT c.* FROM c JOIN one ON one.id = c.id AND one.np = c.normalized_path),
      q AS (
        SELECT coalesce(k.normalized_path, diff.normalized_path) AS path, k.*, state, f.size, f.t,
               CASE WHEN state IN ('new', 'changed') AND md5(diff.normalized_path)[2] <> '0' THEN 'sha256:' || md5(diff.normalized_path) END AS hash
        FROM k FULL JOIN diff ON diff.normalized_path = k.normalized_path LEFT JOIN f ON f.p = diff.normalized_path)
      SELECT DISTINCT coalesce(id, regexp_replace(md5('document:' || path), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')) AS id,
             path AS normalized_path, coalesce(hash, content_hash) AS content_hash, CASE WHEN hash IS NOT NULL THEN size ELSE file_size END AS file_size,
             CASE WHEN hash IS NOT NULL THEN t ELSE file_mtime_ns END AS file_mtime_ns,
             CASE WHEN hash IS NOT NULL OR state = 'same' THEN true WHEN last_seen_at IS NOT NULL THEN false END AS seen,
             CASE WHEN hash IS NOT NULL OR state = 'same' THEN NULL WHEN state = 'missing' THEN 'now' WHEN missing_since IS NOT NULL THEN 'before' END AS missing,
             id IS NULL AS made
      FROM q WHERE id IS NOT NULL OR hash IS NOT NULL
    """,
    "scan_diff": f"WITH {SCAN} SELECT * FROM diff",
    "scan_counters": f"""
      WITH {SCAN}, found AS (SELECT src.id, count(*) AS n FROM f JOIN src ON src.available AND starts_with(f.p, rtrim(src.root, '/') || '/') GROUP BY 1)
      SELECT src.id AS source_id, src.root AS normalized_path, available, coalesce(max(found.n), 0) AS found, count(*) FILTER (state = 'new') AS new,
             count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (reappeared) AS reappeared, count(*) FILTER (state = 'missing') AS missing
      FROM src LEFT JOIN found ON found.id = src.id LEFT JOIN diff ON diff.source_id = src.id GROUP BY 1, 2, 3
    """,
    "missing_docs": "SELECT DISTINCT id, 'missing' AS presence FROM document_copy WHERE missing_since IS NOT NULL",
    "documents_unlinked": "SELECT DISTINCT id, normalized_path FROM document_copy WHERE paper_id IS NULL",
    "document_paper_join": """
      WITH i AS (SELECT DISTINCT paper_id, scheme, normalized_value AS v FROM paper_identifier WHERE normalized_value IS NOT NULL),
      n AS (SELECT paper_id, min(CASE WHEN scheme = 'doi' THEN v END) AS doi, min(CASE WHEN scheme = 'arxiv' THEN v END) AS arxiv, min(scheme || ':' || v) AS first FROM i GROUP BY 1)
      SELECT DISTINCT c.id, normalized_path, CASE WHEN missing_since IS NULL THEN 'present' ELSE 'missing' END AS presence, c.paper_id,
             CASE WHEN p.id IS NOT NULL THEN coalesce(nullif(title, ''), 'doi:' || doi, 'arxiv:' || arxiv, first, substr(p.id, 1, 8)) END AS label
      FROM document_copy c LEFT JOIN paper p ON p.id = c.paper_id LEFT JOIN n ON n.paper_id = p.id
    """,
    "duplicate_hashes": """
      SELECT content_hash, count(DISTINCT normalized_path) AS copies, min(normalized_path) AS first_path FROM document_copy
      WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT normalized_path) > 1
    """,
    "source_prefix_join": """
      SELECT DISTINCT c.normalized_path, s.id AS source_id FROM document_copy c JOIN scan_source s ON starts_with(c.normalized_path, rtrim(s.normalized_path, '/') || '/')
    """,
}

