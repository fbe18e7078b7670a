"""Queries on papers and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import normalize
from quillgraph.functions.hints import first_wins
from quillgraph.operators import audit, identity, papers
from quillgraph.queries.relations import EDGES, edges, identifiers
from quillgraph.schema import TABLES
from quillgraph.tables import table


def _records(s, d):
    return papers.paper_records(table(s, d, "paper"), table(s, d, "paper_identifier"))


def _paper_list(s, d):
    return _records(s, d).select(
        "id",
        "title",
        "publication_year",
        "created_at",
        papers.identifier_text().alias("identifiers"),
        "in_library",
    )


def _paper_label(s, d):
    return _records(s, d).select(
        "id",
        papers.paper_label().alias("label"),
        papers.primary_identifier().alias("primary_identifier"),
    )


def _spellings(s, d, scheme, how):
    rows = table(s, d, "paper_identifier").where(F.col("scheme") == scheme).select("id", "value").distinct()
    return rows.select("id", how(F.col("value")).alias("normalized"))


def _generic(s, d):
    rows = table(s, d, "paper_identifier").select("id", "scheme", "value").distinct()
    scheme = normalize.normalize_scheme(F.concat(F.lit(" "), F.upper("scheme"), F.lit("\t")))
    return rows.where(~F.col("scheme").isin("doi", "arxiv", "openalex")).select(
        "id",
        scheme.alias("scheme"),
        normalize.normalize_value(scheme, F.col("value")).alias("normalized"),
    )


def _dedup_first(s, d):
    """Each paper's identifiers as stored, in the order of row ids, each key once, the first staying."""
    rows = table(s, d, "paper_identifier").where("normalized_value IS NOT NULL").distinct()
    held = rows.groupBy("paper_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "scheme", "value", "normalized_value"))).alias("all"),
    )
    kept = first_wins(
        F.col("all"),
        "array<struct<id:string,scheme:string,value:string,normalized_value:string>>",
        "scheme",
        "normalized_value",
    )
    return held.select("paper_id", F.array_join(F.transform(kept, lambda i: i["id"]), " ").alias("kept"))


def _conflicts(s, d):
    return identity.conflicts(table(s, d, "paper_identifier"))


def _totals(s, d):
    return papers.totals(table(s, d, "paper"), edges(s, d))


def _degrees(s, d):
    return papers.degrees(edges(s, d), table(s, d, "paper"))


def _filter(s, d):
    return _records(s, d).where(papers.text_filter("Data Set FOR")).select("id")


QUERIES = {
    "paper_list": _paper_list,
    "paper_label": _paper_label,
    "node_label": lambda s, d: _records(s, d).select("id", papers.short_label().alias("label")),
    "library_papers": lambda s, d: papers.library(table(s, d, "paper")).select("id", "title", "library_added_at"),
    "paper_records_subset": lambda s, d: papers.paper_records(
        table(s, d, "paper"), table(s, d, "paper_identifier"), identifiers(s, d).where("scheme = 'arxiv'").select(F.col("paper_id").alias("id"))
    ).select("id", papers.identifier_text().alias("identifiers"), "in_library"),
    "graph_filter": _filter,
    "normalize_doi": lambda s, d: _spellings(s, d, "doi", normalize.normalize_doi),
    "normalize_arxiv": lambda s, d: _spellings(s, d, "arxiv", normalize.normalize_arxiv),
    "normalize_openalex": lambda s, d: _spellings(s, d, "openalex", normalize.normalize_openalex),
    "normalize_generic": _generic,
    "clean_title": lambda s, d: table(s, d, "paper").select("id", normalize.clean_title(F.col("title")).alias("title")),
    "dedup_first": _dedup_first,
    "identifier_conflicts": _conflicts,
    "dashboard_totals": _totals,
    "degree_global": _degrees,
    "most_cited_top5": lambda s, d: papers.most_cited(edges(s, d), 5),
    "constraint_audit": lambda s, d: audit.violations({t: table(s, d, t) for t in TABLES}),
}

_IDS = """
  i AS (SELECT paper_id, scheme, normalized_value AS v, min(value) AS raw FROM paper_identifier
        WHERE normalized_value IS NOT NULL GROUP BY 1, 2, 3)
"""
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_OF = "SELECT DISTINCT id, value FROM paper_identifier WHERE scheme = "

SQL = {
    "paper_list": f"""
      WITH {_IDS}, n AS (SELECT paper_id, string_agg(scheme || ':' || v, ' ' ORDER BY scheme, v) AS identifiers FROM i GROUP BY 1)
      SELECT p.id, title, publication_year, created_at, coalesce(identifiers, '') AS identifiers, library_added_at IS NOT NULL AS in_library
      FROM paper p LEFT JOIN n ON n.paper_id = p.id
    """,
    "paper_label": f"""
      WITH {_IDS}, n AS (
        SELECT paper_id, min(CASE WHEN scheme = 'doi' THEN v END) AS doi, min(CASE WHEN scheme = 'arxiv' THEN v END) AS arxiv,
               min(scheme || ':' || v) AS first FROM i GROUP BY 1),
      q AS (SELECT p.id, title, coalesce('doi:' || doi, 'arxiv:' || arxiv, first) AS primary_identifier FROM paper p LEFT JOIN n ON n.paper_id = p.id)
      SELECT id, coalesce(nullif(title, ''), primary_identifier, substr(id, 1, 8)) AS label, primary_identifier FROM q
    """,
    "node_label": f"""
      WITH {_IDS}, n AS (SELECT paper_id, min(scheme || ':' || v) AS first FROM i GROUP BY 1)
      SELECT id, coalesce(CASE WHEN length(title) > 40 THEN substr(title, 1, 40) || '…' ELSE nullif(title, '') END, first, substr(id, 1, 8)) AS label
      FROM paper p LEFT JOIN n ON n.paper_id = p.id
    """,
    "library_papers": "SELECT id, title, library_added_at FROM paper WHERE library_added_at IS NOT NULL",
    "paper_records_subset": f"""
      WITH {_IDS}, n AS (SELECT paper_id, string_agg(scheme || ':' || v, ' ' ORDER BY scheme, v) AS identifiers FROM i GROUP BY 1)
      SELECT p.id, identifiers, library_added_at IS NOT NULL AS in_library FROM paper p JOIN n ON n.paper_id = p.id
      WHERE p.id IN (SELECT paper_id FROM i WHERE scheme = 'arxiv')
    """,
    "graph_filter": f"""
      WITH {_IDS}, n AS (SELECT paper_id, string_agg(scheme || ':' || raw, ' ' ORDER BY scheme, v) AS identifiers FROM i GROUP BY 1)
      SELECT p.id FROM paper p LEFT JOIN n ON n.paper_id = p.id
      WHERE contains(regexp_replace(lower(concat_ws(' ', title, coalesce(identifiers, ''), p.id)), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', '', 'g'), 'datasetfor')
    """,
    "normalize_doi": rf"""
      WITH q AS (SELECT id, regexp_replace({_strip("value")}, '^(?i:doi:|https?://(dx\.)?doi\.org/)', '') AS v FROM ({_OF} 'doi'))
      SELECT id, CASE WHEN regexp_full_match(v, '10\.[^/\s]+/[^\s]+') THEN lower(v) END AS normalized FROM q
    """,
    "normalize_arxiv": rf"""
      WITH q AS (SELECT id, regexp_replace(regexp_replace({_strip("value")}, '^(?i:arxiv:|https?://arxiv\.org/(abs|pdf)/)', ''), '\.pdf$', '') AS v FROM ({_OF} 'arxiv'))
      SELECT id, nullif(regexp_extract(v, '^(\d{{4}}\.\d{{4,5}}|[a-z-]+(\.[A-Z]{{2}})?/\d{{7}})(v\d+)?$', 1), '') AS normalized FROM q
    """,
    "normalize_openalex": rf"""
      WITH q AS (SELECT id, regexp_replace({_strip("value")}, '^(?i:openalex:|https?://(api\.)?openalex\.org/(works/)?)', '') AS v FROM ({_OF} 'openalex'))
      SELECT id, CASE WHEN regexp_full_match(v, '[wW]\d+') THEN upper(v) END AS normalized FROM q
    """,
    "normalize_generic": f"""
      SELECT DISTINCT id, scheme, nullif({_strip("value")}, '') AS normalized FROM paper_identifier WHERE scheme NOT IN ('doi', 'arxiv', 'openalex')
    """,
    "clean_title": f"SELECT id, nullif({_strip('title')}, '') AS title FROM paper",
    "dedup_first": """
      WITH q AS (SELECT paper_id, scheme, normalized_value, min(id) AS id FROM paper_identifier WHERE normalized_value IS NOT NULL GROUP BY 1, 2, 3)
      SELECT paper_id, string_agg(id, ' ' ORDER BY id) AS kept FROM q GROUP BY 1
    """,
    "identifier_conflicts": """
      WITH q AS (SELECT DISTINCT scheme, normalized_value, paper_id FROM paper_identifier WHERE normalized_value IS NOT NULL)
      SELECT q.* FROM q JOIN (SELECT scheme, normalized_value FROM q GROUP BY 1, 2 HAVING count(*) > 1) USING (scheme, normalized_value)
    """,
    "dashboard_totals": f"WITH {EDGES} SELECT count(*) AS papers, count(library_added_at) AS library, (SELECT count(*) FROM e) AS citations FROM paper",
    "degree_global": f"""
      WITH {EDGES}, i AS (SELECT cited AS id, count(*) AS n FROM e GROUP BY 1), o AS (SELECT citing AS id, count(*) AS n FROM e GROUP BY 1)
      SELECT p.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM paper p LEFT JOIN i ON i.id = p.id LEFT JOIN o ON o.id = p.id
    """,
    "most_cited_top5": f"WITH {EDGES} SELECT cited AS id, count(*) AS citations FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "constraint_audit": """
      WITH h AS (SELECT DISTINCT scheme, normalized_value, paper_id FROM paper_identifier WHERE normalized_value IS NOT NULL)
      SELECT 'paper.id repeated' AS rule, count(*) AS violations FROM (SELECT id FROM paper GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'identifier held by several papers', count(*) FROM (SELECT 1 FROM h GROUP BY scheme, normalized_value HAVING count(*) > 1)
      UNION ALL SELECT 'identifier row repeated', count(*) FROM (SELECT id FROM paper_identifier GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'identifier without paper', count(*) FROM paper_identifier WHERE paper_id NOT IN (SELECT id FROM paper)
      UNION ALL SELECT 'source path repeated', count(*) FROM (SELECT 1 FROM scan_source GROUP BY normalized_path HAVING count(*) > 1)
      UNION ALL SELECT 'document path repeated', count(*) FROM (SELECT 1 FROM document_copy GROUP BY normalized_path HAVING count(*) > 1)
      UNION ALL SELECT 'document without its paper', count(*) FROM document_copy WHERE paper_id NOT IN (SELECT id FROM paper)
      UNION ALL SELECT 'citation repeated', count(*) FROM (SELECT 1 FROM citation WHERE citing_paper_id IS NOT NULL AND cited_paper_id IS NOT NULL
                                                           GROUP BY citing_paper_id, cited_paper_id HAVING count(*) > 1)
      UNION ALL SELECT 'citation of itself', count(*) FROM citation WHERE citing_paper_id = cited_paper_id
      UNION ALL SELECT 'citation without an end', count(*) FROM citation WHERE citing_paper_id IS NULL OR cited_paper_id IS NULL
      UNION ALL SELECT 'citing paper not stored', count(*) FROM citation WHERE citing_paper_id NOT IN (SELECT id FROM paper)
      UNION ALL SELECT 'cited paper not stored', count(*) FROM citation WHERE cited_paper_id NOT IN (SELECT id FROM paper)
    """,
}
