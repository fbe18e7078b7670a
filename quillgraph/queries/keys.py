"""Queries on keys that hold most rows."""

from __future__ import annotations

from quillgraph.operators import heavy_keys
from quillgraph.tables import table

QUERIES = {
    "p4_found": lambda s, d: heavy_keys.most_cited(table(s, d, "citation")).select("cited_paper_id"),
    "p4_summary": lambda s, d: heavy_keys.cited_paper_summary(table(s, d, "citation")),
}

_EDGES = """
  SELECT citing_paper_id AS citing, cited_paper_id AS cited,
         min(created_at) AS first_at, max(created_at) AS last_at
  FROM citation
  WHERE citing_paper_id IS NOT NULL AND cited_paper_id IS NOT NULL
    AND citing_paper_id <> cited_paper_id
  GROUP BY 1, 2
"""

SQL = {
    "p4_found": f"""
      WITH e AS ({_EDGES})
      SELECT cited AS cited_paper_id FROM e GROUP BY cited
      HAVING count(*) * 40 >= (SELECT count(*) FROM e)
    """,
    "p4_summary": f"""
      WITH e AS ({_EDGES})
      SELECT cited AS cited_paper_id, count(*) AS citations,
             min(first_at) AS first_at, max(last_at) AS last_at
      FROM e GROUP BY cited
    """,
}
