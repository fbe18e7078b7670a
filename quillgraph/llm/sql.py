"""The same results in plain SQL, for queries that SQL can express."""

from __future__ import annotations

from quillgraph.llm.formatting import PLACEHOLDERS

_LISTS = """
  WITH e AS (
    SELECT DISTINCT citing_paper_id AS c, cited_paper_id AS p FROM citation
    WHERE citing_paper_id IS NOT NULL AND cited_paper_id IS NOT NULL AND citing_paper_id <> cited_paper_id),
  l AS (SELECT * FROM e WHERE c IN (SELECT c FROM e GROUP BY c HAVING count(*) >= 5)),
  total AS (SELECT count(DISTINCT c) AS n FROM l),
  m AS (SELECT p, count(*) AS n FROM l GROUP BY p),
  t AS (SELECT x.p AS a, y.p AS b, count(*) AS n_ab FROM l x JOIN l y ON x.c = y.c AND x.p < y.p GROUP BY 1, 2)
"""

_FOLDED = r"lower(replace(upper(regexp_replace(title, '[\s\p{P}\p{Z}\p{Cc}\p{Cf}]+', '', 'g')), 'ẞ', 'SS'))"

_PAPERS = f"""
  WITH p AS (SELECT DISTINCT id, {_FOLDED} AS form, coalesce(publication_year, -9999999) AS y
             FROM paper WHERE title IS NOT NULL),
  w AS (SELECT * FROM p WHERE form <> '' AND form NOT IN ({", ".join(f"'{x}'" for x in PLACEHOLDERS)}))
"""

_SPACES = r"[\s\p{P}\p{Z}\p{Cc}\p{Cf}]+"


def _fold(value: str) -> str:
    return f"lower(replace(upper(regexp_replace({value}, '{_SPACES}', '', 'g')), 'ẞ', 'SS'))"


def _listed(name: str) -> str:
    """A field of a delimited payload, from its name to the separator before another field, or the end."""
    any_name = r"(?:display[\s_-]*name|publication[\s_-]*year|venue)"
    pattern = rf"(?is)(?:^|[;|\t\r\n]\s*){name}\s*[:=](.*?)(?:[;|\t\r\n]+\s*{any_name}\s*[:=]|$)"
    return f"regexp_extract(payload, '{pattern}', 1)"


def _object(name: str) -> str:
    """A field of a JSON payload; the last of several spellings of its name."""
    own = f"list_filter(json_keys(payload), lambda k: regexp_full_match(k, '(?is)\\s*{name}\\s*'))"
    return f"json_extract_string(payload, '$.\"' || list_extract({own}, -1) || '\"')"


_NAMES = (r"display[\s_-]*name", r"publication[\s_-]*year", "venue")
_RECORDS = f"""
  j AS (SELECT record_id, payload, regexp_full_match(payload, '(?s)\\s*\\{{.*') AS object FROM raw_record WHERE payload IS NOT NULL),
  f AS (
    SELECT record_id, object, {
        ", ".join(f"coalesce({_fold(
            f'CASE WHEN object THEN {_object(n)} ELSE {_listed(n)} END',
        )}, '') AS f{i}" for i, n in enumerate(_NAMES))
    },
           {
               " + ".join(
                   f"(regexp_matches(payload, '(?is)(?:^|[;|{chr(92)}t{chr(92)}r{chr(92)}n]{chr(92)}s*){n}{chr(92)}s*[:=]'))::INTEGER" for n in _NAMES
               )
           } AS named
    FROM j WHERE NOT object OR json_valid(payload)),
  rec AS (SELECT DISTINCT record_id, f0, f1, f2 FROM f WHERE object OR named >= 2)
"""

_GROUPS = """
  WITH RECURSIVE k AS (
    SELECT DISTINCT scheme, normalized_value AS v, paper_id AS id FROM paper_identifier
    WHERE normalized_value IS NOT NULL AND trim(normalized_value) <> '' AND paper_id IN (SELECT id FROM paper)),
  links AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON a.scheme = b.scheme AND a.v = b.v AND a.id <> b.id),
  reach(id, other) AS (SELECT x, x FROM links UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.other),
  g AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
"""
_BARRED = ", ".join(f"'{x}'" for x in PLACEHOLDERS)

_BEST = f"""
  {_GROUPS},
  p AS (
    SELECT group_id, paper.id, created_at, publication_year, CASE WHEN {_FOLDED} NOT IN ('', {_BARRED}) THEN {_FOLDED} END AS form
    FROM g JOIN paper ON paper.id = g.id),
  q AS (
    SELECT *, form IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM p o WHERE o.group_id = p.group_id AND o.form <> p.form AND starts_with(o.form, p.form)) AS complete FROM p),
  best AS (
    SELECT group_id, count(*) AS members, arg_max(id, created_at) FILTER (complete) AS title_id,
           arg_max(id, created_at) FILTER (publication_year BETWEEN 1800 AND 2026) AS year_id
    FROM q GROUP BY group_id)
"""

SQL = {
    "p1_found": f"""
      {_LISTS}
      SELECT a AS paper_a, b AS paper_b FROM t JOIN m ma ON ma.p = a JOIN m mb ON mb.p = b, total
      WHERE n_ab >= 6 AND n_ab * total.n >= 4 * ma.n * mb.n
    """,
    "p1_pairs": f"""
      {_LISTS}
      SELECT a, b, n_ab, ma.n AS n_a, mb.n AS n_b, total.n AS baskets,
             n_ab * total.n::DOUBLE / (ma.n::DOUBLE * mb.n) AS lift,
             log2(n_ab * total.n::DOUBLE / (ma.n::DOUBLE * mb.n)) AS pmi
      FROM t JOIN m ma ON ma.p = a JOIN m mb ON mb.p = b, total
    """,
    "p5_found": """
      WITH e AS (
        SELECT DISTINCT citing_paper_id AS c, cited_paper_id AS p FROM citation
        WHERE citing_paper_id IS NOT NULL AND cited_paper_id IS NOT NULL AND citing_paper_id <> cited_paper_id),
      s AS (SELECT c, count(*) AS n FROM e GROUP BY c HAVING count(*) >= 5),
      l AS (SELECT e.c, e.p, s.n FROM e JOIN s ON e.c = s.c),
      t AS (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb, count(*) AS k
            FROM l x JOIN l y ON x.p = y.p AND x.c < y.c GROUP BY 1, 2, 3, 4)
      SELECT a AS paper_a, b AS paper_b FROM t WHERE 10 * k >= 6 * (na + nb - k)
    """,
    "p2_papers": f"{_PAPERS} SELECT min(id) AS id, count(*) AS copies FROM w GROUP BY form, y",
    "p2_records": f"WITH {_RECORDS} SELECT min(record_id) AS id, count(*) AS copies FROM rec GROUP BY f0, f1, f2",
    "p2_found": f"""
      {_PAPERS}, {_RECORDS}
      SELECT 'paper' AS rel, a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.form = b.form AND a.y = b.y AND a.id < b.id
      UNION ALL
      SELECT 'raw_record', a.record_id, b.record_id FROM rec a JOIN rec b ON a.f0 = b.f0 AND a.f1 = b.f1 AND a.f2 = b.f2 AND a.record_id < b.record_id
    """,
    "p3_found": f"{_BEST} SELECT group_id, title_id, year_id FROM best",
    "p3_records": f"""
      {_BEST}
      SELECT group_id, members, t.title, y.publication_year
      FROM best LEFT JOIN paper t ON t.id = title_id LEFT JOIN paper y ON y.id = year_id
    """,
    "p5_lists": """
      WITH e AS (
        SELECT DISTINCT citing_paper_id AS c, cited_paper_id AS p FROM citation
        WHERE citing_paper_id IS NOT NULL AND cited_paper_id IS NOT NULL AND citing_paper_id <> cited_paper_id),
      s AS (SELECT c, count(*) AS n, string_agg(p, ' ' ORDER BY p) AS items FROM e GROUP BY c HAVING count(*) >= 5),
      cls AS (SELECT items, min(c) AS class_id, any_value(n) AS n FROM s GROUP BY items),
      l AS (SELECT class_id, cls.n, e.p FROM cls JOIN e ON e.c = cls.class_id),
      t AS (SELECT x.class_id AS a, y.class_id AS b, x.n AS na, y.n AS nb, count(*) AS k
            FROM l x JOIN l y ON x.p = y.p AND x.class_id <> y.class_id GROUP BY 1, 2, 3, 4),
      links AS (SELECT a, count(*) AS links FROM t WHERE 10 * k >= 6 * (na + nb - k) GROUP BY a)
      SELECT s.c AS basket, cls.class_id, coalesce(links.links, 0) AS links
      FROM s JOIN cls ON cls.items = s.items LEFT JOIN links ON links.a = cls.class_id
    """,
}
