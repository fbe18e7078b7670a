"""Relations that the registered queries share, in Spark and in SQL.

The tables hold papers, identifiers, citations, sources and document copies. What a provider and a
file system would give is derived from them by fixed arithmetic, so both engines see the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.hints import KEYS
from quillgraph.operators.graph import raw_edges, stored_edges
from quillgraph.tables import table


def edges(s: SparkSession, d: str) -> DataFrame:
    return stored_edges(table(s, d, "citation"), table(s, d, "paper"))


EDGES = """
  e AS (SELECT DISTINCT citing_paper_id AS citing, cited_paper_id AS cited FROM citation
        WHERE citing_paper_id <> cited_paper_id
          AND citing_paper_id IN (SELECT id FROM paper) AND cited_paper_id IN (SELECT id FROM paper))
"""


def most_citing(s: SparkSession, d: str) -> DataFrame:
    """(id): the paper with the most references, ties by id."""
    counts = edges(s, d).groupBy(F.col("citing").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "id").limit(1).select("id")


SEED = "s AS (SELECT citing AS id FROM e GROUP BY citing ORDER BY count(*) DESC, citing LIMIT 1)"

# The stored citations are shallow: no paper that is cited cites another. So there is a deep graph as
# well: every order is a paper, and every line item a citation of the order that its keys add up to.


def _padded(key: Column | str) -> Column:
    return F.lpad((F.col(key) if isinstance(key, str) else key).cast("string"), 8, "0")


def deep_papers(s: SparkSession, d: str) -> DataFrame:
    """(id, title, created_at, library_added_at); the urgent ones are in the Library."""
    at = F.col("o_orderdate").cast("timestamp")
    return table(s, d, "orders").select(
        _padded("o_orderkey").alias("id"),
        F.lit(None).cast("string").alias("title"),
        at.alias("created_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", at).alias("library_added_at"),
    )


def _deep_lines(s: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, l_linenumber, to): the order that each line item cites."""
    orders = table(s, d, "orders").agg(F.count(F.lit(1))).scalar()
    to = F.col("l_partkey") * F.col("l_partkey") + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 1009
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (to % orders).alias("to"))


def deep_citations(s: SparkSession, d: str) -> DataFrame:
    """(citing_paper_id, cited_paper_id), some rows twice, some of a paper by itself."""
    return _deep_lines(s, d).select(_padded("l_orderkey").alias("citing_paper_id"), _padded("to").alias("cited_paper_id"))


def deep_edges(s: SparkSession, d: str) -> DataFrame:
    return stored_edges(deep_citations(s, d), deep_papers(s, d))


_PAD = "lpad(CAST({0} AS VARCHAR), 8, '0')"
_TO = "((l_partkey * l_partkey + l_suppkey * 13 + l_linenumber * 1009) % (SELECT count(*) FROM orders))"
DEEP = f"""
  dp AS (SELECT {_PAD.format("o_orderkey")} AS id, o_orderdate AS created_at, o_orderpriority = '1-URGENT' AS member FROM orders),
  line AS (SELECT * FROM (SELECT {_PAD.format("l_orderkey")} AS citing, {_PAD.format(_TO)} AS cited FROM lineitem) WHERE citing <> cited),
  e AS (SELECT DISTINCT * FROM line)
"""
DEEP_SEED = "s AS (SELECT {0} AS id FROM line GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


def deep_seed(s: SparkSession, d: str, end: str) -> DataFrame:
    """(id): the paper of the deep graph that is most often at an end, citing or cited, ties by id."""
    counts = raw_edges(deep_citations(s, d)).groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "id").limit(1).select("id")


def deep_works(s: SparkSession, d: str) -> DataFrame:
    """The deep graph as a provider's works. Each reference is listed twice, in two spellings; the
    second line of an order is listed under no work id; every tenth work is not known."""
    line = F.col("l_linenumber")
    link = F.concat(F.lit("W"), F.col("to").cast("string"))
    raw = F.array(
        F.when(line == 2, F.lit("A1")).otherwise(F.concat(F.lit("https://openalex.org/"), link)),
        F.when(line == 2, F.lit("")).otherwise(F.lower(link)),
    )
    lists = _deep_lines(s, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(line, "to", raw.alias("raw")))).alias("r"))
    listed = lists.select(F.col("l_orderkey").alias("o_orderkey"), F.flatten(F.transform("r", lambda r: r["raw"])).alias("referenced_works"))
    work = F.concat(F.lit("W"), F.col("o_orderkey").cast("string"))
    known = table(s, d, "orders").where("o_orderkey % 10 <> 7").join(listed, "o_orderkey", "left")
    return known.select(
        work.alias("work_id"),
        F.array(F.struct(F.lit("openalex").alias("scheme"), work.alias("value"))).alias("identifiers"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.year("o_orderdate").alias("publication_year"),
        "referenced_works",
        F.col("o_totalprice").cast("long").alias("cited_by_count"),
    )


DEEP_WORKS = f"""
  dw AS (SELECT 'W' || o_orderkey AS id, o_orderkey AS key, CAST(trunc(o_totalprice) AS BIGINT) AS count FROM orders WHERE o_orderkey % 10 <> 7),
  dl AS (
    SELECT 'W' || l_orderkey AS id, l_linenumber AS line, 'W' || {_TO} AS other,
           2 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_TO}) - 1) AS pos
    FROM lineitem WHERE l_orderkey % 10 <> 7),
  dr AS (SELECT id, other, min(pos) AS pos FROM dl WHERE line <> 2 GROUP BY 1, 2),
  dc AS (
    SELECT dr.other AS id, dr.id AS other, row_number() OVER (PARTITION BY dr.other ORDER BY dw.count DESC, dr.id) - 1 AS pos
    FROM dr JOIN dw ON dw.id = dr.id)
"""


def identifiers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "paper_identifier").where("normalized_value IS NOT NULL").select(
        "paper_id",
        "scheme",
        "normalized_value",
    ).distinct()


def works(s: SparkSession, d: str) -> DataFrame:
    """Works of a provider that knows the stored papers by their work ids, imperfectly.

    A work reports its paper's least DOI; every 7th has another work id than is stored; every 13th also
    reports the DOI of the first paper that its own cites; every 17th reports nothing but an invalid DOI;
    every 19th no work id. It has its paper's title and year, or, for every 2nd, some where that has none.
    It is linked to the page of its paper's least arXiv id, by http, https or both,
    and every 5th also to that of the cited paper's, but reports no arXiv id.
    """
    keys = identifiers(s, d)
    own = keys.where("scheme = 'openalex'").groupBy(
        F.col("normalized_value").alias("w"),
    ).agg(F.min("paper_id").alias("paper_id"))
    least = lambda scheme: F.min(F.when(F.col("scheme") == scheme, F.col("normalized_value"))).alias(scheme)
    ids = keys.groupBy("paper_id").agg(least("doi"), least("arxiv"))
    cites = edges(s, d).groupBy(F.col("citing").alias("paper_id")).agg(F.min("cited").alias("other"))
    other = ids.select(F.col("paper_id").alias("other"), F.col("doi").alias("other_doi"), F.col("arxiv").alias("other_arxiv"))
    paper = table(s, d, "paper").select(F.col("id").alias("paper_id"), "title", "publication_year")
    rows = own.join(paper, "paper_id").join(ids, "paper_id", "left")
    rows = rows.join(cites, "paper_id", "left").join(other, "other", "left")
    n = F.substring("w", 2, 20).cast("long")
    rows = rows.withColumn("n", n).withColumn(
        "work_id",
        F.when(n % 7 == 0, F.concat(F.lit("W"), (n + 500_000_000_000).cast("string"))).otherwise(F.col("w")),
    )
    ident = lambda on, scheme, value: F.when(
        on & value.isNotNull(),
        F.struct(F.lit(scheme).alias("scheme"), value.alias("value")),
    )
    good = F.col("n") % 17 != 0
    parts = [
        ident(good & (F.col("n") % 19 != 0), "openalex", F.concat(F.lit("https://openalex.org/"), "work_id")),
        ident(good, "DOI", F.concat(F.lit("https://doi.org/"), F.upper("doi"))),
        ident(good & (F.col("n") % 13 == 0), "doi", F.concat(F.lit(" doi:"), "other_doi")),
        ident(~good, "doi", F.lit("not a doi")),
    ]
    page = lambda on, way, of: F.when(on, F.concat(F.lit(f"{way}://arxiv.org/abs/"), of))
    pages = [
        page(F.col("n") % 3 != 1, "http", "arxiv"),
        page(F.col("n") % 3 != 0, "https", "arxiv"),
        page(F.col("n") % 5 == 0, "http", "other_arxiv"),
    ]
    return rows.select(
        "work_id",
        F.array_compact(F.array(*parts)).alias("identifiers"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.when(F.col("n") % 2 == 0, F.concat(F.lit("Work "), "w"))).alias("title"),
        F.coalesce("publication_year", F.when(F.col("n") % 2 == 0, F.lit(1990) + (F.col("n") % 30).cast("int"))).alias("publication_year"),
        F.array_distinct(F.array_compact(F.array(*pages))).alias("landing_pages"),
    )


def requests(s: SparkSession, d: str, known: DataFrame) -> DataFrame:
    """(request, identifiers): one request per paper, for its identifiers, and one per work of ``known``,
    for its keys; the least first, behind a DOI that nobody has where the request begins with 0 to 3, and
    before a scheme that no provider knows."""
    key = lambda scheme, v: F.struct(scheme.alias("scheme"), v.alias("value"), v.alias("normalized_value"))
    held = identifiers(s, d).where("paper_id IS NOT NULL").groupBy(F.col("paper_id").alias("request")).agg(
        F.sort_array(F.collect_list(key(F.col("scheme"), F.col("normalized_value")))).alias("own"),
    )
    of_works = known.where(F.size("keys") > 0).select(
        F.concat(F.lit("w:"), "work_id").alias("request"),
        F.sort_array(F.transform("keys", lambda k: key(k["scheme"], k["normalized_value"]))).alias("own"),
    )
    held = held.unionByName(of_works)
    stranger = F.array(key(F.lit("doi"), F.lit("10.0/nobody")))
    before = F.when(F.substring("request", 1, 1) < "4", stranger).otherwise(F.array().cast(KEYS))
    return held.select("request", F.concat(before, "own", F.array(key(F.lit("shelf"), F.lit("7")))).alias("identifiers"))


WORKS = f"""
  {EDGES},
  i AS (SELECT DISTINCT paper_id, scheme, normalized_value AS v FROM paper_identifier WHERE normalized_value IS NOT NULL),
  own AS (SELECT v AS w, min(paper_id) AS paper_id FROM i WHERE scheme = 'openalex' GROUP BY v),
  ids AS (SELECT paper_id, min(v) FILTER (scheme = 'doi') AS doi, min(v) FILTER (scheme = 'arxiv') AS arxiv FROM i GROUP BY paper_id),
  cites AS (SELECT citing AS paper_id, min(cited) AS other FROM e GROUP BY citing),
  work AS (
    SELECT CASE WHEN n % 7 = 0 THEN 'W' || (n + 500000000000) ELSE w END AS work_id, * EXCLUDE (w) FROM (
      SELECT w, CAST(substr(w, 2) AS BIGINT) AS n, p.id AS paper_id, coalesce(nullif(trim(p.title, ' '), ''), CASE WHEN CAST(substr(w, 2) AS BIGINT) % 2 = 0 THEN 'Work ' || w END) AS title,
             coalesce(p.publication_year, CASE WHEN CAST(substr(w, 2) AS BIGINT) % 2 = 0 THEN CAST(1990 + CAST(substr(w, 2) AS BIGINT) % 30 AS INTEGER) END) AS publication_year,
             a.doi, a.arxiv, b.doi AS other_doi, b.arxiv AS other_arxiv
      FROM own JOIN paper p ON p.id = own.paper_id LEFT JOIN ids a ON a.paper_id = p.id
      LEFT JOIN cites c ON c.paper_id = p.id LEFT JOIN ids b ON b.paper_id = c.other)),
  k AS (
    SELECT DISTINCT work_id, scheme, v FROM (
      SELECT work_id, 'openalex' AS scheme, work_id AS v FROM work WHERE n % 17 <> 0 AND n % 19 <> 0
      UNION ALL SELECT work_id, 'doi', lower(doi) FROM work WHERE n % 17 <> 0 AND doi IS NOT NULL
      UNION ALL SELECT work_id, 'doi', other_doi FROM work WHERE n % 17 <> 0 AND n % 13 = 0 AND other_doi IS NOT NULL)),
  r AS (
    SELECT work.work_id, count(k.v) AS n_keys, count(DISTINCT i.paper_id) AS n_papers, min(i.paper_id) AS held_by,
           coalesce(string_agg(DISTINCT i.paper_id, ' ' ORDER BY i.paper_id), '') AS candidates,
           count(DISTINCT CASE WHEN i.paper_id IS NULL THEN k.scheme || ':' || k.v END) AS unassigned,
           coalesce(string_agg(DISTINCT CASE WHEN i.paper_id IS NULL THEN k.scheme || ':' || k.v END, ' '
                               ORDER BY CASE WHEN i.paper_id IS NULL THEN k.scheme || ':' || k.v END), '') AS free
    FROM work LEFT JOIN k ON k.work_id = work.work_id LEFT JOIN i ON i.scheme = k.scheme AND i.v = k.v
    GROUP BY work.work_id)
"""

# What the provider answers for one identifier: by work id and DOI the least work, by arXiv id the one
# work under the http page, or, where there is none, the one under the https page.
ANSWERS = """
  page AS (
    SELECT work_id, 'http' AS way, arxiv AS v FROM work WHERE n % 3 <> 1 AND arxiv IS NOT NULL
    UNION SELECT work_id, 'https', arxiv FROM work WHERE n % 3 <> 0 AND arxiv IS NOT NULL
    UNION SELECT work_id, 'http', other_arxiv FROM work WHERE n % 5 = 0 AND other_arxiv IS NOT NULL),
  asked_page AS (SELECT v, min(way) AS way FROM page GROUP BY v),
  one_page AS (
    SELECT page.v, min(work_id) AS work_id FROM page JOIN asked_page USING (v, way) GROUP BY page.v HAVING count(DISTINCT work_id) = 1),
  answer AS (
    SELECT scheme, v, min(work_id) AS work_id FROM k WHERE scheme IN ('openalex', 'doi') GROUP BY 1, 2
    UNION ALL SELECT 'arxiv', v, work_id FROM one_page)
"""

REQUESTS = """
  own_req AS (
    SELECT paper_id AS request, scheme, v FROM i WHERE paper_id IS NOT NULL
    UNION ALL SELECT 'w:' || work_id, scheme, v FROM k),
  req AS (
    SELECT *, 1 AS turn FROM own_req
    UNION ALL SELECT DISTINCT request, 'doi', '10.0/nobody', 0 FROM own_req WHERE substr(request, 1, 1) < '4'
    UNION ALL SELECT DISTINCT request, 'shelf', '7', 2 FROM own_req),
  first_of AS (SELECT request, scheme, arg_min(v, turn || v) AS v FROM req GROUP BY 1, 2),
  hit AS (
    SELECT request, arg_min(work_id, CASE f.scheme WHEN 'openalex' THEN 1 WHEN 'doi' THEN 2 ELSE 3 END) AS work_id
    FROM first_of f JOIN answer a ON a.scheme = f.scheme AND a.v = f.v GROUP BY 1)
"""


def copies(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_copy").distinct()


def listing(s: SparkSession, d: str) -> DataFrame:
    """Files found by a scan after the copies were stored: by the first digit of a hash of the path,
    some have vanished, some have grown, and some have a new file beside them."""
    known = copies(s, d).select("normalized_path", "file_size", "file_mtime_ns").distinct()
    digit = F.substring(F.md5("normalized_path"), 1, 1)
    rest = known.where(digit != "0").select(
        "normalized_path", (
            F.coalesce("file_size", F.lit(1)) + F.when(digit == "1", 1).otherwise(0)
        ).alias("file_size"), F.coalesce("file_mtime_ns", F.lit(1)).alias("file_mtime_ns")
    )
    new = known.where(digit == "2").select(
        F.concat("normalized_path", F.lit(".new.pdf")).alias("normalized_path"),
        F.lit(1000).cast("long").alias("file_size"),
        F.lit(1).cast("long").alias("file_mtime_ns"),
    )
    return rest.unionByName(new).withColumn("readable", F.lit(True))


def sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scan_source").select(
        "id",
        "normalized_path",
        F.col("last_scanned_at").isNotNull().alias("available"),
    )


SCAN = """
  c AS (SELECT DISTINCT * FROM document_copy),
  f AS (
    SELECT normalized_path AS p, coalesce(file_size, 1) + CASE WHEN md5(normalized_path)[1] = '1' THEN 1 ELSE 0 END AS size,
           coalesce(file_mtime_ns, 1) AS t
    FROM c WHERE md5(normalized_path)[1] <> '0'
    UNION ALL SELECT normalized_path || '.new.pdf', 1000, 1 FROM c WHERE md5(normalized_path)[1] = '2'),
  src AS (SELECT id, normalized_path AS root, last_scanned_at IS NOT NULL AS available FROM scan_source),
  b AS (
    SELECT coalesce(f.p, c.normalized_path) AS p, c.id, c.content_hash, c.file_size, c.file_mtime_ns, c.missing_since, f.p AS fp, f.size, f.t
    FROM f FULL JOIN c ON c.normalized_path = f.p),
  w AS (
    SELECT b.p, min(src.root) AS root FROM b JOIN src ON src.available AND starts_with(b.p, rtrim(src.root, '/') || '/') GROUP BY b.p),
  diff AS (
    SELECT b.p AS normalized_path, b.id AS document_id, src.id AS source_id,
           CASE WHEN fp IS NULL THEN CASE WHEN missing_since IS NULL THEN 'missing' ELSE 'gone' END
                WHEN b.id IS NULL THEN 'new'
                WHEN content_hash IS NULL OR NOT coalesce(file_size = size AND file_mtime_ns = t, false) THEN 'changed'
                ELSE 'same' END AS state,
           fp IS NOT NULL AND missing_since IS NOT NULL AS reappeared
    FROM b JOIN w ON w.p = b.p JOIN src ON src.root = w.root)
"""
