"""Works as a provider reports them: reading, lookup, references, citations, search.

``works`` are rows of ``schema.WORK``. Lookups take many requests at once and answer them with joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.normalize import ARXIV_DOI, clean_title, normalize_arxiv, normalize_doi, normalize_openalex, strip_doi_prefix
from quillgraph.functions.text import strip
from quillgraph.operators.identity import normalized_identifiers

# The fields of a provider's record, and where it links an arXiv page.
RECORD = "id string, doi string, display_name string, publication_year bigint, locations array<struct<landing_page_url:string>>, referenced_works array<string>, cited_by_count bigint"
ARXIV_PAGE = r"(?i)\Ahttps?://(?:arxiv\.org/abs/|doi\.org/10\.48550/arxiv\.)(.+)\z"
ABSTRACT_PAGE = r"\A(https?)://arxiv\.org/abs/(.+)\z"
LOOKUP_ORDER = ("openalex", "doi", "arxiv")


def arxiv_of_work(doi: Column, urls: Column) -> Column:
    """A work's arXiv id. With a DOI, only arXiv's own gives one: the record may have merged a
    preprint and its published version. Without, the linked pages must agree on one id."""
    own = F.when(F.lower(doi).startswith(ARXIV_DOI), normalize_arxiv(F.substr(doi, F.lit(len(ARXIV_DOI) + 1))))
    linked = F.filter(
        F.transform(urls, lambda u: normalize_arxiv(F.nullif(F.regexp_extract(u, ARXIV_PAGE, 1), F.lit("")))),
        lambda v: v.isNotNull(),
    )
    distinct = F.array_distinct(linked)
    return F.when(doi.isNotNull(), own).when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def parse_works(records: DataFrame, payload: str = "payload", place: str | None = None) -> DataFrame:
    """Provider records (JSON) to works, each work once: the first by ``place``, if that column is given,
    which then stays. A record that cannot be read, or whose id is no work id, is left out; an invalid
    DOI, a blank title, and a year that is no JSON integer are NULL."""
    kept = [place] if place else []
    # A year of another JSON type than an integer does not fit its field, which is NULL then.
    rows = records.select(F.from_json(F.col(payload), RECORD).alias("r"), *kept).where("r IS NOT NULL")
    doi = strip_doi_prefix(strip(F.col("r.doi")))
    doi = F.when(normalize_doi(doi).isNotNull(), doi)
    urls = F.transform("r.locations", lambda x: x["landing_page_url"])
    year = F.col("r.publication_year")
    ident = lambda scheme, value: F.when(
        value.isNotNull(),
        F.struct(F.lit(scheme).alias("scheme"), value.alias("value")),
    )
    out = rows.select(
        normalize_openalex(F.col("r.id")).alias("work_id"),
        F.array_compact(
            F.array(
                ident("openalex", normalize_openalex(F.col("r.id"))),
                ident("doi", doi),
                ident("arxiv", arxiv_of_work(doi, urls)),
            ),
        ).alias("identifiers"),
        clean_title(F.col("r.display_name")).alias("title"),
        F.when(year.between(-(2**31), 2**31 - 1), year.cast("int")).alias("publication_year"),
        F.col("r.referenced_works").alias("referenced_works"),
        F.col("r.cited_by_count").alias("cited_by_count"),
        F.filter(F.array_distinct(urls), lambda u: u.rlike(ABSTRACT_PAGE)).alias("landing_pages"),
        *kept,
    ).where("work_id IS NOT NULL")
    if place is None:
        return out.dropDuplicates(["work_id"])
    columns = [c for c in out.columns if c != "work_id"]
    first = out.groupBy("work_id").agg(F.min_by(F.struct(*columns), place).alias("w"))
    return first.select("work_id", "w.*")


def with_keys(works: DataFrame) -> DataFrame:
    """``works`` with ``keys``: their identifiers, normalised, invalid ones dropped. Works that have
    their keys already stay as they are, so they are normalised once."""
    if "keys" in works.columns:
        return works
    return works.withColumn("keys", normalized_identifiers(F.col("identifiers")))


def _known(works: DataFrame) -> DataFrame:
    """(scheme, normalized_value, work_id): what a provider answers for one identifier.

    A work id or DOI gives the work that has it, the least if several do. An arXiv id is asked for by the
    page it is linked under, first as http, and as https only if no work links the former; several works
    under one page give none, for the provider would be guessing. Works without ``landing_pages`` link
    the http page of their arXiv identifier.
    """
    keyed = with_keys(works)
    offered = keyed.select("work_id", F.explode("keys").alias("k")).select("work_id", "k.scheme", "k.normalized_value")
    by_id = offered.where(F.col("scheme").isin("openalex", "doi"))
    one = by_id.groupBy("scheme", "normalized_value").agg(F.min("work_id").alias("work_id"))
    if "landing_pages" in works.columns:
        pages = keyed.select("work_id", F.explode("landing_pages").alias("page")).select(
            "work_id",
            F.regexp_extract("page", ABSTRACT_PAGE, 1).alias("way"),
            F.regexp_extract("page", ABSTRACT_PAGE, 2).alias("normalized_value"),
        )
    else:
        pages = offered.where("scheme = 'arxiv'").select("work_id", F.lit("http").alias("way"), "normalized_value")
    of = lambda way, how: how(F.when(F.col("way") == way, F.col("work_id")))
    # Whether one work or several link a page shows in its least and greatest work; none is collected.
    ends = pages.groupBy("normalized_value").agg(
        *[of(way, how).alias(f"{way}_{name}") for way in ("http", "https") for name, how in (("a", F.min), ("z", F.max))]
    )
    single = lambda way: F.when(F.col(f"{way}_a") == F.col(f"{way}_z"), F.col(f"{way}_a"))
    answer = F.when(F.col("http_a").isNotNull(), single("http")).otherwise(single("https"))
    arxiv = ends.select(F.lit("arxiv").alias("scheme"), "normalized_value", answer.alias("work_id"))
    return one.unionByName(arxiv.where("work_id IS NOT NULL"))


def lookup(requests: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """(key, work_id) of the work found for each request's normalised ``identifiers``.

    Of every scheme only the first identifier is asked for, in a fixed order of schemes; a miss falls
    through to the next scheme, never to another identifier of the same.
    """
    first = lambda scheme: F.try_element_at(F.filter("identifiers", lambda i: i["scheme"] == scheme), F.lit(1))
    firsts = [
        F.when(
            first(scheme).isNotNull(),
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(scheme).alias("scheme"),
                first(scheme)["normalized_value"].alias("normalized_value"),
            ),
        )
        for rank, scheme in enumerate(LOOKUP_ORDER)
    ]
    asked = requests.select(key, F.inline(F.array_compact(F.array(*firsts))))
    hits = asked.join(_known(works), ["scheme", "normalized_value"])
    return hits.groupBy(key).agg(F.min_by("work_id", "rank").alias("work_id"))


def fetch_references(of: DataFrame, works: DataFrame, limit: int) -> DataFrame:
    """(work_id, pos, other_id, identifiers, title, publication_year): the works that each of ``of``
    (work_id, referenced_works) refers to.

    The raw list is cut to ``limit`` first; then ids are normalised and repeated ones dropped, the
    first staying. ``pos`` is the place in the raw list, so the rows with a pos below a smaller limit are
    what that limit gives. A work the provider does not know is a stub with nothing but its id.
    """
    raw = of.select("work_id", F.posexplode(F.slice("referenced_works", 1, limit)).alias("pos", "raw"))
    each = raw.select(
        "work_id",
        "pos",
        normalize_openalex(F.col("raw")).alias("other_id"),
    ).where("other_id IS NOT NULL")
    first = each.groupBy("work_id", "other_id").agg(F.min("pos").alias("pos"))
    others = works.select(F.col("work_id").alias("other_id"), "identifiers", "title", "publication_year")
    stub = F.array(F.struct(F.lit("openalex").alias("scheme"), F.col("other_id").alias("value")))
    return first.join(others, "other_id", "left").select(
        "work_id", "pos", "other_id", F.coalesce("identifiers", stub).alias("identifiers"), "title", "publication_year"
    )


def work_edges(works: DataFrame) -> DataFrame:
    """(citing, cited) between works, each once."""
    each = works.select(F.col("work_id").alias("citing"), F.explode("referenced_works").alias("raw"))
    return each.select("citing", normalize_openalex(F.col("raw")).alias("cited")).where("cited IS NOT NULL").distinct()


def fetch_citations(of: DataFrame, works: DataFrame, limit: int, edges: DataFrame | None = None) -> DataFrame:
    """(work_id, pos, other_id): the first ``limit`` works that cite each of ``of`` (work_id), the most
    cited first, ties by id. Window ranks keep only the first rows of each partition before the shuffle.
    ``edges`` are the ``work_edges`` of the works, where they are at hand."""
    edges = work_edges(works) if edges is None else edges
    citing = edges.join(of.select(F.col("work_id").alias("cited")), "cited", "left_semi")
    counts = works.select(F.col("work_id").alias("citing"), F.coalesce("cited_by_count", F.lit(0)).alias("n"))
    order = Window.partitionBy("cited").orderBy(F.desc("n"), "citing")
    ranked = citing.join(counts, "citing").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return ranked.select(
        F.col("cited").alias("work_id"),
        (F.col("pos") - 1).alias("pos"),
        F.col("citing").alias("other_id"),
    )


def search(works: DataFrame, query: str, limit: int) -> DataFrame:
    """Works whose title has all words of ``query``, shorter titles first, ties by id; ``limit`` of them.

    A provider's own ranking is not specified; this order stands in for it.
    """
    rows = works.where(F.col("title").isNotNull())
    for word in query.lower().split():
        rows = rows.where(F.contains(F.lower("title"), F.lit(word)))
    return rows.orderBy(F.length("title"), "work_id").limit(limit)
