"""Works from a provider: a table of works, or a web service behind a transport.

A transport is a callable from URL to a parsed JSON object, None meaning that there is no such thing. The
library itself needs only the methods of ``Provider``.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.errors import ProviderError
from quillgraph.operators import works as W
from quillgraph.operators.expand import Near, Work, offline_neighbours
from quillgraph.operators.identity import normalized_identifiers

# Fixed values of the web service: batch, page, retries, waiting times in seconds, fields asked for.
BATCH, PAGE, RETRIES, FIRST_WAIT, LONGEST_WAIT, TIMEOUT = 50, 200, 3, 1.0, 30.0, 30
FIELDS = "id,doi,display_name,publication_year,locations"
HEADERS = {"User-Agent": "quillgraph", "Accept": "application/json"}

Transport = Callable[[str], Any]


class Provider(Protocol):
    def lookup_work(self, identifiers: list[tuple[str, str]]) -> Work | None: ...
    def neighbours(self, level: list[Work], ways: list[bool], limit: int) -> Near: ...
    def search_works(self, query: str, limit: int) -> list[Work]: ...


def _driver_works(rows: DataFrame) -> list[Work]:
    keyed = rows.withColumn("keys", normalized_identifiers(F.col("identifiers")))
    return [
        Work(r.work_id, [tuple(k) for k in r["keys"]], r.title, r.publication_year) for r in keyed.select(
            "work_id",
            F.transform("keys", lambda k: F.struct(k["scheme"], k["value"], k["normalized_value"])).alias("keys"),
            "title",
            "publication_year",
        ).collect()
    ]


class TableProvider:
    """A provider that knows the works of a table."""

    def __init__(self, works: DataFrame):
        self._works = works
        self.neighbours = offline_neighbours(works)

    def works(self) -> DataFrame:
        return self._works

    def lookup_work(self, identifiers: list[tuple[str, str]]) -> Work | None:
        spark = self._works.sparkSession
        asked = spark.createDataFrame(
            [("x", identifiers)],
            "request string, identifiers array<struct<scheme:string,value:string>>",
        )
        asked = asked.withColumn("identifiers", normalized_identifiers(F.col("identifiers")))
        hit = W.lookup(asked, self._works, "request").select("work_id")
        found = _driver_works(self._works.join(F.broadcast(hit), "work_id", "left_semi"))  # one row
        return found[0] if found else None

    def search_works(self, query: str, limit: int) -> list[Work]:
        return _driver_works(W.search(self._works, query, limit))


class WebProvider:
    """A provider behind a transport. Records are read by the same rules as those of a table
    (``operators.works.parse_works``); answers that are not of the expected form count as none."""

    def __init__(self, spark: SparkSession, base: str, transport: Transport):
        self.spark, self.base, self.get = spark, base.rstrip("/"), transport

    def _ask(self, path: str, **query: str) -> dict:
        asked = urllib.parse.urlencode(query, safe=":|,")
        answer = self.get(f"{self.base}{path}?{asked}")
        return answer if isinstance(answer, dict) else {}

    def _read(self, records: object) -> list[Work]:
        """Works of a list of records, in its order, each once."""
        rows = [(k, json.dumps(r)) for k, r in enumerate(records if isinstance(records, list) else []) if isinstance(r, dict)]
        if not rows:
            return []
        parsed = W.parse_works(self.spark.createDataFrame(rows, "place int, payload string"), place="place")
        return _driver_works(parsed.orderBy("place"))

    def _normal(self, raw: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """(scheme, normal form) of identifiers, invalid ones dropped, each once."""
        row = self.spark.createDataFrame([(raw,)], "i array<struct<scheme:string,value:string>>")
        keys = row.select(normalized_identifiers(F.col("i"))).first()[0]
        return [(k.scheme, k.normalized_value) for k in keys]

    def lookup_work(self, identifiers: list[tuple[str, str]]) -> Work | None:
        """By the first identifier of each scheme; see ``operators.works.lookup``."""
        firsts: dict[str, str] = {}
        for scheme, value in self._normal(list(identifiers)) if identifiers else []:
            firsts.setdefault(scheme, value)
        for scheme in W.LOOKUP_ORDER:
            found = self._one(scheme, firsts[scheme]) if scheme in firsts else None
            if found:
                return found
        return None

    def _one(self, scheme: str, value: str) -> Work | None:
        if scheme != "arxiv":
            path = value if scheme == "openalex" else "doi:" + urllib.parse.quote(value, safe="/:")
            found = self._read([self._ask(f"/works/{path}", select=FIELDS)])
            return found[0] if found else None
        for way in ("http", "https"):
            page = f"locations.landing_page_url:{way}://arxiv.org/abs/{value}"
            records = self._ask("/works", filter=page, per_page="2", select=FIELDS).get("results")
            if isinstance(records, list) and records:
                found = self._read(records[:1])
                return found[0] if found and len(records) == 1 else None
        return None

    def _id(self, work: Work) -> str | None:
        own = next((normal for scheme, _, normal in work.keys if scheme == "openalex"), None)
        if own is None and (known := self.lookup_work([(s, n) for s, _, n in work.keys])):
            return known.work_id
        return own

    def fetch_references(self, work: Work, limit: int) -> list[Work]:
        """The first ``limit`` of the list as given, made normal and distinct; unknown ones are stubs."""
        own = self._id(work) if limit > 0 else None
        listed = self._ask(f"/works/{own}", select=f"{FIELDS},referenced_works").get("referenced_works") if own else None
        raw = [("openalex", r) for r in (listed if isinstance(listed, list) else [])[:limit] if isinstance(r, str)]
        ids = [normal for _, normal in self._normal(raw)] if raw else []
        known: dict[str, Work] = {}
        for k in range(0, len(ids), BATCH):
            some = "openalex_id:" + "|".join(ids[k : k + BATCH])
            records = self._ask("/works", filter=some, per_page=str(BATCH), select=FIELDS).get("results")
            for found in self._read(records):
                known.setdefault(found.work_id, found)
        return [known.get(i) or Work(i, [("openalex", i, i)]) for i in ids]

    def fetch_citations(self, work: Work, limit: int) -> list[Work]:
        """Page after page, the most cited first, until there are ``limit`` different works or no more."""
        own = self._id(work) if limit > 0 else None
        found: dict[str, Work] = {}
        cursor = "*" if own else None
        while cursor and len(found) < limit:
            answer = self._ask(
                "/works",
                filter=f"cites:{own}",
                sort="cited_by_count:desc",
                per_page=str(min(limit, PAGE)),
                cursor=cursor,
                select=FIELDS,
            )
            page, about = answer.get("results"), answer.get("meta")
            for other in self._read(page):
                found.setdefault(other.work_id, other)
            following = about.get("next_cursor") if isinstance(about, dict) else None
            cursor = following if page and isinstance(page, list) and isinstance(following, str) else None
        return list(found.values())[:limit]

    def neighbours(self, level: list[Work], ways: list[bool], limit: int) -> Near:
        """Each step asks the service for its own share and no more."""
        return lambda work, outgoing, share: (self.fetch_references if outgoing else self.fetch_citations)(work, share)

    def search_works(self, query: str, limit: int) -> list[Work]:
        if limit <= 0 or not query.strip():
            return []
        answer = self._ask("/works", search=query, per_page=str(min(limit, PAGE)), select=FIELDS)
        return self._read(answer.get("results"))[:limit]


def http_transport(
    api_key: str | None = None,
    opener: Callable = urllib.request.urlopen,
    sleep: Callable = time.sleep,
) -> Transport:
    """The JSON object of a URL. 404 is None; 429 and 5xx are tried again, waiting 1, 2, 4 seconds or as
    long as the service says, up to a limit; anything else, also an answer that breaks off or is no
    object, is a ``ProviderError`` that does not show the key."""

    def refused(url: str, why: str) -> ProviderError:
        text = f"{why} for {url}"
        for secret in filter(None, (api_key, api_key and urllib.parse.quote_plus(api_key))):
            text = text.replace(secret, "***")
        return ProviderError(text)

    def seconds(said: str | None, usual: float) -> float:
        try:
            wait = float(said) if said is not None else -1.0
        except ValueError:
            wait = -1.0
        return min(wait, LONGEST_WAIT) if wait >= 0 else usual

    def get(url: str) -> Any:
        if api_key:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode({"api_key": api_key})
        for attempt in range(RETRIES + 1):
            try:
                with opener(urllib.request.Request(url, headers=HEADERS), timeout=TIMEOUT) as answer:
                    value = json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code != 429 and not 500 <= e.code < 600 or attempt == RETRIES:
                    raise refused(url, f"HTTP {e.code}") from None
                sleep(seconds((e.headers or {}).get("Retry-After"), FIRST_WAIT * 2**attempt))
            except (OSError, ValueError, http.client.HTTPException) as e:
                raise refused(url, f"{type(e).__name__} ({e})") from None
            else:
                if not isinstance(value, dict):
                    raise refused(url, "an answer that is no object")
                return value
        raise refused(url, "no answer")

    return get


class _Range(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class WorksSource(DataSource):
    """``spark.read.format("works").option("base", URL).option("ids", "W1,W2,...")``: works by id, in
    batches, one partition per batch. The option ``transport`` names a callable as module:function, and
    ``key`` the service's key."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> DataSourceReader:
        return _WorksReader(self.options)


class _WorksReader(DataSourceReader):
    def __init__(self, options):
        self.base = options["base"].rstrip("/")
        self.ids = [i for i in options.get("ids", "").split(",") if i]
        self.where, self.key = options.get("transport"), options.get("key")

    def partitions(self) -> list[_Range]:
        return [_Range(self.ids[k : k + BATCH]) for k in range(0, len(self.ids), BATCH)] or [_Range([])]

    def read(self, partition: _Range):
        if not partition.ids:
            return
        if self.where:
            import importlib

            module, function = self.where.split(":")
            get = getattr(importlib.import_module(module), function)
        else:
            get = http_transport(self.key)
        asked = {"filter": "openalex_id:" + "|".join(partition.ids), "per_page": BATCH, "select": f"{FIELDS},referenced_works,cited_by_count"}
        for record in (get(f"{self.base}/works?{urllib.parse.urlencode(asked, safe=':|,')}") or {}).get("results", []):
            yield (json.dumps(record),)


def read_works(
    spark: SparkSession,
    base: str,
    ids: list[str],
    transport: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Works by id from a web service, as a table of works."""
    spark.dataSource.register(WorksSource)
    reader = spark.read.format("works").option("base", base).option("ids", ",".join(ids))
    for name, value in (("transport", transport), ("key", key)):
        reader = reader.option(name, value) if value else reader
    return W.parse_works(reader.load())
