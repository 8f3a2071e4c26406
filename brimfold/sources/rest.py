"""A paged REST source as a Spark data source, with retries inside the reader.

``spark.dataSource.register(PagedRest)``, then ``spark.read.format("paged_rest").option("urls", json_list).load()`` gives
(ord, url, page, status, body, error, error_kind) in the order of the list; a request that fails for good is a row with an
error, so other addresses go on. Options: ``workers`` (how many addresses are read at a time; 0, the default: each for
itself), ``max_pages`` (1), ``page_param`` (the parameter that numbers pages), ``delay`` (seconds between pages), ``data`` (the list
whose being empty ends the paging), ``attempts``, ``timeout``, ``pause``, ``agent``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Statuses worth another try.
AGAIN = frozenset({408, 429, 500, 502, 503, 504})


class _Urls(InputPartition):
    def __init__(self, urls: list[tuple[int, str]]):
        self.urls = urls


def with_page(url: str, name: str, page: int) -> str:
    """The address with this number of the page, whatever number it had."""
    parts = urlsplit(url)
    query = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k != name]
    return urlunsplit(parts._replace(query=urlencode([*query, (name, page)])))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.workers = int(options.get("workers", "0"))
        self.most, self.param, self.delay, self.data = int(options.get("max_pages", "1")), options.get("page_param", ""), float(options.get("delay", "0.35")), options.get("data", "data")
        self.attempts = max(1, int(options.get("attempts", "3")))
        self.timeout = float(options.get("timeout", "8"))
        self.pause = float(options.get("pause", "0.5"))
        self.agent = options.get("agent", "brimfold")

    def partitions(self) -> list[InputPartition]:
        numbered = list(enumerate(self.urls))
        n = min(len(numbered), self.workers) if self.workers > 0 else len(numbered)
        return [_Urls(numbered[k::n]) for k in range(n)]

    def _get(self, url: str) -> tuple:
        """(status, body, error, kind) of one address."""
        status, error, kind = None, "", ""
        for attempt in range(self.attempts):
            try:
                with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:
                    return getattr(answer, "status", 200), answer.read().decode("utf-8", "replace"), "", ""
            except HTTPError as e:
                status, error, kind = e.code, f"HTTP {e.code}: {e.reason}", type(e).__name__
                if e.code not in AGAIN:
                    break
                wait = e.headers.get("Retry-After") if e.headers else None
                time.sleep(float(wait) if wait and wait.isdigit() else self.pause * 2**attempt)
            except OSError as e:  # no answer, or too late
                status, error, kind = None, " ".join(str(e).split()), type(e).__name__
                time.sleep(self.pause * 2**attempt)
        return status, None, error[:300], kind

    def _next(self, url: str, body: str, page: int) -> str | None:
        """Where the following page is, if this one has rows and names one."""
        try:
            document = json.loads(body)
        except ValueError:
            return None
        link = (document.get("links") or {}).get("next") if isinstance(document, dict) else None
        if not link or not document.get(self.data):
            return None
        return with_page(url, self.param, page + 1) if self.param else urljoin(url, link) if isinstance(link, str) else None

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for at, url in partition.urls:
            here, page = with_page(url, self.param, 1) if self.param else url, 1
            while here:
                status, body, error, kind = self._get(here)
                yield at, here, page, status, body, error, kind
                here = self._next(here, body, page) if body is not None and page < self.most else None
                page += 1
                if here and self.delay:
                    time.sleep(self.delay)


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "ord int, url string, page int, status int, body string, error string, error_kind string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """The answers of these addresses. Read it once, from a written table: each reading asks the provider again."""
    spark.dataSource.register(PagedRest)
    reader = spark.read.format("paged_rest").option("urls", json.dumps(urls))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
