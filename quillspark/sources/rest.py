"""A paginated REST API as a batch source: cursor pages, rate limit and retries in one partition.

A cursor is serial, so the source has one partition; Spark's task retry starts it anew. The HTTP
call is a parameter, so the source is tested without a network.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of at most so many records, requests a second, attempts and the base of the waits.
MOST_A_PAGE, A_SECOND, ATTEMPTS, FACTOR = 200, 5.0, 5, 2.0


class HttpError(RuntimeError):
    def __init__(self, status: int, message: str = ""):
        super().__init__(f"HTTP {status} {message}")
        self.status = status


def http_get(url: str, timeout: float = 30.0) -> dict:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, str(e.reason)) from e


class RestClient:
    """Gets JSON with a least gap between requests; 429 and 5xx are tried again, other 4xx are not."""

    def __init__(self, base: str, get: Callable[[str], dict] = http_get, per_second: float = A_SECOND, attempts: int = ATTEMPTS, factor: float = FACTOR, sleep: Callable[[float], None] = time.sleep):
        self.base, self.call, self.gap, self.attempts, self.factor, self.sleep = base.rstrip("/"), get, 1.0 / per_second, attempts, factor, sleep
        self.last = float("-inf")

    def get(self, endpoint: str, params: dict) -> dict:
        url = f"{self.base}/{endpoint.lstrip('/')}?{urllib.parse.urlencode(params)}"
        for attempt in range(self.attempts):
            wait = self.last + self.gap - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            try:
                return self.call(url)
            except HttpError as e:
                if e.status != 429 and e.status < 500:
                    raise
                error = e
            except OSError as e:
                error = e
            if attempt + 1 < self.attempts:
                self.sleep(self.factor**attempt + random.uniform(0.1, 0.5))
        raise RuntimeError(f"gave up after {self.attempts} attempts: {error}")

    def pages(self, endpoint: str, params: dict, most: int | None = None, per_page: int = 100) -> Iterator[dict]:
        """Records of all pages until an empty page, no cursor or ``most`` records."""
        cursor, given = "*", 0
        while cursor and (most is None or given < most):
            page = self.get(endpoint, params | {"per-page": min(per_page, MOST_A_PAGE), "cursor": cursor})
            records = page.get("results") or []
            if not records:
                return
            for record in records:
                if most is not None and given >= most:
                    return
                given += 1
                yield record
            cursor = (page.get("meta") or {}).get("next_cursor")


class RestSource(DataSource):
    """``spark.read.format("rest_pages")`` with options base, endpoint, filter, max_records, per_page.

    One column, ``record``: the JSON text of a record, for ``from_json`` with an explicit schema.
    """

    client: Callable[[str], RestClient] = RestClient

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(dict(self.options), type(self).client)


class RestReader(DataSourceReader):
    def __init__(self, options: dict, client: Callable[[str], RestClient]):
        self.options, self.client = options, client

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        o = self.options
        params = {"filter": o["filter"]} if o.get("filter") else {}
        most = int(o["max_records"]) if o.get("max_records") else None
        for record in self.client(o["base"]).pages(o["endpoint"], params, most, int(o.get("per_page", 100))):
            yield (json.dumps(record, ensure_ascii=False),)
