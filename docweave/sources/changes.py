"""A paginated resource that grows, as a source for streams and batches.

The resource lists its results in the order they came, by ``start`` and ``limit``. A stream's offset is, for each URL, how
many results have been read, so a restart goes on where the checkpoint says and each result comes once. The driver only
counts; the results themselves are fetched by tasks, a slice each. In batches, conditions on version and space go to the
resource as parameters, as hints: Spark applies them again, so a resource that ignores them costs time alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from .rest import IncompleteResults, collect_pages

SCHEMA = "url string, ord int, id string, version int, space string, body string"
Fetch = Callable[[str], dict]


def _with(url: str, **parameters: object) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urlencode(parameters)}"


def _row(url: str, number: int, result: dict) -> tuple:
    version, space = (result.get("version") or {}).get("number"), (result.get("space") or {}).get("key")
    return url, number, result.get("id"), version, space, json.dumps(result, ensure_ascii=False)


def _results(fetch: Fetch, url: str, start: int, limit: int) -> list:
    at = _with(url, start=start, limit=limit)
    found = fetch(at).get("results")
    if not isinstance(found, list):
        raise IncompleteResults(f"no list of results at {at}")
    return found


class _Slice(InputPartition):
    def __init__(self, url: str, start: int, stop: int):
        self.url, self.start, self.stop = url, start, stop


class _Stream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, urls: list[str], limit: int, slice_: int):
        self.fetch, self.urls, self.limit, self.slice = fetch, urls, limit, slice_
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.urls, 0)

    def latestOffset(self) -> dict:
        for url in self.urls:
            n = self.known.get(url, 0)
            while found := _results(self.fetch, url, n, self.limit):
                n += len(found)
            self.known[url] = n
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # A URL that joined later begins at 0.
        return [_Slice(u, a, min(a + self.slice, end[u])) for u in end for a in range(start.get(u, 0), end[u], self.slice)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        at = partition.start
        while at < partition.stop:
            found = _results(self.fetch, partition.url, at, min(self.limit, partition.stop - at))
            if not found:
                raise IncompleteResults(f"{partition.url} has fewer results than it had")
            for result in found[: partition.stop - at]:
                yield _row(partition.url, at, result)
                at += 1

    def commit(self, end: dict) -> None:
        self.known |= end


class _Batch(DataSourceReader):
    def __init__(self, fetch: Fetch, urls: list[str], limit: int):
        self.fetch, self.urls, self.limit = fetch, urls, limit
        self.hints: dict[str, object] = {}

    def partitions(self) -> list[InputPartition]:
        return [_Slice(u, 0, 0) for u in self.urls]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        url = _with(partition.url, **self.hints) if self.hints else partition.url
        for number, result in enumerate(collect_pages(self.fetch, url, self.limit)):
            yield _row(partition.url, number, result)


class _Hinted(_Batch):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("space",):
                self.hints["space"] = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("version",):
                self.hints["from_version"] = f.value + isinstance(f, GreaterThan)
            yield f


def changes_source(name: str, fetch: Fetch) -> type[DataSource]:
    """A source to register: options ``urls`` (by blanks), ``limit`` of a page of results, ``slice`` of a stream's task, and
    ``hints`` (conditions go to the resource, which Spark allows with spark.sql.python.filterPushdown.enabled).

    ``fetch`` takes a URL and returns the decoded body, on the driver for counts and on executors for results. ``ord`` is a
    result's place in the resource; under a hint, its place among the results that the resource gave.
    """

    class Changes(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            kind = _Hinted if self.options.get("hints", "false").lower() == "true" else _Batch
            return kind(fetch, self.options["urls"].split(), int(self.options.get("limit", "200")))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(fetch, self.options["urls"].split(), int(self.options.get("limit", "200")), int(self.options.get("slice", "10000")))

    return Changes
