"""Paginated JSON resources as a Spark data source, and projections of wiki records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "struct<id:string,title:string,type:string,version:struct<number:int,when:string>,space:struct<key:string>,ancestors:array<struct<id:string>>,body:struct<storage:struct<value:string>>>"


class IncompleteResults(RuntimeError):
    """A page of results is malformed; partial results are never returned."""


def collect_pages(fetch: Callable[[str], dict], url: str, limit: int = 200) -> Iterator[dict]:
    """All results of a paginated resource: ``_links.next`` is followed; without it pages are asked for until one is empty.

    A link back to a page that was there before would never end and is refused.
    """
    start, linked, seen = 0, False, set()
    at: str | None = f"{url}{'&' if '?' in url else '?'}start=0&limit={limit}"
    while at is not None:
        if at in seen:
            raise IncompleteResults(f"{at} is linked again")
        seen.add(at)
        body = fetch(at)
        results = body.get("results")
        if not isinstance(results, list):
            raise IncompleteResults(f"no list of results at {at}")
        yield from results
        following = (body.get("_links") or {}).get("next")
        if following:
            linked, at = True, following
        elif linked or not results:
            at = None
        else:
            start += len(results)
            at = f"{url}{'&' if '?' in url else '?'}start={start}&limit={limit}"


class _Resource(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable[[str], dict], urls: list[str], limit: int):
        self.fetch, self.urls, self.limit = fetch, urls, limit

    def partitions(self) -> list[InputPartition]:
        return [_Resource(u) for u in self.urls]

    def read(self, partition: _Resource) -> Iterator[tuple]:
        for i, result in enumerate(collect_pages(self.fetch, partition.url, self.limit)):
            yield partition.url, i, json.dumps(result, ensure_ascii=False)


def paged_source(name: str, fetch: Callable[[str], dict]) -> type[DataSource]:
    """A data source class to register: ``spark.read.format(name).option("urls", "a b").load()``, one partition per URL.

    ``fetch`` takes a URL and returns the decoded body; it runs on the executors.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "url string, ord int, body string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, self.options["urls"].split(), int(self.options.get("limit", "200")))

    return Paged


def page_records(results: DataFrame, body: str = "body") -> DataFrame:
    """id, title, version, parent_id (the last ancestor, null at the root), space, storage, when of wiki pages."""
    r = results.select(F.from_json(body, RECORD).alias("r"))
    return r.select("r.id", "r.title", F.col("r.version.number").alias("version"), F.try_element_at("r.ancestors", F.lit(-1))["id"].alias("parent_id"), F.col("r.space.key").alias("space"), F.col("r.body.storage.value").alias("storage"), F.col("r.version.when").alias("when"))


def page_index(results: DataFrame, body: str = "body") -> DataFrame:
    return page_records(results, body).select("id", "title", "version")


def with_attachments(pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Pages with a map of their attachments' titles to download paths."""
    by = attachments.groupBy("page_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("title", "download")))).alias("attachments"))
    return pages.join(by, "page_id", "left")
