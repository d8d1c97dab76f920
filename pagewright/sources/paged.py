"""A paginated service as a data source: rows as JSON text, page by page until there is none.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("fetch", "package.module:function").load()

``fetch`` names a function of the page's number (from 1). It returns the page as such services give it, {"results": [...], "next": ..., "count": ...}, or the list
of results alone. Pages are followed until "next" is empty (a list: until it is). Where the first page has a count and more behind it, the number of pages
follows from it and the pages are read side by side; the last one then still goes on to what comes "next". With the option "pages" the first so many pages are read, and a
service that has more raises an error, so that no result is short without a sign."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _page(fetch: str, number: int) -> tuple[list, bool, int | None]:
    """(results, whether there is more, how many results there are in all)"""
    module, _, name = fetch.partition(":")
    page = getattr(importlib.import_module(module), name)(number)
    if isinstance(page, dict):
        return page.get("results") or [], bool(page.get("next")), page.get("count")
    return page, bool(page), None


class _Pages(InputPartition):
    """A page, and whether to go on behind it."""

    def __init__(self, number: int, follow: bool) -> None:
        super().__init__(number)
        self.number, self.follow = number, follow


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fetch, self.pages = options["fetch"], int(options["pages"]) if "pages" in options else None

    def partitions(self) -> list[_Pages]:
        last = self.pages
        if last is None:
            results, more, count = _page(self.fetch, 1)
            last = max(1, -(-count // len(results))) if more and count and results else 1
        return [_Pages(n, n == last) for n in range(1, last + 1)]

    def read(self, partition: _Pages) -> Iterator[tuple[int, str]]:
        number = partition.number
        while True:
            results, more, _ = _page(self.fetch, number)
            for item in results:
                yield number, json.dumps(item, ensure_ascii=False, sort_keys=True)
            if not partition.follow or not more or not results:
                return
            if self.pages is not None:
                if _page(self.fetch, number + 1)[0]:
                    raise ValueError(f"there are more than {self.pages} pages")
                return
            number += 1


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options)
