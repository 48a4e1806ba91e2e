"""A paginated JSON listing as a data source: pages of fixed size until a short one, at most ``max_pages``.

Options: ``url`` with ``{page}`` and ``{per_page}`` in it (http, https or file), ``per_page`` (100), ``max_pages`` (10). Rows have the
page, the place in it, the entry as JSON text, and ``truncated``: whether the last allowed page was still full.
Pages depend on one another (only a short page tells the end), so one task reads them; rows stream out a page at a time.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, position int, entry string, truncated boolean"


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.per_page, self.max_pages = int(options.get("per_page", 100)), int(options.get("max_pages", 10))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(1, self.max_pages + 1):
            with urllib.request.urlopen(self.url.format(page=page, per_page=self.per_page)) as answer:  # noqa: S310
                entries = json.load(answer)
            full = len(entries) >= self.per_page
            for i, entry in enumerate(entries):
                yield page, i, json.dumps(entry, sort_keys=True), full and page == self.max_pages
            if not full:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("paged_json")`` known."""
    spark.dataSource.register(PagedSource)
