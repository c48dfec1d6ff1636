"""A data source over a crawler's listings: ``spark.read.format("listing").option("urls", "u1 u2").option("limit", 30)``.

One partition per page, so pages are fetched side by side; the limit is passed to the crawler, which stops
early. A platform without listings raises. Options: urls (separated by spaces), limit, backend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cliplake.functions.urls import PLATFORMS
from cliplake.plugins import backend
from cliplake.sources.files import PAGES, TITLE_LIMIT

COLUMNS = "platform string, platform_id string, url string, title string, uploader string, duration_sec double, upload_date string"


def platform_of(url: str) -> str | None:
    return next((name for pattern, name in PLATFORMS if re.search(pattern, url)), None)


class Page(InputPartition):
    def __init__(self, url: str, platform: str) -> None:
        self.url, self.platform = url, platform


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = options.get("urls", "").split()
        self.limit, self.backend = int(options.get("limit", "30")), options.get("backend", "fake")

    def partitions(self) -> list[Page]:
        pages = []
        for u in self.urls:
            platform = platform_of(u)
            if platform not in PAGES:
                raise NotImplementedError(f"no listings of {platform or 'this platform'}: {u}")
            pages.append(Page(u, platform))
        return pages

    def read(self, page: Page) -> Iterator[tuple]:
        for e in backend("crawler", self.backend).browse(page.url, self.limit):
            pid = e.get("id") or ""
            url = e.get("url") or e.get("webpage_url") or (PAGES[page.platform] % pid if pid else "")
            title = e.get("title") or (e.get("description") if page.platform == "instagram" else "") or ""
            who = e.get("uploader", e.get("uploader_id" if page.platform == "instagram" else "channel")) or ""
            yield (page.platform, pid, url, title[: TITLE_LIMIT.get(page.platform)], who, float(e.get("duration") or 0), e.get("upload_date") or "")


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
