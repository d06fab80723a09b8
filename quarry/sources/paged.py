"""Listing pages by offset as a data source: read in many tasks, retried, stopped by date, resumed.

    spark.dataSource.register(PagedSource)
    pages = spark.read.format("paged").option("url", "http://host/results?offset={offset}").option("pages", 500).load()

gives (page_idx, url, html, newest, oldest, attempts, error). A page that cannot be had after all retries, or is a challenge,
is a row without html and with its error, so one bad page ends nothing. Pages come newest first; ``newest`` and
``oldest`` are the first and last UTC date of their entries. A filter ``newest >= date`` is pushed
with the option ``pushdown``, which needs ``spark.sql.python.filterPushdown.enabled`` in the session; the option ``since`` does the same: where pages end is found by bisection,
a few requests for any number of pages, and only pages up to there are read.
"""

from __future__ import annotations

import random
import re
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from .readers import CHALLENGE_MARKS, CHALLENGE_TITLE

SCHEMA = "page_idx int, url string, html string, newest date, oldest date, attempts int, error string"
#: Entries carry their time in milliseconds.
ENTRY = re.compile(r"""data-zonedgrouping-entry-unix=["']?(\d{1,17})""")
AGENT = "Mozilla/5.0"


def challenge(html: str) -> bool:
    """Whether a page is shown in place of the content."""
    low = html.lower()
    return any(mark in low for mark in CHALLENGE_MARKS) or re.search(CHALLENGE_TITLE, low) is not None


def page_dates(html: str) -> tuple[date | None, date | None]:
    """(newest, oldest) date of a page's entries."""
    days = [datetime.fromtimestamp(int(x) / 1000, UTC).date() for x in ENTRY.findall(html) if len(x) < 15]
    return (max(days), min(days)) if days else (None, None)


@dataclass
class Pages(InputPartition):
    """Pages from first up to stop."""

    first: int
    stop: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        number = lambda name, kind, least, default: max(least, kind(options.get(name, default)))
        if "{offset}" not in options.get("url", ""):
            raise ValueError("the option url needs {offset}")
        self.url = options["url"]
        self.start, self.pages, self.step = number("start", int, 0, 0), number("pages", int, 0, 500), number("step", int, 1, 100)
        self.retries, self.timeout = number("retries", int, 0, 5), number("timeout", float, 0.1, 30)
        self.backoff, self.most = number("backoff", float, 0, 2), number("mostwait", float, 0, 30)
        self.low, self.high = number("sleepmin", float, 0, 1.5), number("sleepmax", float, 0, 3.5)
        self.per_task = number("pertask", int, 1, 10)
        self.skip = frozenset(int(x) for x in options.get("skip", "").split(",") if x.strip())
        self.since = date.fromisoformat(options["since"]) if options.get("since") else None

    def partitions(self) -> list[Pages]:
        stop = self._stop() if self.since else self.pages
        return [Pages(k, min(k + self.per_task, stop)) for k in range(0, stop, self.per_task)] or [Pages(0, 0)]

    def _stop(self) -> int:
        """The first page whose entries are all before ``since`` or that has none; a page that cannot be had counts as neither."""
        low, high = 0, self.pages
        while low < high:
            at = (low + high) // 2
            html, _, error = self._fetch(at)
            newest = page_dates(html)[0] if html else None
            low, high = (low, at) if error is None and (newest is None or newest < self.since) else (at + 1, high)
        return low

    def read(self, partition: Pages) -> Iterator[tuple]:
        for k in range(partition.first, partition.stop):
            if k not in self.skip:
                html, attempts, error = self._fetch(k)
                yield (k, self._url(k), html, *(page_dates(html) if html else (None, None)), attempts, error)

    def _url(self, k: int) -> str:
        return self.url.replace("{offset}", str(self.start + k * self.step))

    def _fetch(self, k: int) -> tuple[str | None, int, str | None]:
        """(html, attempts, error) of page k; between attempts it waits twice as long each time."""
        error = None
        for attempt in range(1, self.retries + 2):
            time.sleep(random.uniform(min(self.low, self.high), self.high))
            try:
                with urllib.request.urlopen(urllib.request.Request(self._url(k), headers={"User-Agent": AGENT}), timeout=self.timeout) as got:
                    html = got.read().decode("utf-8", "replace")
                if not challenge(html):
                    return html, attempt, None
                error = "challenge page"
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
            if attempt <= self.retries:
                time.sleep(min(self.most, self.backoff**attempt if self.backoff else 0))
        return None, self.retries + 1, error


class FilteredReader(PagedReader):
    """A reader that takes ``since`` from the query's filters."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("newest",) and isinstance(f.value, date):
                self.since = max(self.since or f.value, f.value)
            yield f  # Spark looks at each row all the same


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        wanted = self.options.get("pushdown", "false").lower() == "true"
        return (FilteredReader if wanted else PagedReader)(dict(self.options))


def fetch(spark: SparkSession, target: str, **options: object) -> DataFrame:
    """The pages of ``options`` as Parquet at target, where those that an earlier call has had are not asked for again.

    Pages with an error are asked for again. Returns the latest row of each page.
    """
    spark.dataSource.register(PagedSource)
    try:
        had = [r["page_idx"] for r in spark.read.parquet(target).filter("error is null").select("page_idx").distinct().collect()]  # as many as pages
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        had = []
    rows = spark.read.format("paged").options(**{k: str(v) for k, v in options.items()}, skip=",".join(map(str, had))).load()
    rows.write.mode("append").parquet(target)
    best = F.max_by(F.struct("*"), F.when(F.col("error").isNull(), 1).otherwise(0)).alias("row")
    return spark.read.schema(SCHEMA).parquet(target).groupBy("page_idx").agg(best).select("row.*")
