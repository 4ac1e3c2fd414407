"""The preprint feed as a data source of batches and of streams.

After :func:`register`, ``spark.read.format("preprint_feed")`` takes filters on ``published`` and ``category`` into
its requests.  ``spark.readStream`` goes from offset to offset: an offset
is the time of the newest entry and the ids of that time, so that entries of one second that come in
two requests are neither lost nor taken twice.  The feed goes on in time; entries that appear later under an
older date are for a batch read.  Pages come in order, so one task asks for them; ``feed`` names a folder of recorded
pages that is read instead, on a path that all machines have."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull

from tessera.functions import text as X
from tessera.sources.atom import RECORD, _utc, harvest, parse
from tessera.sources.http import HttpClient

SCHEMA = f"{RECORD}, category string"
_PUBLISHED, _CATEGORIES = 2, 9


class Feed:
    """Entries by option: recorded pages, or requests."""

    def __init__(self, options: dict[str, Any]):
        self.options = {k.lower(): v for k, v in options.items()}

    def categories(self) -> list[str]:
        return [q.strip() for q in self.options.get("categories", "").split(",") if q.strip()]

    def entries(self, since: datetime | None, categories: list[str], most: int | None = None) -> Iterator[tuple]:
        """Rows of SCHEMA, an id once, not older than ``since``; of the categories, if any are given."""
        seen = set()
        for row in self._rows(since, categories, most or int(self.options.get("maxresults", 200))):
            when = _utc(row[_PUBLISHED])
            if row[0] not in seen and (since is None or when is None or when >= since) and (not categories or set(categories) & set(row[_CATEGORIES])):
                seen.add(row[0])
                yield (*row, row[_CATEGORIES][0] if row[_CATEGORIES] else None)

    def _rows(self, since: datetime | None, categories: list[str], most: int) -> Iterator[tuple]:
        if folder := self.options.get("feed"):
            for page in sorted(Path(folder).glob("*.xml")):
                yield from parse(page.read_text())
        else:
            client = HttpClient(timeout=float(self.options.get("timeout", 30)))
            yield from harvest(X.category_query(categories), since, most, int(self.options.get("pagesize", 100)), client)


class _Reader(DataSourceReader):
    def __init__(self, feed: Feed):
        self.feed, self.least, self.primary, self.there = feed, [], None, set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes lower bounds of ``published``, equalities of ``category`` and that they are there; gives back the others."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("published",) and _utc(f.value):
                self.least.append((f.value, isinstance(f, GreaterThan)))
            elif isinstance(f, EqualTo | In) and f.attribute == ("category",):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.primary = values if self.primary is None else self.primary & values
            elif isinstance(f, IsNotNull) and f.attribute in (("published",), ("category",)):
                self.there.add(_PUBLISHED if f.attribute == ("published",) else -1)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        bounds = [w for w in [_utc(self.feed.options.get("since")), *(_utc(x) for x, _ in self.least)] if w]
        asked = sorted(self.primary) if self.primary is not None else self.feed.categories()
        if self.primary is not None and not asked:
            return
        wanted = set(self.feed.categories())
        for row in self.feed.entries(max(bounds, default=None), asked):
            text = row[_PUBLISHED]
            if any(row[k] is None for k in self.there):
                continue
            above = all(text is not None and (text > x if strictly else text >= x) for x, strictly in self.least)
            if above and (self.primary is None or row[-1] in self.primary) and (not wanted or wanted & set(row[_CATEGORIES])):
                yield row


class _Stream(DataSourceStreamReader):
    def __init__(self, feed: Feed):
        self.feed = feed

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.feed.options.get("since", ""), "ids": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        """The newest time, and the ids of that time.  Requests come newest first, so the first page tells."""
        recorded = "feed" in self.feed.options
        dated = [(w, row[0]) for row in self.feed.entries(None, self.feed.categories(), None if recorded else int(self.feed.options.get("pagesize", 100))) if (w := _utc(row[_PUBLISHED]))]
        if not dated:
            return self.initialOffset()
        newest = max(w for w, _ in dated)
        return {"at": newest.isoformat(), "ids": " ".join(sorted(x for w, x in dated if w == newest))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((start["at"], start["ids"], end["at"], end["ids"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, taken, end, last = partition.value
        start, end, taken, last = _utc(start), _utc(end), set(taken.split()), set(last.split())
        if end is None:
            return
        for row in self.feed.entries(start, self.feed.categories()):
            when = _utc(row[_PUBLISHED])
            if when is None or when > end or (when == end and last and row[0] not in last):
                continue
            if start is None or when > start or (when == start and row[0] not in taken):
                yield row

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FeedSource(DataSource):
    """Options: ``categories``, ``since``, ``maxResults``, ``pageSize``, ``timeout``, ``feed``."""

    @classmethod
    def name(cls) -> str:
        return "preprint_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Feed(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(Feed(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Make the format known, and have Spark offer its filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
