"""The Atom feed of a preprint server: files of entries, and a paged data source.

Files are read by Spark's XML source with the schema below.  The data source fetches
page after page on executors, newest first, and stops at an empty or short page, at
``max_results``, or at entries older than ``since``."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import text as X
from tessera.sources.http import HttpClient

API = "http://export.arxiv.org/api/query"
ENTRY = (
    "id string, updated string, published string, title string, summary string, author array<struct<name:string>>, `arxiv:doi` string, "
    "link array<struct<_href:string,_rel:string,_title:string,_type:string>>, category array<struct<_term:string>>"
)
RECORD = "url string, updated string, published string, title string, summary string, authors array<string>, doi string, pdf string, html string, categories array<string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files as papers."""
    raw = spark.read.schema(ENTRY).format("xml").option("rowTag", "entry").load(path)
    pick = lambda test: F.get(F.transform(F.filter("link", test), lambda x: x["_href"]), F.lit(0))
    return papers(
        raw.select(
            F.col("id").alias("url"), "updated", "published", "title", "summary",
            F.transform("author", lambda a: a["name"]).alias("authors"),
            F.col("`arxiv:doi`").alias("doi"),
            pick(lambda x: x["_title"] == "pdf").alias("pdf"),
            pick(lambda x: (x["_rel"] == "alternate")).alias("html"),
            F.transform("category", lambda c: c["_term"]).alias("categories"),
        )
    )


def papers(records: DataFrame) -> DataFrame:
    """Records of either source as paper columns; URLs default to those of the id."""
    id_, version = X.id_and_version("url")
    blank = F.array().cast("array<string>")
    return records.select(
        id_.alias("arxiv_id"),
        version.alias("version"),
        X.collapse("title").alias("title"),
        X.collapse("summary").alias("abstract"),
        F.filter(F.transform(F.coalesce("authors", blank), lambda a: X.collapse(a)), lambda a: a != "").alias("authors"),
        F.array_distinct(F.filter(F.coalesce("categories", blank), lambda c: c.isNotNull())).alias("categories"),
        X.utc_timestamp("published").alias("published"),
        X.utc_timestamp("updated").alias("updated"),
        F.nullif(F.trim("doi"), F.lit("")).alias("doi"),
        F.coalesce("pdf", F.concat(F.lit("http://arxiv.org/pdf/"), id_)).alias("pdf_url"),
        F.coalesce("html", F.concat(F.lit("http://arxiv.org/abs/"), id_)).alias("html_url"),
    ).where("arxiv_id <> ''")


_NS = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}


def parse(xml: str) -> list[tuple]:
    """Rows of RECORD in one page of the feed."""
    out = []
    for e in ET.fromstring(xml).findall("a:entry", _NS):
        text = lambda name, e=e: e.findtext(name, None, _NS)
        links = [x.attrib for x in e.findall("a:link", _NS)]
        first = lambda key, value, links=links: next((x.get("href") for x in links if x.get(key) == value), None)
        out.append(
            (
                text("a:id"), text("a:updated"), text("a:published"), text("a:title"), text("a:summary"),
                [x.text or "" for x in e.findall("a:author/a:name", _NS)], text("x:doi"), first("title", "pdf"), first("rel", "alternate"),
                [x.get("term") for x in e.findall("a:category", _NS)],
            )
        )
    return out


def harvest(query: str, since: datetime | None, most: int, page: int = 100, client: HttpClient | None = None) -> Iterator[tuple]:
    """Rows of RECORD, newest first.  A failed request raises: the cursor must not move past it."""
    client = client or HttpClient()
    start = 0
    while start < most:
        n = min(page, most - start)
        rows = parse(client.get_text(API, params={"search_query": query, "start": start, "max_results": n, "sortBy": "submittedDate", "sortOrder": "descending"}))
        for row in rows:
            when = _utc(row[2])
            if since is None or when is None or when >= since:
                yield row
        start += n
        if len(rows) < n:
            return


def _utc(text: str | None) -> datetime | None:
    try:
        when = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, Any]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One: pages of one query over all categories must come in order, and one limit holds for all."""
        names = [q.strip() for q in self.options.get("categories", "").split(",") if q.strip()]
        return [InputPartition(X.category_query(names))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        since = _utc(self.options.get("since"))
        yield from harvest(partition.value, since, int(self.options.get("maxresults", 200)), int(self.options.get("pagesize", 100)), HttpClient(timeout=float(self.options.get("timeout", 30))))


class PreprintSource(DataSource):
    """``spark.read.format("preprints").option("categories", "cs.LG,cs.CV")``; also ``since``, ``maxResults``, ``pageSize``."""

    @classmethod
    def name(cls) -> str:
        return "preprints"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
