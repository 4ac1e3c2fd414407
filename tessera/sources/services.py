"""Citation services: fetched bodies as JSON to typed columns, and how to fetch them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.sources.http import HttpClient

GRAPH = "https://api.semanticscholar.org/graph/v1/paper/arXiv:{}"
RECOMMEND = "https://api.semanticscholar.org/recommendations/v1/papers"
WORKS = "https://api.openalex.org/works"
FIELDS = "citationCount,influentialCitationCount,tldr,fieldsOfStudy,externalIds,references.externalIds"
CITATIONS = (
    "citationCount int, influentialCitationCount int, tldr struct<text:string>, fieldsOfStudy array<string>, externalIds struct<CorpusId:string,DOI:string,ArXiv:string>, "
    "references array<struct<externalIds:struct<CorpusId:string,DOI:string,ArXiv:string>>>"
)
OPEN = "id string, cited_by_count int, open_access struct<is_oa:boolean>, topics array<struct<display_name:string>>, concepts array<struct<display_name:string>>"


def citations(bodies: DataFrame) -> DataFrame:
    """``arxiv_id, body`` to the columns that :func:`tessera.operators.joins.enrich_citations` takes."""
    j = F.from_json("body", CITATIONS)
    refs = F.filter(F.transform(F.col("j.references"), lambda r: X.reference_id(r["externalIds"])), lambda r: r.isNotNull())
    return bodies.select("arxiv_id", j.alias("j")).select(
        "arxiv_id",
        F.col("j.citationCount").alias("citation_count"),
        F.col("j.influentialCitationCount").alias("influential_citation_count"),
        F.col("j.tldr.text").alias("tldr"),
        F.col("j.fieldsOfStudy").alias("fields_of_study"),
        F.col("j.externalIds.CorpusId").alias("corpus_id"),
        F.col("j.externalIds.DOI").alias("doi"),
        F.slice(F.array_distinct(refs), 1, 50).alias("reference_ids"),
    )


def open_works(bodies: DataFrame) -> DataFrame:
    """``arxiv_id, body`` to the columns that :func:`tessera.operators.joins.enrich_open` takes."""
    blank = F.array().cast("array<string>")
    names = lambda k: F.coalesce(F.transform(F.col(f"j.{k}"), lambda x: x["display_name"]), blank)
    return bodies.select("arxiv_id", F.from_json("body", OPEN).alias("j")).select(
        "arxiv_id",
        F.col("j.id").alias("openalex_id"),
        F.col("j.cited_by_count").alias("cited_by_count"),
        F.array_distinct(F.filter(F.concat(names("topics"), names("concepts")), lambda x: x.isNotNull() & (x != ""))).alias("labels"),
        F.col("j.open_access.is_oa").alias("is_oa"),
    )


def fetch(papers: DataFrame, request: Callable[[HttpClient, dict], str | None], client: Callable[[], HttpClient] = HttpClient) -> DataFrame:
    """``arxiv_id, body``: one request per row on the executors; a failed one is a miss (null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        http = client()
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    body = request(http, row)
                except (OSError, ValueError):
                    body = None
                out.append((row["arxiv_id"], body))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["arxiv_id", "body"])

    return papers.mapInArrow(run, "arxiv_id string, body string").where("body is not null")


def citation_request(http: HttpClient, row: dict) -> str | None:
    return http.get_text(GRAPH.format(row["arxiv_id"]), params={"fields": FIELDS})


def open_request(http: HttpClient, row: dict) -> str | None:
    """By DOI, else by title; a failed DOI request ends the search."""
    doi = (row.get("doi") or "").strip().split("doi.org/")[-1]
    if doi:
        body = http.get_text(f"{WORKS}/https://doi.org/{doi}")
        if json.loads(body).get("id"):
            return body
    if row.get("title"):
        found = http.get_json(WORKS, params={"filter": f"title.search:{row['title']}", "per_page": 1}).get("results") or []
        return json.dumps(found[0]) if found else None
    return None


def recommended(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    """Stub papers, SEEN, of recommended ids and titles; an id that comes twice is one."""
    rows = spark.createDataFrame(found, "url string, title string").dropDuplicates(["url"])
    id_, version = X.id_and_version("url")
    return rows.select(id_.alias("arxiv_id"), version.alias("version"), X.collapse("title").alias("title"), F.lit("").alias("abstract"), F.lit(schemas.SEEN).alias("status"))


def recommendations(http: HttpClient, seeds: list[str], limit: int = 40) -> list[tuple[str, str]]:
    """``(id, title)`` of papers that a service recommends from the seeds; nothing on failure."""
    if not seeds:
        return []
    ids = [s if ":" in s else f"ARXIV:{s}" for s in seeds]
    try:
        found = json.loads(http.post(RECOMMEND, {"positivePaperIds": ids}, params={"fields": "title,externalIds", "limit": limit}))
    except (OSError, ValueError):
        return []
    papers = found.get("recommendedPapers") or []
    return [(p["externalIds"]["ArXiv"], p.get("title") or "") for p in papers if (p.get("externalIds") or {}).get("ArXiv")]
