"""Joins by key, containment and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X


def new_rows(harvested: DataFrame, stored: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Harvested rows not stored yet; of one key's rows in a harvest, one."""
    return harvested.dropDuplicates([key]).join(stored.select(key).hint("merge"), key, "left_anti")  # a stored column of few bytes may be many rows


def seed_vectors(embeddings: DataFrame, seeds: DataFrame, key: str = "paper_id") -> DataFrame:
    """Embeddings of the seeds; a seed without one drops out."""
    return embeddings.join(seeds.select(key).distinct(), key, "left_semi")


def enrich_citations(papers: DataFrame, found: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """First-source enrichment (``citation_count, influential_citation_count, tldr, fields_of_study, corpus_id, doi, reference_ids``).

    Counts and references replace what is there; a DOI only fills a blank; a miss leaves the row as it is."""
    f = found.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("citation_count", "influential_citation_count", "tldr", "fields_of_study", "corpus_id", "doi", "reference_ids")])
    over = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    joined = papers.join(f, papers[key] == f["_key"], "left")
    return joined.withColumns(
        {
            **{c: over(c) for c in ("citation_count", "influential_citation_count", "corpus_id")},
            "tldr": F.coalesce(F.nullif(F.col("_tldr"), F.lit("")), F.col("tldr")),
            "fields_of_study": X.array_union_distinct("fields_of_study", "_fields_of_study"),
            "doi": F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.col("_doi")),
            "reference_ids": F.coalesce(F.slice(F.array_distinct("_reference_ids"), 1, 50), F.col("reference_ids")),
        }
    ).drop(*f.columns)


def enrich_open(papers: DataFrame, found: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Second-source enrichment (``openalex_id, cited_by_count, labels, is_oa``): a count only where there is none."""
    f = found.select(F.col(key).alias("_key"), F.col("openalex_id").alias("_oid"), F.col("cited_by_count").alias("_cited"), F.col("labels").alias("_labels"), F.col("is_oa").alias("_oa"))
    extra = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
    return (
        papers.join(f, papers[key] == f["_key"], "left")
        .withColumns(
            {
                "openalex_id": F.coalesce("_oid", "openalex_id"),
                "citation_count": F.coalesce("citation_count", "_cited"),
                "fields_of_study": X.array_union_distinct("fields_of_study", "_labels"),
                "extra": F.when(F.col("_oa").isNotNull(), F.map_concat(F.map_filter(extra, lambda k, v: k != "open_access"), F.create_map(F.lit("open_access"), F.col("_oa").cast("string")))).otherwise(F.col("extra")),
            }
        )
        .drop(*f.columns)
    )


def extracted(papers: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers to score with their extractions, and those that have none (to be logged)."""
    ready = papers.where(F.col("status") == schemas.EXTRACTED)
    e = extractions.withColumnRenamed("paper_id", "arxiv_id")
    return ready.join(e.select("arxiv_id", F.struct(*e.columns).alias("extraction")), "arxiv_id"), ready.join(e, "arxiv_id", "left_anti")


def not_scored(papers: DataFrame, backlog: DataFrame) -> DataFrame:
    """Papers without a primary item."""
    has = backlog.where(F.col("id").endswith("#1")).select(F.expr("substring(id, 1, length(id) - 2)").alias("arxiv_id"))
    return papers.join(has, "arxiv_id", "left_anti")


def with_live_items(papers: DataFrame, backlog: DataFrame) -> DataFrame:
    items = backlog.where(F.col("status") != schemas.ARCHIVED).select(F.col("paper_id").alias("arxiv_id")).distinct()
    return papers.join(items, "arxiv_id", "left_semi")


def locate_quote(chunks: Column, quote: Column) -> Column:
    """The first chunk that holds the quote, white space and case aside; null if none does, or the quote is blank."""
    plain = lambda t: F.lower(X.collapse(t))
    q = plain(F.coalesce(quote, F.lit("")))
    return F.when(q != "", F.get(F.filter(chunks, lambda c: F.contains(plain(c["text"]), q)), F.lit(0)))


def look_up_answers(requests: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (``key, prompt``) with their recorded ``payload``, and those without: what a planning run asks for."""
    return requests.join(answers, "key"), requests.join(answers, "key", "left_anti")
