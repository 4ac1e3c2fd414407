"""Counts, means and document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas


def status_counts(papers: DataFrame, statuses: tuple[str, ...] = schemas.PAPER_STATUSES) -> DataFrame:
    """Every status with its count, zeros too."""
    every = papers.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = papers.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def cursor(papers: DataFrame, published: str = "published") -> DataFrame:
    return papers.agg(F.max(published).alias("cursor"))


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``n, avgdl``: number of documents and their mean length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))


def term_counts(docs: DataFrame, terms: Column | None = None, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``key, term, tf``; only the given terms, if any are."""
    kept = F.col(tokens) if terms is None else F.filter(tokens, lambda t: F.array_contains(terms, t))
    return docs.select(key, F.explode(kept).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, terms: Column | None = None, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    kept = F.col(tokens) if terms is None else F.filter(tokens, lambda t: F.array_contains(terms, t))
    return docs.select(F.explode(F.array_distinct(kept)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def grounded_fraction(populated: list[Column], grounded: list[Column]) -> Column:
    """Share of the populated fields that are grounded; 0 where none is populated."""
    n = sum((p.cast("int") for p in populated), F.lit(0))
    hits = sum(((p & g).cast("int") for p, g in zip(populated, grounded, strict=True)), F.lit(0))
    return F.when(n == 0, 0.0).otherwise(hits.cast("double") / n)


def stage_counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts, for the audit log."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
