"""Duplicate papers: exact keys, clusters and keepers; fuzzy titles come from :mod:`titles`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import graph
from tessera.operators.joins import with_live_items
from tessera.operators.titles import fuzzy_edges
from tessera.sources.store import materialize


def key_edges(papers: DataFrame, key: Column, id_: str = "arxiv_id") -> DataFrame:
    """``a, b``: each paper of a group of equal keys with the least id of the group; blank keys group nothing."""
    k = F.nullif(F.lower(F.trim(key)), F.lit(""))
    keyed = papers.select(F.col(id_).alias("b"), k.alias("k")).where("k is not null")
    least = keyed.groupBy("k").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("k", "a")
    return keyed.join(least, "k").where("a <> b").select("a", "b")


def clusters(papers: DataFrame, threshold: float, id_: str = "arxiv_id") -> DataFrame:
    """``id_, cluster`` for papers of clusters of two or more."""
    edges = key_edges(papers, F.col("doi"), id_).unionByName(key_edges(papers, F.col("corpus_id"), id_)).unionByName(fuzzy_edges(papers, threshold, id_))
    return graph.components(edges).select(F.col("node").alias(id_), F.col("root").alias("cluster"))


def keepers(papers: DataFrame, labels: DataFrame, id_: str = "arxiv_id") -> DataFrame:
    """``kept, archived``: the most cited, then newest version, then latest, then least id stays."""
    rows = papers.join(labels, id_)
    first = F.struct(-F.coalesce(F.col("citation_count"), F.lit(-1)), -F.col("version"), -F.coalesce(F.unix_micros("published"), F.lit(-(2**62))), F.col(id_).alias("id"))
    best = rows.groupBy("cluster").agg(F.min(first).alias("m")).select("cluster", F.col("m.id").alias("kept"))
    return rows.join(best, "cluster").where(F.col(id_) != F.col("kept")).select("kept", F.col(id_).alias("archived"))


def dedupe_backlog(backlog: DataFrame, papers: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The backlog with the items of lesser copies archived, and the pairs ``kept, archived``."""
    candidates = with_live_items(papers, backlog)
    pairs = materialize(keepers(candidates, clusters(candidates, threshold)))
    lost = pairs.select(F.col("archived").alias("paper_id"), F.lit(True).alias("_lost")).distinct()
    out = backlog.join(lost, "paper_id", "left").withColumn("status", F.when(F.col("_lost"), schemas.ARCHIVED).otherwise(F.col("status"))).drop("_lost")
    return out.select(*backlog.columns), pairs

