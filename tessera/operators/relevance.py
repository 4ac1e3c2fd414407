"""The relevance cascade: keywords, then similarity, then recorded judgements for a shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import filters, rank
from tessera.sources.store import materialize

# Thresholds that embedders suggest.
SUGGESTED = {"base": 0.3, "hashing": 0.15, "transformer": 0.5}


def effective_threshold(config: Config, embedder: str) -> float:
    """The configured gate, or the lower suggested one where a simpler embedder stands in for the configured."""
    return config.relevance.embedding_threshold if embedder == config.embedding.provider else min(config.relevance.embedding_threshold, SUGGESTED.get(embedder, SUGGESTED["base"]))


def similarity(papers: DataFrame, seeds: DataFrame, vector: str = "vector") -> DataFrame:
    """``papers`` with ``similarity`` to the centroid of the seed vectors, 0 at least; without seeds, 0."""
    center = V.centroid(seeds, vector).select(F.col("centroid").alias("_center"))  # one row of one vector
    near = F.greatest(F.lit(0.0), V.cosine(F.col(vector), F.col("_center")))
    return papers.join(F.broadcast(center)).withColumn("similarity", F.coalesce(near, F.lit(0.0))).drop("_center")


def keyword_rung(papers: DataFrame, config: Config) -> DataFrame:
    """Fails papers by keyword; others keep their status."""
    checked = filters.keyword_prefilter(papers, F.concat_ws("\n", "title", "abstract"), config)
    why = F.when(F.size("matched") > 0, F.concat(F.lit("Excluded by: "), F.array_join("matched", ", "))).otherwise(F.lit("No include keyword"))
    return filters.verdict(checked, ~F.col("passed"), status=F.lit(schemas.IRRELEVANT), score=F.lit(0.0), rationale=why, method="KEYWORD").drop("passed", "score", "matched")


def gates(papers: DataFrame, seeds: DataFrame, config: Config, threshold: float) -> DataFrame:
    """SEEN papers that carry a ``vector`` after the rungs that ask no model, with ``similarity`` and ``place``.

    A paper that is still SEEN is of the shortlist, where it has a place, or of the tail behind it."""
    seen = papers.where(F.col("status") == schemas.SEEN)
    first = materialize(keyword_rung(seen, config))  # the cheap rung settles most rows before vectors are touched
    near = similarity(first.where(F.col("status") == schemas.SEEN), seeds)
    low = F.col("similarity") < threshold
    gated = filters.verdict(near, low, status=F.lit(schemas.IRRELEVANT), score=F.col("similarity"), rationale=F.lit("Below the similarity threshold"), method="EMBEDDING")
    gated = materialize(gated)
    short = F.broadcast(shortlist(gated.where(F.col("status") == schemas.SEEN), config))  # of the configured length
    placed = gated.join(short, "arxiv_id", "left")
    failed = first.where(F.col("status") == schemas.IRRELEVANT)
    return placed.unionByName(failed.withColumns({"similarity": F.lit(None).cast("double"), "place": F.lit(None).cast("long")}))


def verdicts(gated: DataFrame, judgements: DataFrame, config: Config) -> DataFrame:
    """The papers of :func:`gates` with the judgements on its shortlist; a paper of that without an answer stays SEEN."""
    told = judgements.select("arxiv_id", F.col("score").alias("_s"), F.col("rationale").alias("_r"))
    open_ = F.col("status") == schemas.SEEN
    short = gated.where(open_ & F.col("place").isNotNull()).join(told, "arxiv_id", "left")
    judged = filters.verdict(
        short, F.col("_s").isNotNull(), status=F.when(F.col("_s") >= config.relevance.llm_threshold, schemas.RELEVANT).otherwise(schemas.IRRELEVANT), score=F.col("_s"), rationale=F.col("_r"), method="LLM"
    ).drop("_s", "_r")
    rest = gated.where(~(open_ & F.col("place").isNotNull()))
    tail = filters.verdict(rest, open_, status=F.lit(schemas.RELEVANT), score=F.col("similarity"), rationale=F.lit("Beyond the shortlist; kept by similarity"), method="EMBEDDING")
    return judged.unionByName(tail.select(*judged.columns)).drop("similarity", "place")


def cascade(papers: DataFrame, seeds: DataFrame, judgements: DataFrame, config: Config, threshold: float) -> DataFrame:
    """Verdicts on SEEN papers that carry a ``vector``; ``judgements``: recorded answers, ``arxiv_id, score, rationale``."""
    return verdicts(materialize(gates(papers, seeds, config, threshold)), judgements, config).select(*papers.columns)


def shortlist(alive: DataFrame, config: Config) -> DataFrame:
    """``arxiv_id, place`` of the papers that are to be judged: by similarity, or fused with BM25 against the problem statement."""
    c = config.relevance
    dense = rank.ascending("similarity", "published", "arxiv_id")
    if not c.use_bm25_rrf:
        top = alive.select("arxiv_id", F.struct(*[x.alias(f"c{i}") for i, x in enumerate(dense)]).alias("_d")).orderBy("_d").limit(c.embedding_shortlist).collect()  # of the configured length
        return alive.sparkSession.createDataFrame([(r["arxiv_id"], k) for k, r in enumerate(top)], "arxiv_id string, place long")
    lexical = rank.bm25(alive, X.title_and_abstract("title", "abstract"), config.problem_statement, "arxiv_id", c.bm25_k1, c.bm25_b)
    both = alive.select("arxiv_id", "similarity", "published").join(lexical, "arxiv_id")
    return rank.fused_shortlist(both, dense, [-F.col("bm25"), F.col("arxiv_id")], "arxiv_id", c.embedding_shortlist, c.rrf_alpha, c.rrf_k).select("arxiv_id", "place")
