"""Papers made from the driver's tables, which hold none: a fixed stand-in, the same in SQL.

id and abstract: ``documents``; title: its first line; authors: source and language;
DOI: the text's MD5; date: the order of the same number; citations: the quantity of
its lines; references: their parts; recorded judgement: ``labels.quality``, else a
fixed function of the id; seeds and vectors: ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, Relevance, from_dict

NOW = "1998-06-01 00:00:00"
CONFIG: Config = from_dict(
    {
        "name": "stand-in",
        "problem_statement": "license of the and token with und sur les",
        "include_keywords": ["licensed under", "token", "with", "sur"],
        "taxonomy_terms": ["apache-license", "all rights reserved"],
        "exclude_keywords": ["password", "cc by-nc"],
        "scoring": {"foundational_min_citations": 100, "foundational_reserved_slots": 5},
    }
)
RELEVANCE: Relevance = CONFIG.relevance
SEED_LABEL = 3
GATE = 0.05

PAPERS_SQL = """
papers AS (
  SELECT d.doc_id, d.text AS abstract, split_part(d.text, chr(10), 1) AS title, d.source, d.lang, md5(d.text) AS doi,
         o.o_orderdate AS published, c.citations, c.influential, c.refs
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS citations, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INT) AS influential,
                    list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS refs FROM lineitem GROUP BY l_orderkey) c ON c.l_orderkey = d.doc_id
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """Texts that lie in fewer splits than half the cores are dealt to all cores; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a paper comes from ``documents`` alone."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("abstract"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "source", "lang", F.md5("text").alias("doi")
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sum("l_quantity").cast("int").alias("citations"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("influential"),
        F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("refs"),
    )
    # dealt by number: ids pack so well that partitions joined by their bytes would leave a task millions of rows to sort
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("published")).repartition(n, "doc_id")
    return titled(spark, sf_dir).join(orders, "doc_id", "left").join(lines, "doc_id", "left")


def typed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the names of ``schemas.PAPERS``, as far as operators need them."""
    p = papers(spark, sf_dir)
    return p.select(
        F.col("doc_id").cast("string").alias("arxiv_id"), F.lit(1).alias("version"), "doi", F.lit(None).cast("string").alias("corpus_id"), "title", "abstract",
        F.array("source", "lang").alias("authors"), "published", F.col("citations").alias("citation_count"), F.col("influential").alias("influential_citation_count"),
        F.col("refs").alias("reference_ids"), F.array().cast("array<string>").alias("code_links"), F.lit("SEEN").alias("status"), F.lit(None).cast("double").alias("relevance_score"),
        F.lit(None).cast("string").alias("relevance_rationale"), F.lit(None).cast("string").alias("relevance_method"), F.col("doc_id"),
    )
