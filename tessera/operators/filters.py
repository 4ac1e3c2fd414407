"""Keyword prefilter, gates and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.functions import scalars as S
from tessera.functions import text as X


def keyword_prefilter(df: DataFrame, text: Column, config: Config) -> DataFrame:
    """``df`` with ``passed, score, matched`` added, or replaced where it has such columns: any exclude term fails a text, else one include term passes it."""
    hay = F.col("_kp_hay")  # a column of its own, so that a text is normalised once and not once per term
    df = df.withColumn("_kp_hay", X.normalize(text))
    df = df.withColumns({"_kp_inc": X.matched_terms(hay, [*config.include_keywords, *config.taxonomy_terms]), "_kp_exc": X.matched_terms(hay, config.exclude_keywords)}).drop("_kp_hay")
    bad, n = F.size("_kp_exc") > 0, F.size("_kp_inc")
    return df.withColumns(
        {
            "passed": ~bad & (n > 0),
            "score": F.when(bad | (n == 0), 0.0).otherwise(F.round(1 - 1 / (1 + n.cast("double")), 4)),
            "matched": F.when(bad, F.col("_kp_exc")).otherwise(F.col("_kp_inc")),
        }
    ).drop("_kp_inc", "_kp_exc")


def since(published: Column, cursor: Column) -> Column:
    """Not older than the cursor; undated rows, and all rows without a cursor, are kept."""
    return cursor.isNull() | published.isNull() | (published >= cursor)


def is_recent(published: Column, now: Column, grace_days: int) -> Column:
    return published.isNull() | (S.age_days(published, now) <= grace_days)


def is_foundational(citations: Column, influential: Column, published: Column, now: Column, config: Config) -> Column:
    """Enough citations, and either older than the grace period or with many influential ones."""
    least = config.scoring.foundational_min_citations
    old = S.age_days(published, now) > config.scoring.recent_paper_grace_days
    strong = influential >= max(10, least // 5)
    return F.coalesce(citations >= least, F.lit(False)) & (F.coalesce(old, F.lit(False)) | F.coalesce(strong, F.lit(False)))


def live(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") != schemas.ARCHIVED)


def new_in_window(items: DataFrame, now: Column, days: int) -> DataFrame:
    """Live items made in the last ``days``."""
    return live(items).where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def has_code(code_link: Column, code_links: Column) -> Column:
    return (F.coalesce(F.length(code_link), F.lit(0)) > 0) | F.coalesce(F.size(code_links) > 0, F.lit(False))


def is_limitation(title: Column, patterns: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(False)
    for p in patterns:
        if p:
            out = out | F.contains(low, F.lit(p.lower()))
    return out


def unchanged(papers: DataFrame, extractions: DataFrame, hashes: DataFrame) -> DataFrame:
    """Papers whose text hash and extraction are as they were: ``hashes`` has ``arxiv_id, section_hash``."""
    done = extractions.select(F.col("paper_id").alias("arxiv_id")).distinct()
    same = papers.where(F.col("status") == schemas.EXTRACTED).join(hashes.withColumnRenamed("section_hash", "_new"), "arxiv_id")
    return same.where(F.col("section_hash") == F.col("_new")).drop("_new").join(done, "arxiv_id", "left_semi")


def verdict(df: DataFrame, hit: Column, *, status: Column, score: Column, rationale: Column, method: str) -> DataFrame:
    """Set status, score, rationale and method where ``hit``."""
    keep = lambda name, value: F.when(hit, value).otherwise(F.col(name))
    return df.withColumns(
        {"status": keep("status", status), "relevance_score": keep("relevance_score", score), "relevance_rationale": keep("relevance_rationale", rationale), "relevance_method": keep("relevance_method", F.lit(method))}
    )


def digest_view(items: DataFrame) -> DataFrame:
    """Items with the three body fields, taken from an old one-piece description where they are blank."""
    mark, head = "Applicability to our problem:", "Headline results:"
    old = X.strip("description")
    at = F.instr(old, mark)
    before = F.when(at > 0, X.strip(F.substring(old, F.lit(1), at - 1))).otherwise(old)
    claims = F.when(F.startswith(before, F.lit(head)), X.strip(F.substring(before, F.lit(len(head) + 1), F.length(before)))).otherwise(before)
    use = F.when(at > 0, X.strip(F.substring(old, at + len(mark), F.length(old)))).otherwise(F.lit(""))
    filled = lambda c, other: F.coalesce(F.nullif(X.strip(c), F.lit("")), other)
    return items.withColumns({"contributions": filled("contributions", claims), "applicability": filled("applicability", use), "reviewer_notes": X.strip("reviewer_notes")})
