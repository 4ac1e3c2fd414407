"""Evidence confidence, impact estimates and backlog items.

Input: papers with a struct column ``extraction`` (see ``schemas.EXTRACTIONS``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.functions import scalars as S
from tessera.functions import text as X
from tessera.operators import aggregates, filters

# Weights of the four signals, the least citation signal of a recent paper, and the signal of an unstated confidence.
WEIGHTS = {"code": 0.20, "provenance": 0.35, "extraction_confidence": 0.25, "citation": 0.20}
RECENT_CITATION, UNSTATED = 0.5, 0.5
#: Estimate of a paper without a recorded one.
DEFAULT_ESTIMATE = {"expected_impact": 0.4, "applicability": 0.4, "effort": 5.0}
#: Claim fields that should be grounded, and whether they are arrays.
CLAIM_FIELDS = {x.split()[0]: x.endswith("array<string>") for x in schemas.CLAIMS.split(", ")}


def signals(df: DataFrame, now: Column, config: Config) -> DataFrame:
    """``df`` with the struct ``evidence``: four signals in [0, 1] and ``recent``."""
    e = F.col("extraction")
    full = [S.populated(e[name], is_array) for name, is_array in CLAIM_FIELDS.items()]
    known = [F.coalesce(F.map_contains_key(e["provenance"], name), F.lit(False)) for name in CLAIM_FIELDS]
    recent = filters.is_recent(F.col("published"), now, config.scoring.recent_paper_grace_days)
    cited = S.citation_signal(F.col("citation_count"))
    stated = F.when(e["extraction_confidence"].isNull(), UNSTATED).otherwise(S.clamp01(e["extraction_confidence"]))
    return df.withColumn(
        "evidence",
        F.struct(
            filters.has_code(e["code_link"], F.col("code_links")).cast("double").alias("code"),
            aggregates.grounded_fraction(full, known).alias("provenance"),
            stated.alias("extraction_confidence"),
            F.when(recent, F.greatest(cited, F.lit(RECENT_CITATION))).otherwise(cited).alias("citation"),
            recent.alias("recent"),
        ),
    )


def confidence(evidence: Column) -> Column:
    return S.clamp01(sum((w * evidence[k] for k, w in WEIGHTS.items()), F.lit(0.0)))


def heuristic_estimate(e: Column) -> Column:
    """Impact, applicability and effort from the extraction alone."""
    results, claims = S.populated(e["headline_results"]), S.populated(e["claimed_advantages"], True)
    effort = S.cost_effort(e["implementation_cost_estimate"])
    impact = F.lit(0.3) + F.when(results, 0.2).otherwise(0.0) + F.when(claims, 0.1).otherwise(0.0)
    return F.struct(
        impact.alias("expected_impact"),
        F.when(S.populated(e["applicability_to_our_problem"]), 0.6).otherwise(0.2).alias("applicability"),
        effort.alias("effort"),
        F.format_string("Heuristic: headline results %s, %s claimed advantage(s).", F.when(results, "present").otherwise("absent"), F.coalesce(F.size(e["claimed_advantages"]), F.lit(0)).cast("string")).alias("impact_rationale"),
        F.concat(F.lit("Heuristic from the implementation cost -> effort "), effort.cast("int").cast("string"), F.lit("/10.")).alias("effort_rationale"),
    )


def estimate(df: DataFrame, config: Config, estimates: DataFrame | None = None) -> DataFrame:
    """``df`` with the struct ``estimate``: recorded ones by ``paper_id``, or heuristic ones if the configuration says so."""
    if not config.scoring.llm_estimate_effort or estimates is None:
        return df.withColumn("estimate", heuristic_estimate(F.col("extraction")))
    own = estimates.select(F.col("paper_id").alias("_p"), F.struct("expected_impact", "applicability", "effort", "impact_rationale", "effort_rationale").alias("_e"))
    pick = lambda k, other: F.coalesce(F.col("_e")[k], F.lit(other)).alias(k)
    joined = df.join(own, df["arxiv_id"] == own["_p"], "left")
    return joined.withColumn("estimate", F.struct(*[pick(k, v) for k, v in DEFAULT_ESTIMATE.items()], pick("impact_rationale", ""), pick("effort_rationale", ""))).drop("_p", "_e")


def rice(df: DataFrame, config: Config) -> DataFrame:
    """``df`` with the struct ``rice``, its ``score`` and a ``rationale``; needs ``evidence`` and ``estimate``."""
    w, est, ev = config.scoring, F.col("estimate"), F.col("evidence")
    parts = F.struct(
        S.clamp01(est["expected_impact"] * w.weight_impact).alias("expected_impact"),
        S.clamp01(est["applicability"] * w.weight_applicability).alias("applicability"),
        S.clamp01(confidence(ev) * w.weight_confidence).alias("confidence"),
        S.clamp_effort(est["effort"]).alias("effort"),
    )
    r = F.col("rice")
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("n/a"))
    yes = lambda c: F.when(c, "True").otherwise("False")
    return (
        df.withColumn("rice", parts)
        .withColumn("score", S.rice(r["expected_impact"], r["applicability"], r["confidence"], r["effort"]))
        .withColumn(
            "rationale",
            F.format_string(
                "Impact %.2f (%s); Applicability %.2f; Confidence %.2f [code=%s, provenance=%.2f, extraction_conf=%.2f, citation=%.2f, recent=%s]; Effort %.1f/10 (%s). Score=%.4f.",
                r["expected_impact"], said(est["impact_rationale"]), r["applicability"], r["confidence"], yes(ev["code"] > 0), ev["provenance"], ev["extraction_confidence"], ev["citation"], yes(ev["recent"]), r["effort"], said(est["effort_rationale"]), F.col("score"),
            ),
        )
    )


def contributions(e: Column) -> Column:
    """The stated contributions, else method and headline results."""
    blank = lambda c: F.nullif(X.strip(c), F.lit(""))
    return F.coalesce(blank(e["contributions_summary"]), F.concat_ws(" ", blank(e["method_summary"]), F.concat(F.lit("Headline results: "), blank(e["headline_results"]))))


def description(e: Column) -> Column:
    blank = lambda c: F.nullif(X.strip(c), F.lit(""))
    return F.concat_ws("\n\n", F.concat(F.lit("Headline results: "), blank(e["headline_results"])), F.concat(F.lit("Applicability to our problem: "), blank(e["applicability_to_our_problem"])))


def item_title(e: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return X.shorten(F.coalesce(some(e["method_summary"]), some(e["problem_addressed"]), some(F.col("title")), F.concat(F.lit("Paper "), F.col("arxiv_id"))))


def backlog_items(df: DataFrame, now: Column, config: Config) -> DataFrame:
    """One primary item per paper and, if configured, one for a distinct advantage; needs ``rice`` and ``score``."""
    e = F.col("extraction")
    text = X.strip
    foundational = filters.is_foundational(F.col("citation_count"), F.col("influential_citation_count"), F.col("published"), now, config)
    shared = [
        F.col("arxiv_id").alias("paper_id"),
        text(e["applicability_to_our_problem"]).alias("applicability"),
        text(e["reviewer_notes"]).alias("reviewer_notes"),
        F.coalesce(e["dependencies_on_other_methods"], F.array().cast("array<string>")).alias("dependencies"),
        foundational.alias("foundational"),
        F.lit(schemas.NEW).alias("status"),
        now.alias("created_at"),
    ]
    names = schemas.BACKLOG.names
    first = df.select(
        F.concat("arxiv_id", F.lit("#1")).alias("id"), item_title(e).alias("title"), description(e).alias("description"), contributions(e).alias("contributions"), "rice", "score", "rationale", *shared
    ).select(*names)
    if not config.scoring.emit_secondary_items:
        return first
    method = F.lower(F.coalesce(e["method_summary"], F.lit("")))
    trimmed = F.transform(e["claimed_advantages"], lambda a: X.strip(a))
    apart = df.withColumn("_adv", F.get(F.filter(trimmed, lambda a: (F.length(a) >= 30) & ~F.contains(method, F.lower(a))), F.lit(0))).where("_adv is not null")
    r = F.col("rice")
    less = F.struct(r["expected_impact"].alias("expected_impact"), S.clamp01(r["applicability"] * 0.8).alias("applicability"), r["confidence"].alias("confidence"), r["effort"].alias("effort"))
    second = apart.withColumn("rice", less).select(
        F.concat("arxiv_id", F.lit("#2")).alias("id"),
        X.shorten("_adv").alias("title"),
        F.concat(F.lit("Isolated advantage to try: "), F.col("_adv")).alias("description"),
        F.concat(F.lit("Isolated advantage claimed by the paper: "), F.col("_adv")).alias("contributions"),
        "rice",
        S.rice(r["expected_impact"], r["applicability"], r["confidence"], r["effort"]).alias("score"),
        F.concat(F.lit("Secondary advantage of "), F.col("arxiv_id"), F.lit(". "), F.col("rationale")).alias("rationale"),
        *shared,
    )
    return first.unionByName(second.select(*names))
