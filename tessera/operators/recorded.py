"""The model boundary: requests out, recorded answers in, joined by key.

Planning writes the requests that have no answer; applying refuses to run while
one is missing.  Nothing calls a model from inside a plan."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.functions import text as X
from tessera.operators.joins import locate_quote, look_up_answers

JUDGEMENT = "RelevanceJudgment"
EXTRACTION = "ExtractionResult"
ESTIMATE = "RiceEstimate"
SCHEMAS: dict[str, T.StructType] = {
    JUDGEMENT: schemas.table("is_relevant boolean, score double, rationale string"),
    EXTRACTION: schemas.table(
        "problem_addressed string, method_summary string, key_architecture_choices array<string>, datasets array<string>, metrics array<string>, headline_results string, "
        "claimed_advantages array<string>, limitations array<string>, applicability_to_our_problem string, implementation_cost_estimate string, "
        "dependencies_on_other_methods array<string>, contributions_summary string, reviewer_notes string, code_link string, provenance_quotes map<string,string>, extraction_confidence double"
    ),
    ESTIMATE: schemas.table("expected_impact double, applicability double, effort double, impact_rationale string, effort_rationale string"),
}


#: Marks an answer of zero values that stands for one that no attempt gave.
STUB = "_stub"


class MissingAnswer(RuntimeError):
    """A request has no recorded answer."""


def requests(df: DataFrame, schema: str, cache_key: Column, prompt: Column) -> DataFrame:
    """``key, schema, prompt``, one row per key."""
    return df.select(X.request_key(schema, cache_key, prompt).alias("key"), F.lit(schema).alias("schema"), prompt.alias("prompt")).dropDuplicates(["key"])


def sound(answers: DataFrame) -> DataFrame:
    """The recorded answers that are objects whose fields have their schema's kinds; any other counts as none."""
    odd = F.lit(False)
    for name, fields in SCHEMAS.items():
        read = F.from_json("payload", T.StructType([*fields.fields, T.StructField("_odd", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_odd"})
        odd = F.when(F.startswith("key", F.lit(f"{name}:")), read["_odd"].isNotNull()).otherwise(odd)
    return answers.where(F.col("payload").rlike(r"^\s*\{") & ~odd)


def pending(reqs: DataFrame, answers: DataFrame) -> DataFrame:
    return look_up_answers(reqs, sound(answers))[1]


def answered(reqs: DataFrame, answers: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """Answers to ``schema`` requests: ``cache_key``, the answer's fields, and ``stubbed``, whether zero values stand for them; strict: none may be missing."""
    hit, missing = look_up_answers(reqs.where(F.col("schema") == schema), sound(answers))
    if strict and (row := missing.select("key").first()):
        raise MissingAnswer(row[0])
    marked = F.coalesce(F.get_json_object("payload", f"$.{STUB}") == "true", F.lit(False))
    return hit.select(F.expr("substring(key, locate(':', key) + 1)").alias("cache_key"), F.from_json("payload", SCHEMAS[schema]).alias("answer"), marked.alias("stubbed")).select("cache_key", "answer.*", "stubbed")


_ZERO = {"double": 0.0, "string": "", "boolean": False}


def zero_answer(schema: str) -> dict[str, Any]:
    """An answer of zero values: false, 0, blanks, and nothing in lists and maps."""
    return {f.name: _ZERO.get(f.dataType.simpleString(), [] if isinstance(f.dataType, T.ArrayType) else {}) for f in SCHEMAS[schema].fields}


def well_formed(found: Any, schema: str) -> bool:
    """Whether an answer is an object whose known fields have the schema's kinds; a missing field is none of them."""
    kinds = {"double": (int, float), "string": (str,), "boolean": (bool,)}
    if not isinstance(found, dict):
        return False
    for f in SCHEMAS[schema].fields:
        kind = kinds.get(f.dataType.simpleString(), (list,) if isinstance(f.dataType, T.ArrayType) else (dict,))
        if found.get(f.name) is not None and not isinstance(found[f.name], kind):
            return False
    return True


def relevance_prompt(problem: str) -> Column:
    return F.format_string("Problem:\n%s\n\nTitle: %s\n\nAbstract: %s\n\nIs this paper relevant to the problem?", F.lit(problem), F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))


def extraction_prompt(problem: str, chunks: Column) -> Column:
    body = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("[chunk "), c["index"].cast("string"), F.lit("] "), F.coalesce(c["section"], F.lit("")), F.lit("\n"), c["text"])), "\n\n")
    return F.format_string("Problem:\n%s\n\nPaper: %s\n\n%s\n\nExtract the claims, with a quote for each.", F.lit(problem), F.coalesce("title", F.lit("")), body)


def estimate_prompt(problem: str, e: Column) -> Column:
    return F.format_string("Problem:\n%s\n\nMethod: %s\nResults: %s\nCost: %s\n\nEstimate impact, applicability and effort.", F.lit(problem), e["method_summary"], e["headline_results"], e["implementation_cost_estimate"])


def extraction_rows(answers: DataFrame, chunked: DataFrame, now: Column, model: str = "recorded") -> DataFrame:
    """Extractions with their quotes located in the chunks (``paper_id, chunks``).

    A quoted field is grounded even where no chunk holds the quote; its place is null then.  The model of a stub is
    ``stub``, and its confidence 0."""
    a = answers.withColumnRenamed("cache_key", "paper_id").join(chunked.select("paper_id", "chunks"), "paper_id", "left")

    def place(quote: Column) -> Column:
        c = locate_quote(F.col("chunks"), quote)
        return F.struct(c["section"].alias("section"), c["index"].alias("chunk_index"), c["page"].alias("page"), quote.alias("quote"))

    located = F.transform_values(F.coalesce("provenance_quotes", F.create_map().cast("map<string,string>")), lambda k, q: place(q))
    by = F.when(F.col("stubbed"), "stub").otherwise(model)
    confidence = F.when(F.col("stubbed"), 0.0).otherwise(F.col("extraction_confidence"))
    return a.withColumn("provenance", located).withColumns({"model": by, "extraction_confidence": confidence, "created_at": now}).drop("provenance_quotes", "chunks", "stubbed")
