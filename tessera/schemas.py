"""Typed tables: the source of truth for every stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _cut(text: str) -> list[str]:
    """Parts of a list at its outer commas."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def datatype(text: str) -> T.DataType:
    """A type's short form; it needs no session, so that schemas stand at import."""
    name, _, inner = text.strip().partition("<")
    inner = inner.removesuffix(">")
    if name == "array":
        return T.ArrayType(datatype(inner))
    if name == "map":
        return T.MapType(*map(datatype, _cut(inner)))
    if name == "struct":
        return T.StructType([T.StructField(k, datatype(v)) for k, _, v in (x.partition(":") for x in _cut(inner))])
    return _SIMPLE[name]


def table(text: str) -> T.StructType:
    """A table's schema from ``name type, name type, ...``."""
    return T.StructType([T.StructField(k, datatype(v)) for k, _, v in (x.partition(" ") for x in _cut(text))])


SEEN, RELEVANT, IRRELEVANT, PARSED, EXTRACTED, SCORED, ARCHIVED = "SEEN RELEVANT IRRELEVANT PARSED EXTRACTED SCORED ARCHIVED".split()
PAPER_STATUSES = (SEEN, RELEVANT, IRRELEVANT, PARSED, EXTRACTED, SCORED, ARCHIVED)
NEW, ACTIVE = "NEW", "ACTIVE"
BACKLOG_STATUSES = (NEW, ACTIVE, ARCHIVED)

PAPERS = table(
    "arxiv_id string, version int, doi string, corpus_id string, openalex_id string, title string, abstract string, "
    "authors array<string>, categories array<string>, published timestamp, updated timestamp, pdf_url string, html_url string, "
    "code_links array<string>, citation_count int, influential_citation_count int, tldr string, fields_of_study array<string>, "
    "reference_ids array<string>, status string, relevance_score double, relevance_rationale string, relevance_method string, "
    "section_hash string, source string, extra map<string,string>, created_at timestamp, updated_at timestamp"
)
SECTION = "struct<title:string,text:string,page:int>"
CHUNK = "struct<index:int,text:string,section:string,page:int>"
PROVENANCE = "struct<section:string,chunk_index:int,page:int,quote:string>"
CLAIMS = (
    "problem_addressed string, method_summary string, key_architecture_choices array<string>, datasets array<string>, metrics array<string>, "
    "headline_results string, claimed_advantages array<string>, limitations array<string>, applicability_to_our_problem string, "
    "implementation_cost_estimate string, dependencies_on_other_methods array<string>"
)
EXTRACTIONS = table(
    f"paper_id string, {CLAIMS}, contributions_summary string, reviewer_notes string, code_link string, "
    f"provenance map<string,{PROVENANCE}>, extraction_confidence double, model string, created_at timestamp"
)
BACKLOG = table(
    "id string, paper_id string, title string, description string, contributions string, applicability string, reviewer_notes string, "
    "rice struct<expected_impact:double,applicability:double,confidence:double,effort:double>, score double, dependencies array<string>, "
    "foundational boolean, status string, rationale string, created_at timestamp"
)
EDGES = table("src string, dst string, source string, paper_id string")
EMBEDDINGS = table("paper_id string, model string, dim int, vector array<float>")
STATE = table("key string, value string")
AUDIT = table("at timestamp, event string, detail string")
ANSWERS = table("key string, payload string")

#: Keys by table; a table without one is only appended to.
KEYS = {"papers": ["arxiv_id"], "embeddings": ["paper_id"], "extractions": ["paper_id"], "backlog": ["id"], "dependencies": ["src", "dst", "source"], "state": ["key"], "answers": ["key"]}
TABLES = {"papers": PAPERS, "embeddings": EMBEDDINGS, "extractions": EXTRACTIONS, "backlog": BACKLOG, "dependencies": EDGES, "state": STATE, "answers": ANSWERS, "audit_log": AUDIT}


def violations() -> dict[str, Column]:
    """Conditions that no stored row may meet, by table and name."""
    outside = lambda c: ~F.coalesce(c.between(0, 1), F.lit(True))
    return {
        "papers.version": F.col("version") < 1,
        "papers.status": ~F.col("status").isin(*PAPER_STATUSES),
        "papers.relevance_score": outside(F.col("relevance_score")),
        "extractions.extraction_confidence": outside(F.col("extraction_confidence")),
        "backlog.status": ~F.col("status").isin(*BACKLOG_STATUSES),
        "backlog.rice": outside(F.col("rice.expected_impact")) | outside(F.col("rice.applicability")) | outside(F.col("rice.confidence")) | (F.col("rice.effort") <= 0),
    }
