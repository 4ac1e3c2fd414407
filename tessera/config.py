"""Configuration: frozen dataclasses, loaded from YAML with recursive ``extends``.

Values are bound into plans as literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Models:
    provider: str = "recorded"  # recorded | batch | mock | api
    batch_dir: str = "data/batch"
    model: str = ""
    url: str = ""
    key_variable: str = "MODEL_API_KEY"
    mock_texts: dict[str, str] = field(default_factory=dict)  # what a mock says to a prompt that holds the key
    mock_answers: dict[str, dict[str, Any]] = field(default_factory=dict)  # a mock's object for each schema
    mock_default: str = "mock-response"  # fixed value


@dataclass(frozen=True)
class Embedding:
    provider: str = "hashing"
    fallback_to_hashing: bool = True
    hashing_dim: int = 256


@dataclass(frozen=True)
class Sourcing:
    arxiv_categories: tuple[str, ...] = ("cs.LG", "cs.CV", "cs.CG")
    max_results_per_run: int = 200
    page_size: int = 100
    use_semantic_scholar: bool = True
    use_openalex: bool = True
    request_timeout_s: float = 30.0
    harvest_prefilter: bool = True


@dataclass(frozen=True)
class Relevance:
    embedding_threshold: float = 0.55
    embedding_shortlist: int = 60
    llm_threshold: float = 0.5
    use_bm25_rrf: bool = False
    rrf_alpha: float = 0.8
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75


@dataclass(frozen=True)
class Extraction:
    use_grobid: bool = False
    grobid_url: str = "http://localhost:8070"
    prefer_html: bool = True
    max_chunk_tokens: int = 1200
    max_chunks: int = 24
    limitation_section_patterns: tuple[str, ...] = ("limitation", "future work", "discussion", "conclusion")


@dataclass(frozen=True)
class Scoring:
    weight_impact: float = 1.0
    weight_applicability: float = 1.0
    weight_confidence: float = 1.0
    emit_secondary_items: bool = False
    foundational_reserved_slots: int = 5
    foundational_min_citations: int = 100
    recent_paper_grace_days: int = 365
    llm_estimate_effort: bool = True


@dataclass(frozen=True)
class Delivery:
    top_n: int = 25
    digest_window_days: int = 7
    output_dir: str = "output"
    render_html: bool = True
    title_fuzzy_threshold: float = 0.9


@dataclass(frozen=True)
class Storage:
    path: str = "data/store"


@dataclass(frozen=True)
class Config:
    name: str = "default"
    problem_statement: str = ""
    seed_papers: tuple[str, ...] = ()
    include_keywords: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    taxonomy_terms: tuple[str, ...] = ()
    llm: Models = field(default_factory=Models)
    embedding: Embedding = field(default_factory=Embedding)
    sourcing: Sourcing = field(default_factory=Sourcing)
    relevance: Relevance = field(default_factory=Relevance)
    extraction: Extraction = field(default_factory=Extraction)
    scoring: Scoring = field(default_factory=Scoring)
    delivery: Delivery = field(default_factory=Delivery)
    storage: Storage = field(default_factory=Storage)


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` on ``base``: maps merge at every level, anything else replaces."""
    both = base.keys() & over.keys()
    return base | over | {k: merge(base[k], over[k]) for k in both if isinstance(base[k], dict) and isinstance(over[k], dict)}


def _build(kind: type, data: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    out = {}
    for name, value in data.items():
        if name not in known:
            continue  # unknown keys are ignored
        default = getattr(kind(), name)
        if is_dataclass(default) and isinstance(value, dict):
            value = _build(type(default), value)
        elif isinstance(value, list):
            value = tuple(value)
        out[name] = value
    return kind(**out)


def from_dict(data: dict[str, Any]) -> Config:
    return _build(Config, data)


def _raw(path: Path) -> dict[str, Any]:
    import yaml

    data = yaml.safe_load(path.read_text()) or {}
    base = data.pop("extends", None)
    return merge(_raw(path.parent / base), data) if base else data


def load(path: str | Path) -> Config:
    """A YAML file's configuration, on top of the file it ``extends``, if any."""
    return from_dict(_raw(Path(path)))
