"""Embedders: what turns token lists or texts into vectors, chosen by configuration."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as X
from tessera.functions import vectors as V


class Embedder(Protocol):
    name: str

    def embed(self, df: DataFrame, text: str, vector: str = "vector") -> DataFrame: ...


class Hashing:
    """Signed feature hashing; needs no model."""

    name = "hashing"

    def __init__(self, dim: int):
        self.dim = dim

    def embed(self, df: DataFrame, text: str, vector: str = "vector") -> DataFrame:
        return V.hash_embed(df.withColumn("_em_tokens", X.tokens(F.col(text))), "_em_tokens", self.dim, vector).drop("_em_tokens")


#: Other embedders by provider name; a package that has a model adds its own.
PROVIDERS: dict[str, Callable[[Config], Embedder]] = {"hashing": lambda c: Hashing(c.embedding.hashing_dim)}
#: Modules that a provider needs.
NEEDS = {"transformer": "transformers"}


def embedder(config: Config) -> Embedder:
    """The configured embedder; hashing in its place, if the configuration allows that, where it cannot be had."""
    wanted = config.embedding.provider
    there = wanted in PROVIDERS and (wanted not in NEEDS or importlib.util.find_spec(NEEDS[wanted]) is not None)
    if there:
        return PROVIDERS[wanted](config)
    if config.embedding.fallback_to_hashing:
        return PROVIDERS["hashing"](config)
    raise ValueError(f"no embedder {wanted!r}")
