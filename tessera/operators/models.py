"""Models that answer requests: a common interface, a deterministic mock, a direct client, and their choice by configuration.

A client answers outside a plan; its answers are recorded and joined like any others
(:mod:`tessera.operators.recorded`).  Clients run on executors, one per batch iterator."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.config import Config
from tessera.operators.recorded import SCHEMAS, STUB, well_formed, zero_answer
from tessera.sources.http import HttpClient

REMINDER = "\n\nThe answer before was not valid. Give only an object of the schema; leave blank what the text does not support."


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...

    def structured(self, prompt: str, schema: str) -> dict[str, Any]: ...


@dataclass
class Mock:
    """Answers as it was told: by a handler of all calls, by what a prompt contains, by schema, else a default text or zero values.

    ``calls`` are those of this object; on executors each task has its own."""

    texts: dict[str, str] | Callable[[str], str] = field(default_factory=dict)
    answers: dict[str, dict[str, Any] | Callable[[str], dict[str, Any]]] = field(default_factory=dict)
    default: str = "mock-response"  # fixed value
    handler: Callable[[str, str, str | None], Any] | None = None  # of kind, prompt and schema; None leaves the call to the rest
    calls: list[tuple[str, str]] = field(default_factory=list)

    def _handled(self, kind: str, prompt: str, schema: str | None) -> Any:
        self.calls.append((schema or kind, prompt))
        return self.handler(kind, prompt, schema) if self.handler else None

    def complete(self, prompt: str) -> str:
        said = self._handled("complete", prompt, None)
        if said is None:
            said = self.texts(prompt) if callable(self.texts) else next((v for k, v in self.texts.items() if k in prompt), self.default)
        return str(said)

    def structured(self, prompt: str, schema: str) -> dict[str, Any]:
        found = self._handled("structured", prompt, schema)
        if found is None:
            told = self.answers.get(schema)
            found = told(prompt) if callable(told) else told
        return zero_answer(schema) if found is None else found


@dataclass
class Api:
    """A direct client of a message service that takes and gives JSON."""

    model: str
    url: str
    key: str
    http: HttpClient = field(default_factory=HttpClient)
    most: int = 4096

    def complete(self, prompt: str) -> str:
        body = {"model": self.model, "max_tokens": self.most, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
        found = json.loads(self.http.post(self.url, body, headers={"x-api-key": self.key}))
        return "".join(part.get("text", "") for part in found.get("content", []))

    def structured(self, prompt: str, schema: str) -> dict[str, Any]:
        text = self.complete(f"{prompt}\n\nAnswer with one JSON object of the fields: {', '.join(SCHEMAS[schema].names)}.")
        at, end = text.find("{"), text.rfind("}")
        return json.loads(text[at : end + 1])


def factory(config: Config) -> Callable[[], Client] | None:
    """What makes clients for the configured provider; None where answers are recorded beforehand."""
    models = config.llm
    if models.provider in ("recorded", "batch"):
        return None
    if models.provider == "mock":
        return lambda: Mock(dict(models.mock_texts), dict(models.mock_answers), models.mock_default)
    if models.provider == "api":
        key = os.environ.get(models.key_variable, "")
        return lambda: Api(models.model, models.url, key)
    raise ValueError(f"no provider {models.provider!r}")


def answer(client: Client, prompt: str, schema: str) -> dict[str, Any]:
    """A valid answer: the first, or that of one more attempt with a reminder, or zero values, marked as a stub."""
    for text in (prompt, prompt + REMINDER):
        try:
            found = client.structured(text, schema)
        except (OSError, ValueError, KeyError, TypeError):
            continue
        if well_formed(found, schema):
            return found
    return zero_answer(schema) | {STUB: True}


def answers(requests: DataFrame, make: Callable[[], Client]) -> DataFrame:
    """``key, payload`` of all ``key, schema, prompt``: one call, or two, for each request, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                rows = whole.slice(k, 256).to_pylist()
                said = [json.dumps(answer(client, r["prompt"], r["schema"])) for r in rows]
                if isinstance(client, Mock):
                    client.calls.clear()  # a task's prompts are no more looked at, and may be many
                yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.string()), pa.array(said, pa.string())], ["key", "payload"])

    return requests.select("key", "schema", "prompt").mapInArrow(run, "key string, payload string")
