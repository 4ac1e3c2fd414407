"""Many patterns in one pass: an automaton over Arrow batches in place of a condition for each pattern.

Patterns are dealt by hash into parts of at most ``PART_BYTES``; a part is what the driver collects and a task
holds at once, and the texts are read once for each part, so any number of patterns is
found whole."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.store import materialize

#: Bytes of patterns in one automaton.
PART_BYTES = 8 << 20
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def quoted(text: Column) -> Column:
    """A quote, or a text that may hold it: lower case, white space collapsed."""
    return F.lower(X.collapse(F.coalesce(text, F.lit(""))))


def occurrences(texts: DataFrame, key: str, text: Column, patterns: DataFrame, bordered: bool = False, part: int = PART_BYTES) -> DataFrame:
    """``key, pattern``: each text with each of the strings ``pattern`` that it holds, once.

    ``bordered``: a pattern without a space or hyphen counts only between characters other than ``[a-z0-9]``."""
    distinct = materialize(patterns.select("pattern").where("pattern <> ''").distinct())
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part))
    rows = texts.select(F.col(key).alias("_key"), text.alias("_text"))
    schema = f"_key {texts.schema[key].dataType.simpleString()}, pattern string"

    def search(of: int) -> DataFrame:
        words = [r[0] for r in distinct.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == of).collect()]  # of about the bytes of a part

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in words:
                machine.add_word(w, (len(w), bordered and " " not in w and "-" not in w, w))
            if words:
                machine.make_automaton()
            for batch in batches:
                keys, found = [], []
                for k, value in enumerate(batch.column("_text").to_pylist() if words else []):
                    held = set()
                    for end, (size, alone, w) in machine.iter(value or ""):
                        start = end - size + 1
                        if not alone or ((not start or value[start - 1] not in _WORD) and (end + 1 == len(value) or value[end + 1] not in _WORD)):
                            held.add(w)
                    keys += [k] * len(held)
                    found += held
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(keys, pa.int64())), pa.array(found, pa.string())], ["_key", "pattern"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [search(k) for k in range(parts)]).withColumnRenamed("_key", key)


def first_matches(texts: DataFrame, key: str, text: Column, quotes: DataFrame, of: str, quote: Column, order: str | None = None, part: int = PART_BYTES) -> DataFrame:
    """``of, key, n``: for each quote the first text by ``order`` (``key``, if not given) that holds it, and how many do; quotes without one are left out.

    Quotes match without regard to case and to the kind and length of white space; blank ones match nothing."""
    asked = materialize(quotes.select(F.col(of), quoted(quote).alias("pattern")).where("pattern <> ''"))
    found = occurrences(texts, key, quoted(text), asked, part=part)
    if order:
        found = found.join(texts.select(key, order), key)
    best = found.groupBy("pattern").agg(F.min_by(key, order or key).alias(key), F.count("*").alias("n"))
    return asked.join(best.hint("merge"), "pattern").select(of, key, "n")
