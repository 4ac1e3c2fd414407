"""Substring deduplication over word windows, behind a count-min prefilter.

A window is ``WIDTH`` consecutive words of one text.  A word goes if a window
covers it whose word sequence also starts in a document with a smaller id.

First pass: each group of documents sketches its windows in ``DEPTH`` rows of cells
that count up to two.  Sketches are sparse, cut into ranges of cells, and merged
range by range; the merged sketch overestimates, so a window whose cells all say
two may be repeated and every other window is not.  A range answers each group
with one bit for each cell that the group asked about, so no task, and not the
driver, ever holds the whole sketch, whose cells grow with the windows:
``CELLS_PER_WINDOW`` a row, at every size.  Second pass: only windows so estimated
are grouped, exactly, by 96 bits of hash.  A group sends, for each such window,
its occurrences in the smallest id of the group; larger ids are repeats already.
So a window that stands in a third of all documents moves once per group, not once
per document.  Last, the marks meet their documents.

All three passes read the texts from one shuffle by group.

Defined cases: null text has no words; texts of fewer than ``WIDTH`` words stay;
rows of one id are one document that does not repeat itself, whatever their
texts; equal rows get equal results; a null id is smaller than all; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import U64, coded_words, column, hash_words, longs, mix, pack, partitions, slices, small_batches, starts_of, text_bytes, unpack, window_hash, window_rows

WIDTH = 13
DEPTH = 2
CELLS_PER_WINDOW, LEAST_CELLS = 4, 1 << 16
#: Cells of one range of a sketch row, and bytes of text behind one bucket of candidates: tasks' shares, by volume and not by number of groups.
RANGE, BUCKET_BYTES = 1 << 27, 128 << 20
NO_ID = np.iinfo(np.int64).min


def _windows(part, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, text number and first word of every window of some texts."""
    codes, words, n = coded_words(column(part, "text"))
    first, doc = window_rows(n, width)
    if not len(first):
        return np.zeros(0, U64), np.zeros(0, U64), doc, first
    a, b = hash_words(words)
    one, two = window_hash(a[codes], width, 11)[first], window_hash(b[codes], width, 12)[first]
    return one, two, doc, first - starts_of(n)[:-1][doc]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _table(schema: str, batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches([*batches, _batch(schema, [])])


def cells_of(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h + U64(row * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(64 - bits)).astype(np.int64)


def _asked(h: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of windows, ascending, and whether more than one window stands in each."""
    cells = np.sort(cells_of(h, row, bits))
    at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[at], np.diff(np.append(at, len(cells))) > 1


SKETCH = "place long, g long, packed binary"


def _sketches(docs: DataFrame, width: int, bits: int, size: int) -> DataFrame:
    """Per sketch row and range (``place``) and group: the cells asked about, and those that count two."""

    def sketch(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([_windows(part, width)[0] for batch in batches for part in slices(batch)])
        if not len(h):
            return
        for row in range(DEPTH):
            cells, twice = _asked(h, row, bits)
            ranges = cells // size
            cut = np.flatnonzero(np.diff(ranges)) + 1
            parts = zip(np.split(cells, cut), np.split(twice, cut), strict=True)
            yield _batch(SKETCH, [(row << 32 | int(c[0] // size), key[0].as_py(), pack(np.diff(c % size, prepend=0).astype(np.uint32), np.packbits(t))) for c, t in parts])

    return docs.groupBy("g").applyInArrow(sketch, SKETCH)


def _replies(sketches: DataFrame, size: int) -> DataFrame:
    """To each group, for each of its ranges: one bit a cell that it asked about, set if the merged sketch counts two."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, asked = np.zeros(size, np.uint8), []
        for batch in batches:
            for g, packed in zip(batch.column("g").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                steps, more = unpack(packed)
                cells = np.cumsum(steps, dtype=np.int64)
                counts[cells] = np.minimum(counts[cells] + 1 + np.unpackbits(more, count=len(cells)), 2)
                asked.append((g, packed))
        for k in range(0, len(asked), 64):
            out = []
            for g, packed in asked[k : k + 64]:
                cells = np.cumsum(unpack(packed)[0], dtype=np.int64)
                out.append((key[0].as_py(), g, pack(np.packbits(counts[cells] > 1), np.array([len(cells)]))))
            yield _batch(SKETCH, out)

    return sketches.groupBy("place").applyInArrow(merge, SKETCH)


FOUND = "bucket long, packed binary"


def _candidates(docs: DataFrame, replies: DataFrame, width: int, bits: int, buckets: int) -> DataFrame:
    """Packed occurrences by bucket of their hash (``bucket >= 0``), and marks that a group settles itself (``bucket = -1 - g``)."""

    def find(own: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _table(FOUND, iter(()))
        held: list[tuple] = []
        texts = 0
        names: list[np.ndarray] = []  # id, row key, group of the texts
        for part in slices(own):
            one, two, doc, first = _windows(part, width)
            held.append((one, (two >> U64(32)).astype(np.uint32), (doc + texts).astype(np.int32), first.astype(np.int32)))
            names.append(np.stack([longs(part, "doc_id", NO_ID), longs(part, "key"), longs(part, "g").astype(np.int64)]))
            texts += part.num_rows
        one, two, doc, first = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        bit: dict[int, list[np.ndarray]] = {row: [] for row in range(DEPTH)}
        for place, packed in sorted(zip(told.column("place").to_pylist(), told.column("packed").to_pylist(), strict=True)):
            packed, size = unpack(packed)
            bit[place >> 32].append(np.unpackbits(packed, count=int(size[0])))
        seen = np.arange(len(one))
        for row in range(DEPTH):
            repeated = _asked(one, row, bits)[0][np.concatenate(bit[row]) > 0]
            if not len(repeated):
                return _table(FOUND, iter(()))
            cells = cells_of(one[seen], row, bits)
            at = np.minimum(np.searchsorted(repeated, cells), len(repeated) - 1)
            seen = seen[repeated[at] == cells]
        return _table(FOUND, emit(one[seen], two[seen], doc[seen], first[seen], np.concatenate(names, axis=1)))

    def emit(one: np.ndarray, two: np.ndarray, doc: np.ndarray, first: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(one):
            return
        ids, keys, groups = names
        place = np.unique(ids, return_inverse=True)[1]  # rank of the id
        order = np.lexsort((place[doc], two, one))
        one, two, doc, first = one[order], two[order], doc[order], first[order]
        start = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        least = place[doc][np.maximum.accumulate(np.where(start, np.arange(len(one)), 0))]
        own = place[doc] == least
        yield from marks(keys, groups, doc[~own], first[~own])
        one, two, doc, first = one[own], two[own], doc[own], first[own]
        cut = np.searchsorted(one, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64))
        rows = []
        for b, (a, c, d, f) in enumerate(zip(np.split(one, cut), np.split(two, cut), np.split(doc, cut), np.split(first, cut), strict=True)):
            if len(a):
                some, where = np.unique(d, return_inverse=True)
                rows.append((b, pack(np.diff(a, prepend=a[:1]), a[:1], c, where.astype(np.uint32), f.astype(np.uint32), ids[some], keys[some], groups[some].astype(np.uint32))))
        yield _batch(FOUND, rows)

    return docs.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(find, FOUND)


def marks(keys: np.ndarray, groups: np.ndarray, doc: np.ndarray, first: np.ndarray, name: str = "bucket") -> Iterator[pa.RecordBatch]:
    """Rows of first words of repeated windows, packed by the group of their text."""
    order = np.lexsort((first, doc, groups[doc]))
    doc, first = doc[order], first[order]
    g = groups[doc]
    cut = np.flatnonzero(np.diff(g)) + 1
    rows = []
    for d, f in zip(np.split(doc, cut), np.split(first, cut), strict=True):
        if len(d):
            some, at = np.unique(d, return_index=True)
            g = int(groups[d[0]])
            rows.append((-1 - g if name == "bucket" else g, pack(keys[some], at.astype(np.uint32), np.diff(f, prepend=0).astype(np.int32))))
    yield _batch(f"{name} long, packed binary", rows)


def _repeats(candidates: DataFrame) -> DataFrame:
    """Marks per group of documents: ``g, packed``."""

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        if bucket < 0:  # settled before
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket] * batch.num_rows, pa.int64()), batch.column("packed")], ["g", "packed"])
            return
        parts, texts = [], 0
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                steps, start, two, doc, first, ids, keys, groups = unpack(packed)
                parts.append((np.cumsum(steps, dtype=U64) + start[0], two, doc + np.uint32(texts), first, ids, keys, groups))
                texts += len(ids)
        one, two, doc, first, ids, keys, groups = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        place = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place[doc], two, one))
        one, two, doc, first = one[order], two[order], doc[order], first[order]
        start = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        least = place[doc][np.maximum.accumulate(np.where(start, np.arange(len(one)), 0))]
        later = place[doc] != least
        yield from marks(keys, groups.astype(np.int64), doc[later].astype(np.int64), first[later].astype(np.int64), "g")

    return candidates.groupBy("bucket").applyInArrow(settle, "g long, packed binary")


def _kept(docs: DataFrame, repeats: DataFrame, width: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + with_text]

    def cut(own: pa.Table, marked: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in kinds]
        key_at: dict[int, list[tuple[int, int]]] = {}
        firsts, total = [], 0
        for packed in marked.column("packed").to_pylist():
            keys, at, steps = unpack(packed)
            first = np.cumsum(steps)
            ends = np.append(at[1:], len(first))
            for k, a, b in zip(keys.tolist(), at.tolist(), ends.tolist(), strict=True):
                key_at.setdefault(k, []).append((total + a, total + b))
            firsts.append(first.astype(np.int32))
            total += len(first)
        first = np.concatenate(firsts) if firsts else np.zeros(0, np.int32)
        for part in own.to_batches(max_chunksize=256):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for doc, key, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), texts, strict=True):
                words = (text or b"").split()
                n = len(words)
                spans = key_at.get(key)
                if spans:
                    change = np.zeros(n + 1, np.int32)
                    for a, b in spans:
                        np.add.at(change, first[a:b], 1)
                        np.add.at(change, first[a:b] + width, -1)
                    words = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]
                kept = b" ".join(words)
                for to, value in zip(rows, (doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    to.append(value)
        arrays = [pa.array(x, kind) if k < 4 else pa.array(x, pa.binary()).cast(pa.string()) for k, (x, kind) in enumerate(zip(rows, kinds, strict=True))]
        return pa.table(dict(zip([x.split()[0] for x in schema.split(", ")], arrays, strict=True)))

    return docs.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(cut, schema)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text``."""
    spark = docs.sparkSession
    small_batches(spark)
    n_bytes = text_bytes(docs)
    n, buckets = partitions(spark, n_bytes), partitions(spark, n_bytes, BUCKET_BYTES)
    bits = (max(int(n_bytes / 6 * CELLS_PER_WINDOW), LEAST_CELLS) - 1).bit_length()  # words have six bytes, about
    size = min(RANGE, 1 << bits)
    key = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", key.alias("key"), F.pmod(key, F.lit(n)).cast("long").alias("g"))
    replies = _replies(_sketches(rows, width, bits, size), size)
    repeats = _repeats(_candidates(rows, replies, width, bits, buckets))
    return _kept(rows, repeats, width, with_text)
