"""SimHash near-deduplication by a grid over segment popcounts.

A document's fingerprint holds the majority of each bit over the XXH64 of its word
shingles, repeats included.  Rows of one fingerprint form a class, and all after that
sees eight bytes a class.

Each fingerprint is embedded as the bit counts of its ``SEGMENT`` -bit segments, written
in unary in the segment's own bits, so that the Manhattan distance of two embeddings is
the number of differing bits of two words.  One bit changes one count by one at most:
the Manhattan distance never exceeds the number of differing fingerprint bits.  Segments
are dealt into ``BLOCKS`` blocks.  Of two embeddings within ``RADIUS``, at least ``BLOCKS -
RADIUS`` blocks are at distance zero, so the pair shares a unit cell of the grid spanned
by one of the choices of that many blocks; no pair is lost.  In a cell, pairs whose
whole Manhattan distance is within the radius are verified on the fingerprints.

A cell of two is verified where it is counted.  Larger cells are searched in tasks of
about ``BLOCK`` classes: a class that has been reached is not compared again, so a group
of near copies gives about a link a class, not all pairs.  Cells of more than ``BLOCK``
classes are dealt into random blocks, others in every grid.  After the components of
these links are known, the classes of such a cell outside its largest component meet
all its classes, block by block, which makes the search whole; a cell of ``m`` classes
that nothing links costs ``m * m / BLOCK`` rows there.

Defined cases: a text without words, or null, has fingerprint zero and is linked like
any other; with fewer words than a shingle has, the whole sequence is the one shingle;
a null id is smaller than all; repeated rows each have a row of the result; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import U64, column, longs, slices, small_batches, split_words, starts_of, stored
from tessera.llm.near_dedup import components

SHINGLE, SEED = 3, 42
RADIUS, SEGMENT, BLOCKS = 3, 2, 6
#: Classes of a cell that one task compares with one another.
BLOCK = 8192
#: Shingles hashed at once, and the largest cells that are compared side by side.
STEP, SMALL = 1 << 18, 8
LOW = 0x5555555555555555


# ------------------------------------------------------------------ fingerprints


def fingerprints(texts: pa.Array, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text; its memory is that of the texts and of ``STEP`` shingles."""
    flat, n = split_words(texts, lower=True)
    each = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    total, head = int(each.sum()), starts_of(each)
    ones = np.zeros((len(n), 64), np.int64)
    if total:
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = starts_of(size)  # of the words in one run of all of them, a blank between two
        run = b" ".join(flat.cast(pa.large_binary()).to_pylist())
        word = starts_of(n)
        for k in range(0, total, STEP):
            i = np.arange(k, min(k + STEP, total))
            doc = np.searchsorted(head, i, side="right") - 1
            first = word[doc] + i - head[doc]
            last = np.minimum(first + width, word[doc + 1])
            h = [xxhash.xxh64_intdigest(run[a:b], seed) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)]
            bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cut = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1])
            ones[doc[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > each[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U64)


def _fingerprinted(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(fingerprints(column(part, "text")).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, fp long")


# ------------------------------------------------------------------ the grid


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of ``blocks - radius`` blocks of segments, as signed numbers."""
    n = 64 // SEGMENT
    edge = [n * k // blocks * SEGMENT for k in range(blocks + 1)]
    own = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(blocks)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(own, blocks - radius))]


def unary(x: np.ndarray) -> np.ndarray:
    """Segments of two bits with their ones moved down: the bit counts in unary."""
    low, high, m = x & U64(LOW), (x >> U64(1)) & U64(LOW), U64(1)
    return (low | high) | ((low & high) << m)


def unary_column(x: Column) -> Column:
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def near(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: the Manhattan distance of their embeddings first, then their bits."""
    out = np.bitwise_count(ux ^ uy) <= RADIUS
    out[out] = np.bitwise_count((x ^ y)[out]) <= RADIUS
    return out


def small_links(x: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links inside units of at most ``SMALL`` rows, units one after the other."""
    u, a, b = unary(x), [np.zeros(0, U64)], [np.zeros(0, U64)]
    for lag in range(1, min(SMALL, len(x))):
        (k,) = np.nonzero(unit[lag:] == unit[:-lag])
        k = k[near(x[k], x[k + lag], u[k], u[k + lag])]
        a.append(x[k])
        b.append(x[k + lag])
    return np.concatenate(a), np.concatenate(b)


def spanning_links(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links of all pairs join; a fingerprint that is reached is compared no more."""
    left, u, a, b = x, unary(x), [np.zeros(0, U64)], [np.zeros(0, U64)]
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left, u = [int(left[0])], left[1:], u[1:]
        own = U64(todo.pop())
        hit = near(left, own, u, unary(np.array([own])))
        if hit.any():
            a.append(np.full(int(hit.sum()), own))
            b.append(left[hit])
            todo += left[hit].tolist()
            left, u = left[~hit], u[~hit]
    return np.concatenate(a), np.concatenate(b)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])


def _unit_links(members: DataFrame) -> DataFrame:
    """``a, b``: links inside each ``grid, cell, salt`` of ``members``."""
    keys = ("grid", "cell", "salt")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([longs(batch, k) for k in (*keys, "fp")])], axis=1)
            cut = np.concatenate([[0], np.nonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))[0] + 1])
            rest = rows[:, cut[-1] :]  # the last unit may go on in the next batch
            yield from settle(rows[3, : cut[-1]].view(U64), cut)
        yield from settle(rest[3].view(U64), np.array([0, rest.shape[1]]))

    def settle(x: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(cut)
        unit = np.repeat(np.arange(len(size)), size)
        small = (size <= SMALL)[unit]
        yield _links(*small_links(x[small], unit[small]))
        for k in np.nonzero(size > SMALL)[0].tolist():
            yield _links(*spanning_links(x[cut[k] : cut[k + 1]]))

    return members.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(search, "a long, b long")


def _hot_links(members: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """``a, b``: components that a link joins, from ``members`` of cells of several blocks."""
    cell = ["grid", "cell"]
    rows = stored(members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "hot")
    most = rows.groupBy(*cell, "root").agg(F.count("*").alias("m")).groupBy(*cell).agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("m"))
    most = most.select(*cell, F.col("main.root").alias("main"), F.ceil((F.col("m") - F.col("main.m")) / block).cast("int").alias("chunks")).where("chunks > 0")
    rows = rows.join(most, cell)
    spread = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "fp"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    all_ = rows.select(*cell, spread(1, "blocks").alias("block"), each("chunks").alias("chunk"), F.lit(1).alias("place"), "fp", "root")
    probes = rows.where("root <> main").select(*cell, each("blocks").alias("block"), spread(2, "chunks").alias("chunk"), F.lit(0).alias("place"), "fp", "root")
    keys = (*cell, "block", "chunk")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: tuple = ()
        held: list[tuple[int, int]] = []
        for batch in batches:
            rows = np.stack([longs(batch, k) for k in (*keys, "place", "fp", "root")])
            cut = np.concatenate([[0], np.nonzero((rows[:5, 1:] != rows[:5, :-1]).any(axis=0))[0] + 1, [rows.shape[1]]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a == b:
                    continue
                if (now := tuple(rows[:4, a].tolist())) != unit:
                    unit, held = now, []
                if not rows[4, a]:
                    held += zip(*rows[5:, a:b].tolist(), strict=True)
                    continue
                x, root = rows[5, a:b].copy().view(U64), rows[6, a:b]
                u = unary(x)
                for fp, own in held:
                    one = np.array([fp]).view(U64)
                    hit = np.unique(root[near(x, one, u, unary(one)) & (root != own)])
                    yield _links(np.full(len(hit), own), hit)

    dealt = probes.unionByName(all_).repartition(*keys).sortWithinPartitions(*keys, "place")
    return dealt.select(*keys, "place", "fp", "root").mapInArrow(compare, "a long, b long").distinct()


# ------------------------------------------------------------------ the operator


def linked_classes(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node, root`` for every fingerprint ``fp`` of ``classes`` that a link reaches."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), unary_column(F.col("fp")).bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks())])).alias("at")
    cells = classes.select("fp", at).select("at.grid", "at.cell", "fp")
    counted = cells.groupBy("grid", "cell").agg(F.count("*").alias("m"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    counted = stored(counted.where("m > 1"), "cells")
    pairs = counted.where((F.col("m") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    busy = counted.where("m > 2").select("grid", "cell", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    members = cells.join(busy.hint("merge"), ["grid", "cell"])
    members = stored(members.withColumn("salt", F.pmod(F.xxhash64("grid", "fp"), F.col("blocks")).cast("int")), "members")
    roots = stored(components(_unit_links(members).unionByName(pairs)), "roots")
    hot = members.where("blocks > 1").drop("salt")
    if hot.isEmpty():
        return roots
    joined = components(_hot_links(hot, roots, block)).select(F.col("node").alias("first"), F.col("root").alias("last"))
    every = classes.select(F.col("fp").alias("node")).join(roots, "node", "left").withColumn("first", F.coalesce("root", "node"))
    return every.join(joined, "first", "left").select("node", F.coalesce("last", "first").alias("root"))


def least_id(name: str) -> Column:
    return F.when(F.count_if(F.col(name).isNull()) == 0, F.min(name))


def similar_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp`` (the fingerprint as a signed number) and ``component_id``."""
    small_batches(docs.sparkSession)
    signed = stored(_fingerprinted(docs), "fingerprints")
    classes = stored(signed.groupBy("fp").agg(least_id("doc_id").alias("least")), "classes")
    roots = linked_classes(classes, block)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(least_id("least").alias("component_id"))
    named = stored(named.join(first, "root").select("fp", "component_id"), "components")
    return signed.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")
