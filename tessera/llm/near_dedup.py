"""MinHash near-deduplication with exact links and connected components.

A document's set holds the hashes of its distinct five-word shingles.  Documents
of equal sets (128 bits of hash) form a class and one row of the smallest id stands
for it.  Signatures of ``BANDS * BAND_ROWS`` universal hash minima are cut into
bands; classes that share a band are in one bucket.  A true link is in no bucket
with probability ``(1 - J ** BAND_ROWS) ** BANDS``, about 1e-6 at J = 0.75.

Only edges are verified, on the full sets, in two rounds whose tasks are bounded
in bytes.  First, every member of a bucket against the bucket's hub: the members'
sets stream past that of the hub, a hot hub's in several salted streams.  The links
found make components.  Then buckets that still hold several components: their
members outside the bucket's largest component meet all its members, block against
block; pairs whose estimate is within ``SLACK`` of the threshold, and that no link
has joined yet, are verified.  Members of one component are not compared, so a
group of near copies costs its size, not the square of it.  Components come from
alternating large-star and small-star over the links of each round.

Defined cases: texts without words, or null, have an empty set and are linked
with nothing; texts of one to four words have one shingle, the whole sequence;
rows equal in id and text share a result, and other rows of one id are told apart
by their text, the id's component being that of its own row; a null id is smaller
than all; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import U64, coded_words, column, hash_words, keep_named, mix, odd_numbers, partitions, row_keys, slices, small_batches, starts_of, stored, window_hash

SHINGLE = 5
SHARE = (75, 100)
BANDS, BAND_ROWS = 36, 4
MINIMA = BANDS * BAND_ROWS
#: How far an estimate may lie under the threshold: more than five standard deviations.
SLACK = 0.2
#: Bytes of sets in one side of a block comparison, and in one stream past a hub.
BLOCK_BYTES, STREAM_BYTES = 4 << 20, 12 << 20
#: Parts in which the members of one hub learn how many streams it has.
SLICES = 64
_A, _B = odd_numbers(MINIMA, 21), odd_numbers(MINIMA, 22)


# ------------------------------------------------------------------ sets and signatures


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words lower-cased in A-Z."""
    codes, words, n = coded_words(texts, lower=True)
    h = hash_words(words)[0][codes] if len(codes) else np.zeros(0, U64)
    at = starts_of(n)
    windows = window_hash(h, width, 31)
    out = []
    for k, size in enumerate(n.tolist()):
        a = at[k]
        if size >= width:
            own = np.sort(windows[a : a + size - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif size:
            out.append(window_hash(h[a : a + size], size, 40 + size))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(own: np.ndarray, step: int = 4096) -> np.ndarray:
    """The least of each universal hash over the set, its upper half."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(own), step):
        least = np.minimum(least, (own[k : k + step, None] * _A + _B).min(axis=0))
    return (least >> U64(32)).astype(np.uint32)


def _signatures(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(column(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"),
                        column(part, "_k1"),
                        column(part, "_k2"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "_k1", "_k2", "n_shingles", "set_hash", "signature"],
                )

    return docs.mapInArrow(sign, "doc_id long, _k1 long, _k2 long, n_shingles long, set_hash binary, signature binary")


def _bands(signed: DataFrame) -> DataFrame:
    """``node, band``: each band's minima and number, hashed to 64 bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                minima = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, BAND_ROWS).astype(U64)
                h = np.zeros(minima.shape[:2], U64) + np.arange(1, BANDS + 1, dtype=U64)
                for row in range(BAND_ROWS):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + minima[:, :, row])
                node = np.repeat(part.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(h.reshape(-1).view(np.int64))], ["node", "band"])

    return signed.select("node", "signature").mapInArrow(cut, "node long, band long")


# ------------------------------------------------------------------ components


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an edge, by alternating large-star and small-star.

    ``root`` is the least node of the component.  Each round is written to shared
    storage.  Stars are made from per-node minima joined back, so that no node's
    neighbours are gathered."""
    small = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = small.select("u", "v").unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: greater neighbours of u go to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        star = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(star, "edges")
        same = [x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for x in (small, new)]
        small = new
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Union:
    """Union-find whose roots are least members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def linked(x: np.ndarray, y: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    """Whether two sorted sets overlap by the share or more of their union."""
    if min(len(x), len(y)) * share[1] < share[0] * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return share[1] * both >= share[0] * (len(x) + len(y) - both)


def likely(block: np.ndarray, sizes: np.ndarray, table: np.ndarray, others: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``block``, row of ``table``), low bytes of minima, whose estimate comes near the share."""
    least = int((share[0] / share[1] - SLACK) * MINIMA)
    step = max(1, (1 << 21) // max(1, len(table)))
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    columns = np.ascontiguousarray(table.T)
    for k in range(0, len(block), step):
        part = block[k : k + step]
        same = np.zeros((len(part), len(table)), np.uint8)
        for j in range(MINIMA):
            same += part[:, j, None] == columns[j]
        a, b = sizes[k : k + step, None], others[None, :]
        r, c = np.nonzero((same >= least) & (np.minimum(a, b) * share[1] >= share[0] * np.maximum(a, b)))
        rows.append(r + k)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _described(members: DataFrame) -> DataFrame:
    """``node, mini, hashes, n_bytes`` of ``node, signature, text``: low bytes of the minima, the set, its size."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [x.tobytes() for x in shingle_sets(column(part, "text"))]
                minis = [s[::4] for s in part.column("signature").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(minis, pa.binary()), pa.array(sets, pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["node", "mini", "hashes", "n_bytes"]
                )

    return members.mapInArrow(describe, "node long, mini binary, hashes binary, n_bytes long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _hub_links(stars: DataFrame, sets: DataFrame, n: int, stream: int) -> DataFrame:
    """``a, b``: the hubs and nodes of ``stars`` that are linked; each stream begins with its hub's set."""
    spread = lambda c, k: F.pmod(F.xxhash64(c), k).cast("int")
    theirs = stars.join(sets.select("node", "n_bytes"), "node")
    streams = theirs.groupBy("hub").agg((F.sum("n_bytes") / stream + 1).cast("int").alias("streams"))
    # a hub of several streams meets its members by slice, so that no task holds them all
    hot = streams.where("streams > 1").select("hub", "streams", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    sliced = stars.withColumn("slice", spread(F.col("node"), F.lit(SLICES))).join(hot, ["hub", "slice"], "left")
    members = sliced.select("hub", spread(F.col("node"), F.coalesce("streams", F.lit(1))).alias("salt"), F.lit(1).alias("place"), "node")
    heads = streams.select("hub", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("salt"), F.lit(0).alias("place"), F.col("hub").alias("node"))
    dealt = members.unionByName(heads).join(sets.select("node", "hashes").hint("merge"), "node").repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "place", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U64)
        for batch in batches:
            out = []
            for hub, place, node, hashes in zip(*(batch.column(k).to_pylist() for k in ("hub", "place", "node", "hashes")), strict=True):
                x = np.frombuffer(hashes, U64)
                if not place:
                    own = x
                elif linked(own, x):
                    out.append((hub, node))
            yield _pairs(out)

    return dealt.select("hub", "place", "node", "hashes").mapInArrow(compare, "a long, b long")


def _block_links(shared: DataFrame, roots: DataFrame, sets: DataFrame, n: int, block: int) -> DataFrame:
    """``a, b``: roots that a link joins, from the buckets of ``shared`` (``band, node``) that hold several."""
    named = stored(shared.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "named")
    mixed = named.groupBy("band").agg(
        F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    )
    # a bucket of two was settled with its hub; of buckets with the same members one is enough
    open_ = mixed.where("m > 2 and low < high").groupBy("m", "x", "y").agg(F.min("band").alias("band")).select("band")
    rows = named.join(open_, "band").join(sets.select("node", "n_bytes"), "node")
    by_root = rows.groupBy("band", "root").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("n_bytes"))
    per = by_root.groupBy("band").agg(F.max(F.struct("m", "root", "n_bytes")).alias("main"), F.sum("n_bytes").alias("n_bytes"))
    per = per.select(
        "band",
        F.col("main.root").alias("main"),
        (F.col("n_bytes") / block + 1).cast("int").alias("blocks"),
        ((F.col("n_bytes") - F.col("main.n_bytes")) / block + 1).cast("int").alias("chunks"),
    )
    rows = stored(rows.join(per, "band").select("band", "node", "root", (F.col("root") != F.col("main")).alias("outside"), "blocks", "chunks"), "open")
    spread = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    members = rows.select("band", "node", "root", "outside", spread(1, "blocks").alias("block"), each("chunks").alias("chunk"), F.lit(1).alias("place"))
    probes = rows.where("outside").select("band", "node", "root", "outside", each("blocks").alias("block"), spread(2, "chunks").alias("chunk"), F.lit(0).alias("place"))
    dealt = probes.unionByName(members).join(sets.select("node", "mini", "hashes").hint("merge"), "node")
    dealt = dealt.repartition(n, "band", "block", "chunk").sortWithinPartitions("band", "block", "chunk", "place", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])  # probes and members of one unit
        unit = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, at, chunk, place, *row in zip(*(batch.column(k).to_pylist() for k in ("band", "block", "chunk", "place", "node", "root", "outside", "mini", "hashes")), strict=True):
                if (band, at, chunk) != unit:
                    out += settle(*held)
                    held, unit = ([], []), (band, at, chunk)
                held[place].append(row)
            yield _pairs(out)
        yield _pairs(settle(*held))

    def settle(probes: list, members: list) -> list[tuple[int, int]]:
        if not probes or not members:
            return []
        numbers = {r: k for k, r in enumerate(sorted({x[1] for x in probes} | {x[1] for x in members}))}
        names, union, out = list(numbers), Union(len(numbers)), []
        table = lambda rows: np.stack([np.frombuffer(x[3], np.uint8) for x in rows])
        size = lambda rows: np.array([len(x[4]) for x in rows])
        for i, j in zip(*(x.tolist() for x in likely(table(probes), size(probes), table(members), size(members))), strict=True):
            a, b = probes[i], members[j]
            x, y = numbers[a[1]], numbers[b[1]]
            if b[2] and b[0] <= a[0] or union.root(x) == union.root(y):
                continue  # of two probes the pair comes twice
            if linked(np.frombuffer(a[4], U64), np.frombuffer(b[4], U64)):
                union.join(x, y)
                out.append((names[x], names[y]))
        return out

    return dealt.select("band", "block", "chunk", "place", "node", "root", "outside", "mini", "hashes").mapInArrow(compare, "a long, b long")


# ------------------------------------------------------------------ the operator


def near_groups(docs: DataFrame, block: int = BLOCK_BYTES, stream: int = STREAM_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept`` and ``_k1, _k2``, which name the row by id and text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_keys())
    signed = stored(_signatures(rows), "signatures")
    # one node per class of equal sets: its row with the least id
    classes = stored(
        signed.where("set_hash is not null")
        .groupBy("set_hash")
        .agg(F.min(F.struct(F.col("doc_id").alias("id"), "_k1", "_k2", "signature")).alias("x"))
        .select(F.monotonically_increasing_id().alias("node"), "set_hash", F.col("x.id").alias("least"), "x._k1", "x._k2", F.col("x.signature").alias("signature")),
        "classes",
    )
    bands = _bands(classes)
    buckets = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("band", "hub")
    shared = stored(bands.join(buckets.hint("merge"), "band").select("band", "node", "hub"), "buckets")
    stars = stored(shared.where("node <> hub").select("hub", "node").distinct(), "stars")
    members = classes.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "node", "signature")
    # one plan at every size: all texts meet the members' keys in a shuffle, in which the copies of a row fall together
    found = rows.select("_k1", "_k2", "text").join(members.hint("merge"), (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).dropDuplicates(["_k1", "_k2"])
    sets = stored(_described(found.select("node", "signature", "text")), "sets")
    n = partitions(spark, sets.agg(F.sum("n_bytes")).first()[0] or 0)
    roots = stored(components(stored(_hub_links(stars, sets, n, stream), "links")), "roots")
    joined = components(stored(_block_links(shared.select("band", "node"), roots, sets, n, block), "links"))
    joined = joined.select(F.col("node").alias("first"), F.col("root").alias("root2"))
    label = classes.join(roots, "node", "left").withColumn("first", F.coalesce("root", "node")).join(joined, "first", "left")
    linked_classes = label.select("set_hash", "least", F.coalesce("root2", "first").alias("root"))
    first = linked_classes.groupBy("root").agg(F.min(F.struct("least")).alias("x")).select("root", F.col("x.least").alias("component_id"))
    named = stored(linked_classes.join(first, "root").select("set_hash", "component_id"), "components")
    own = signed.select("doc_id", "_k1", "_k2", "n_shingles", "set_hash")
    alone = own.where("set_hash is null").withColumn("component_id", F.col("doc_id"))
    grouped = own.where("set_hash is not null").join(named, "set_hash")
    return alone.unionByName(grouped).select("doc_id", "n_shingles", "component_id", "_k1", "_k2").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group; of rows equal in id and text, one."""
    return keep_named(docs, near_groups(docs).where("kept"))
