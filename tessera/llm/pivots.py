"""Hard negatives by a pivot table: distances to pivots bracket inner products.

With ``M`` the largest norm of a row, a row ``x`` becomes the point ``(x, sqrt(M^2 - |x|^2))`` and
an anchor ``q`` the point ``(q, 0)``.  Their distance ``d`` gives the score exactly: ``q.x = (|q|^2 +
M^2 - d^2) / 2``.  A table stores each row's distances to ``PIVOTS`` points, chosen far apart in
a sample of ``SAMPLE`` rows; by the triangle inequality the distances of anchor and row to a
pivot bracket ``d``, and so the score.

Anchors, a stated share of the rows, are dealt into chunks of ``CHUNK``, rows into slices.  In a
task the anchors of a chunk are held with their pivot distances, and the rows of a slice
stream past, by label and nearest pivot, in groups: the range of a group's pivot distances
rules out anchors for the whole group, then a row's own distances rule out pairs, and what
is left is scored exactly.  An anchor keeps its best rows so far, whose last score rules out
more.  The best of the slices meet in a window of a few rows for each slice.  The first
search finds an anchor's positives among rows of its label; their scores are the windows of
the second search, among rows of other labels.  The table holds every row and brackets are
safe, so nothing is missed: recall is 1.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take
no part, nor do rows whose squared integer norm is over 2^56, as products with them could
leave the range of longs; a shorter vector counts as filled up with zeros; rows of one id
are rows of their own, and an anchor's other rows are all but itself; a null id is no anchor
and smaller than all in ties; an anchor without other rows of its label, or whose window
holds no row, has no row in the result; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import column, longs, small_batches, stored

#: Pivots, and the rows that they are chosen from.
PIVOTS, SAMPLE = 8, 2048
#: Anchors that a task holds; most rows of a slice, and how few it has if the session's partitions ask for more slices; rows of a group.
CHUNK, SLICE, FEW, GROUP = 2048, 1 << 18, 4096, 256
#: Candidates that a task holds before it keeps the best.
POOL = 1 << 18
SCALE = 256
MOST = 2**56
LEAST, GREATEST = -(2**62), 2**62
#: Squared norms under which sums of products are exact in doubles.
EXACT = 2**52


# ------------------------------------------------------------------ rows and pivots


def numbered(rows: DataFrame, vector: str, key: str, label: str | Column) -> DataFrame:
    """``row, id, label, v, norm``: the rows that take part, components as ``floor(SCALE * x)``."""
    kept = rows.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("x"))
    kept = kept.where("label is not null and x is not null")
    x = F.col("x")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    size = F.aggregate(F.transform(x, lambda c: F.pow(F.floor(c.cast("double") * SCALE), 2)), F.lit(0.0), lambda a, b: a + b)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    return kept.where(~odd).where(size <= MOST).select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("v"), size.cast("long").alias("norm"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of ``dim`` columns, filled up with zeros."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    """Points whose distance to ``(q, 0)`` falls as their product with ``q`` grows."""
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))[:, None]], axis=1)


def far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the points: the first, then always one that is farthest from those chosen."""
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < min(k, len(points)):
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def pivot_table(rows: DataFrame, dim: int, most: int, pivots: np.ndarray) -> DataFrame:
    """``row, id, label, v, d, da, cell, near``: each row's distances as a row, those as an anchor, its nearest pivot, how near."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(column(batch, "v"), dim)
            d = distances(augmented(v, most), pivots)
            da = distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), pivots)
            packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (v.astype("<i4"), d, da)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "row"), column(batch, "id"), column(batch, "label"), *packed, pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))],
                ["row", "id", "label", "v", "d", "da", "cell", "near"],
            )

    return rows.mapInArrow(measure, "row long, id long, label long, v binary, d binary, da binary, cell int, near double")


# ------------------------------------------------------------------ the search in a task


class Pool:
    """The best candidates of each want (an anchor's window) so far: highest scores, then smallest ids."""

    def __init__(self, wants: int, k: int):
        self.k, self.floor = k, np.full(wants, LEAST, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.settled = 0

    def add(self, want: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        self.parts.append((want, score, id_))
        self.size += len(want)
        if self.size > 2 * self.settled + POOL:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        want, score, id_ = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.parts, strict=True) if self.parts else ((), (), ())))
        order = np.lexsort((id_, -score, want))
        want, score, id_ = want[order], score[order], id_[order]
        first = np.concatenate([[0], np.nonzero(np.diff(want))[0] + 1])
        place = np.arange(len(want)) - np.repeat(first, np.diff([*first, len(want)])) if len(want) else np.zeros(0, np.int64)
        last = place == self.k - 1
        self.floor[want[last]] = score[last]
        kept = place < self.k
        out = want[kept], score[kept], id_[kept]
        self.parts, self.size, self.settled = [out], int(kept.sum()), int(kept.sum())
        return out


class Search:
    """The anchors of a chunk, and what they have found in the rows that came past."""

    def __init__(self, anchors: list[pa.RecordBatch], dim: int, most: int, same: bool, k: int):
        self.most, self.same, self.k = most, same, k
        whole = lambda name: np.concatenate([longs(b, name) for b in anchors])
        bytes_ = lambda name, kind: np.concatenate([_numbers(column(b, name), kind) for b in anchors])
        self.row, self.label = whole("row"), whole("label")
        self.v = bytes_("v", "<i4").reshape(-1, dim).astype(np.float64 if most < EXACT else np.int64)
        self.d = bytes_("da", "<f8").reshape(len(self.row), -1)
        self.norm = (self.v * self.v).sum(axis=1).astype(np.float64)
        bounds = [np.concatenate([np.stack(column(b, name).to_numpy(zero_copy_only=False)) for b in anchors]) for name in ("lo", "hi")]
        self.lo, self.hi = bounds  # a column for each want of an anchor
        self.pool = Pool(self.lo.size, k)
        self.by_label = {x: np.nonzero(self.label == x)[0] for x in np.unique(self.label).tolist()}
        self.scored = 0

    def bracket(self, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores at distances from ``near`` to ``far``, with room for rounding."""
        total = norm + self.most
        slack = total * 1e-9 + 1
        return (total - far**2) / 2 - slack, (total - near**2) / 2 + slack

    def pass_by(self, label: int, row: np.ndarray, id_: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        """A group of rows of one label."""
        own = self.by_label.get(label, np.zeros(0, np.int64))
        i = own if self.same else np.setdiff1d(np.arange(len(self.row)), own)
        if not len(i):
            return
        w = self.lo.shape[1]
        floor = np.maximum(self.lo, self.pool.floor.reshape(-1, w))
        # the whole group: its ranges of pivot distances
        low, high, da = d.min(axis=0), d.max(axis=0), self.d[i]
        least, most = self.bracket(np.maximum(np.maximum(da - high, low - da), 0).max(axis=1), (da + high).min(axis=1), self.norm[i])
        i = i[((most[:, None] >= floor[i]) & (least[:, None] <= self.hi[i])).any(axis=1)]
        if not len(i):
            return
        # each row: its own distances
        da, norm = self.d[i], self.norm[i][:, None]
        near, far = np.zeros((len(i), len(row))), np.full((len(i), len(row)), np.inf)
        for k in range(d.shape[1]):
            x, y = da[:, k, None], d[None, :, k]
            np.maximum(near, np.abs(x - y), out=near)
            np.minimum(far, x + y, out=far)
        least, most = self.bracket(near, far, norm)
        ask, give = floor[i].min(axis=1)[:, None], self.hi[i].max(axis=1)[:, None]
        left = (most >= ask) & (least <= give)
        if self.same:
            left &= self.row[i][:, None] != row[None, :]
        rows = np.nonzero(left.any(axis=0))[0]
        left = left[:, rows]
        score = self.v[i] @ v[rows].astype(self.v.dtype).T  # the exact check
        self.scored += score.size
        for j in range(w):
            a, b = np.nonzero(left & (score >= floor[i, j, None]) & (score <= self.hi[i, j, None]))
            if len(a):
                self.pool.add(i[a] * w + j, score[a, b].astype(np.int64), id_[rows[b]])

    def found(self) -> pa.RecordBatch:
        want, score, id_ = self.pool.settle()
        w = self.lo.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(self.row[want // w]), pa.array(want % w), pa.array(id_), pa.array(score)], ["row", "want", "found_id", "score"])


def _numbers(c: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), kind)


def _best(asked: DataFrame, table: DataFrame, dim: int, most: int, n: tuple[int, int], same: bool, k: int) -> DataFrame:
    """``row, want, place, found_id, score``: for each want of the anchors ``asked`` (with arrays ``lo, hi``) its first ``k`` rows."""
    chunks, slices = n
    deal = lambda salt, count: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    none = F.lit(None).cast("array<long>")
    anchors = asked.select(deal(1, chunks).alias("chunk"), each(slices).alias("slice"), F.lit(0).alias("place"), "row", "id", "label", "v", F.lit(None).cast("binary").alias("d"), "da", "lo", "hi", "cell", "near")
    rows = table.select(each(chunks).alias("chunk"), deal(2, slices).alias("slice"), F.lit(1).alias("place"), "row", "id", "label", "v", "d", F.lit(None).cast("binary").alias("da"), none.alias("lo"), none.alias("hi"), "cell", "near")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, state = None, [], None
        for batch in batches:
            keys = np.stack([longs(batch, x) for x in ("chunk", "slice", "place", "label")])
            edges = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1, [batch.num_rows]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                chunk, slice_, place, label = keys[:, a].tolist()
                if (chunk, slice_) != unit:
                    if state:
                        yield state.found()
                    unit, waiting, state = (chunk, slice_), [], None
                part = batch.slice(a, b - a)
                if not place:
                    waiting.append(part)
                    continue
                if waiting:
                    state, waiting = Search(waiting, dim, most, same, k), []
                if not state:
                    continue  # a chunk without anchors
                v, d = _numbers(column(part, "v"), "<i4").reshape(-1, dim), _numbers(column(part, "d"), "<f8").reshape(b - a, -1)
                row, id_ = longs(part, "row"), longs(part, "id", np.iinfo(np.int64).min)
                for g in range(0, b - a, GROUP):
                    state.pass_by(label, row[g : g + GROUP], id_[g : g + GROUP], v[g : g + GROUP], d[g : g + GROUP])
        if state:
            yield state.found()

    dealt = anchors.unionByName(rows).repartitionById(chunks * slices, F.col("chunk") * slices + F.col("slice"))
    dealt = dealt.sortWithinPartitions("chunk", "slice", "place", "label", "cell", "near")
    best = dealt.mapInArrow(search, "row long, want long, found_id long, score long")
    place = F.row_number().over(Window.partitionBy("row", "want").orderBy(F.desc("score"), F.asc("found_id")))
    return best.withColumn("place", place).where(F.col("place") <= k)


# ------------------------------------------------------------------ the operator


def hard_negatives(
    rows: DataFrame,
    anchor: str = "id % 100 = 0",
    vector: str = "embedding",
    key: str = "vec_id",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int, int] = (30, 90, 100),
    chunk: int = CHUNK,
    slice_rows: int = SLICE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that satisfy ``anchor``, said of ``id``; an anchor's positives are its ``positives`` best other
    rows of its label; the negatives of each are the ``negatives`` best rows of other labels whose score lies between the
    first and the second share, in parts of the third, of the positive's score."""
    spark = rows.sparkSession
    small_batches(spark)
    taken = stored(numbered(rows, vector, key, label), "rows")
    n, n_anchors, dim, most = taken.agg(F.count("*"), F.count_if(F.expr(anchor)), F.max(F.size("v")), F.max("norm")).first()
    dim, most = max(dim or 0, 1), most or 0
    sample = taken.orderBy(F.xxhash64("v"), "row").limit(SAMPLE).select("v").toArrow()  # of bounded size
    pivots = far_apart(augmented(matrix(column(sample, "v"), dim), most), PIVOTS) if n else np.zeros((1, dim + 1))
    table = stored(pivot_table(taken, dim, most, pivots), "pivots")
    chunks = max(1, -(-(n_anchors or 0) // chunk))
    # each slice gives its own best, so slices are not made smaller than what they give is worth
    slices = max(-(-n // slice_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")) // chunks, -(-n // FEW)), 1)
    asked = table.where(anchor)
    wide = asked.withColumns({"lo": F.array(F.lit(LEAST)), "hi": F.array(F.lit(GREATEST))})
    found = stored(_best(wide, table, dim, most, (chunks, slices), True, positives), "positives")
    a, b, of = window
    # where a bound is no whole number of hundredths, the next whole score inside
    bound = lambda share, up: F.expr(f"{'-' if up else ''}((({'-' if up else ''}{share} * score) - pmod({'-' if up else ''}{share} * score, {of})) div {of})")
    limits = found.select("row", "place", "found_id", "score", bound(a, True).alias("lo"), bound(b, False).alias("hi"))
    # an anchor's wants in the order of its positives, filled up with windows that hold nothing
    fill = lambda c, x: F.concat(F.transform("wants", lambda s: s[c]), F.array_repeat(F.lit(x), F.lit(positives) - F.size("wants")))
    wants = limits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("wants"))  # as many as positives
    wants = wants.select("row", fill("lo", GREATEST).alias("lo"), fill("hi", LEAST).alias("hi"))
    best = _best(asked.join(wants, "row"), table, dim, most, (chunks, slices), False, negatives)
    named = limits.select("row", (F.col("place") - 1).cast("long").alias("want"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = best.withColumnRenamed("score", "negative_score").join(named, ["row", "want"]).join(table.where(anchor).select("row", F.col("id").alias("anchor_id")), "row")
    back = lambda c: F.when(F.col(c) > np.iinfo(np.int64).min, F.col(c)).alias(c)
    return best.select("anchor_id", back("positive_id"), F.col("place").cast("int").alias("rank"), back("found_id").alias("negative_id"), "positive_score", "negative_score")
