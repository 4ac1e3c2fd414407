"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of all words by weight, at most ``repeats`` times
its own size, the excess shared again by weight.  A target of q whole passes and
a rest takes every document q times; the rest is fitted by length alone: the
documents of a source are counted by exact word length, each length gives its
share of the rest, what is then missing is filled greedily down to ``EXACT``
words or as far as documents fit, then by a bounded-knapsack dynamic program over
the counts left.  If that misses, the program runs over all counts, or, where its
table would pass ``CELLS`` bits, over exchanges of one document for others, which
comes near but need not find the nearest sum.  Of the documents of one length the seeded hash order decides, in two steps (whole hash buckets,
then the order inside one bucket), so that no task sorts a whole hot length.

Defined cases: null text has size 0; a null source is a source, the last;
of rows equal in id and text any may be the ones that are taken once more; empty input
gives an empty result; other columns pass unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import n_words, stored

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
SEED = 20240501
#: Words of rest at which greedy filling ends, and the dynamic program over what is left begins.
EXACT = 1 << 14
#: Bits of the table over all choices of a source, kept if that step missed; beyond, exchanges are searched.
CELLS = 1 << 31
BUCKETS = 256


def targets(sizes: list[int], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``repeats`` times its size, excess shared again."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        scale = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * scale >= repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * scale
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def fit(counts: dict[int, int], budget: int, exact: int = EXACT, cells: int = CELLS) -> dict[int, int]:
    """How many documents of each length to take so that their words come nearest to ``budget``."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    size = sum(n * c for n, c in counts.items())
    if budget <= 0 or not size:
        return {}
    if budget >= size:
        return counts
    take, carried = {}, 0
    for n in sorted(counts):  # each length its share; what does not make a whole document is carried on
        carried += counts[n] * n * budget
        take[n] = min(counts[n], carried // (n * size))
        carried -= take[n] * n * size
    rest = budget - sum(n * c for n, c in take.items())
    for n in sorted(counts, reverse=True):  # greedily, until the rest is small
        if rest <= exact:
            break
        k = min(counts[n] - take[n], rest // n)
        take[n] += k
        rest -= k * n
    # a rest above `exact` is less than any length left, so this step is never wide
    take = _changed(take, knapsack({n: counts[n] - take[n] for n in counts}, rest))
    if _words(take) != budget:
        take = min(_nearer(counts, take, budget, size, cells), key=lambda t: abs(_words(t) - budget))
    return {n: k for n, k in take.items() if k}


def _words(take: dict[int, int]) -> int:
    return sum(n * k for n, k in take.items())


def _changed(take: dict[int, int], by: dict[int, int], sign: int = 1) -> dict[int, int]:
    return {n: k + sign * by.get(n, 0) for n, k in take.items()}


def _nearer(counts: dict[int, int], take: dict[int, int], budget: int, size: int, cells: int) -> Iterator[dict[int, int]]:
    """``take``, and what may come nearer to ``budget``: the best of all choices where its table has at most
    ``cells`` cells, else the excess taken out, and one more document of some length with others out for it, or the other way round."""
    yield take
    part = min(budget, size - budget)  # choosing what stays out is the same problem
    top = part + min(max(counts), part)
    if top * sum(min(c, top // n).bit_length() for n, c in counts.items()) <= cells:
        best = knapsack(counts, part)
        yield {n: best.get(n, 0) for n in counts} if part == budget else {n: c - best.get(n, 0) for n, c in counts.items()}
        return
    off = _words(take) - budget
    if off > 0:
        new = _changed(take, knapsack(take, off), -1)
        yield new
        if _words(new) == budget:
            return
    for n in sorted(counts):
        for sign in (1, -1):  # one more in and others out; one out and others in
            left = counts[n] - take[n] if sign > 0 else take[n]
            excess = n + sign * off
            if left and excess >= 0:
                others = {m: (take[m] if sign > 0 else counts[m] - take[m]) for m in counts if m != n}
                new = _changed(_changed(take, {n: 1}, sign), knapsack(others, excess), -sign)
                yield new
                if _words(new) == budget:
                    return


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded knapsack: numbers per length whose sum comes nearest to ``budget``.

    A bit set holds the sums that are reachable; each length enters as bundles of
    1, 2, 4, ... documents.  The nearest sum passes the budget by less than one
    document, and by no more than the budget, as the empty sum misses that much."""
    longest = max((n for n, c in counts.items() if c), default=0)
    top = budget + min(longest, budget)
    mask, reach, steps = (1 << (top + 1)) - 1, 1, []
    for n in sorted(counts):
        left, size = min(counts[n], top // n), 1
        while left > 0:
            k = min(size, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, size = left - k, size * 2
        if reach >> budget & 1:
            break
    low = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> budget
    high = budget + (above & -above).bit_length() - 1 if above else low
    best = high if abs(high - budget) < budget - low else low
    out: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            out[n] = out.get(n, 0) + k
            best -= n * k
    return out


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """What the plan needs of each row: ``source``, words, seeded order and its bucket, and the columns ``more``."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.select("source", n_words("text").alias("size"), order.alias("order"), F.pmod(order, F.lit(BUCKETS)).cast("int").alias("bucket"), *more)


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equality of the named columns, null sources being equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) if k == "source" else a[k] == b[k] for k in names])


CELL = ("source", "size", "bucket")


def _limits(sized: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """Per source, size and bucket: how often all its rows are taken, and up to which order one time more."""
    by_bucket = stored(sized.groupBy(*CELL).agg(F.count("*").alias("n")), "lengths")
    # One row per source reaches the driver: its name and its words.
    sources = [tuple(r) for r in by_bucket.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    sources.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    words = [s for _, s in sources]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(sources))], repeats)
    plan = sized.sparkSession.createDataFrame([(name, w, t) for (name, w), t in zip(sources, goal, strict=True)], "source string, source_size long, target double")

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(target // words), repeats) if words else 0
        extra = fit(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), round(target) - passes * words) if words else {}
        return pd.DataFrame({**{k: pdf[k] for k in ("source", "size", "source_size", "target")}, "passes": passes, "wanted": [extra.get(n, 0) for n in pdf["size"].tolist()]})

    lengths = by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n"))
    # A task sees the lengths of one source: as many rows as it has distinct lengths.
    fits = (
        lengths.join(plan, _same(lengths, plan, "source"))
        .drop(plan["source"])
        .groupBy("source")
        .applyInPandas(fitted, "source string, size long, source_size long, target double, passes int, wanted long")
    )
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")  # over BUCKETS rows
    counted = by_bucket.withColumn("before", before)
    got = F.least(F.col("n"), F.greatest(F.lit(0), F.col("wanted") - F.col("before")))
    shares = stored(counted.join(fits, _same(counted, fits, "source", "size")).select(*[counted[k] for k in CELL], "source_size", "target", "passes", got.alias("extra"), "n"), "shares")
    cut = shares.where("extra > 0 and extra < n").select(*CELL, "extra")
    ranks = sized.join(cut, _same(sized, cut, *CELL), "left_semi").groupBy(*CELL, "order").agg(F.count("*").alias("same"))
    taken = ranks.withColumn("before", F.sum("same").over(Window.partitionBy(*CELL).orderBy("order")) - F.col("same"))
    # Of a cut bucket: rows of an order under `edge` are taken, and `some` of those at it.
    edges = (
        taken.join(cut, _same(taken, cut, *CELL))
        .where("before <= extra")
        .groupBy(*[taken[k] for k in CELL])
        .agg(F.max(F.struct(F.col("order"), (F.col("extra") - F.col("before")).alias("some"))).alias("at"))
    )
    whole = shares.join(edges, _same(shares, edges, *CELL), "left")
    names = [shares[k].alias(f"_k_{k}") for k in CELL]
    return stored(whole.select(*names, "source_size", "target", "passes", (F.col("extra") >= F.col("n")).alias("every"), F.col("at.order").alias("edge"), F.col("at.some").alias("some")), "limits")


def _times(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``times``."""
    joined = sized.join(limits, [sized["source"].eqNullSafe(limits["_k_source"]), sized["size"] == limits["_k_size"], sized["bucket"] == limits["_k_bucket"]])
    nr = F.row_number().over(Window.partitionBy(*CELL, "order").orderBy("order"))  # over 1 for repeated rows only
    more = F.when(F.col("every") | (F.col("order") < F.col("edge")) | ((F.col("order") == F.col("edge")) & (F.col("nr") <= F.col("some"))), 1).otherwise(0)
    return joined.withColumn("nr", nr).withColumn("times", (F.col("passes") + more).cast("long"))


#: Columns that ``mix_plan`` adds.
PLANNED = ("mix_size", "mix_source_size", "mix_target", "mix_times")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``mix_size, mix_source_size, mix_target, mix_times``: it is to be taken ``mix_times`` times.

    Input columns of these four names give way.  With ``columns``, only those are
    returned beside them, and kept with the sizes: the texts are then read once, and
    all later steps work on what is named and four numbers a row."""
    names = [c for c in (docs.columns if columns is None else columns) if c not in PLANNED]
    own = [F.col(f"`{c}`").alias(f"_c_{c}") for c in names]
    sized = stored(_sized(docs, seed, *(own if columns is not None else ())), "sizes")
    limits = _limits(sized, weights, repeats)
    plan = _times(sized if columns is not None else _sized(docs, seed, *own), limits)
    values = (F.col(x).alias(y) for x, y in zip(("size", "source_size", "target", "times"), PLANNED, strict=True))
    return plan.select(*[F.col(f"`_c_{c}`").alias(c) for c in names], *values)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it."""
    limits = _limits(stored(_sized(docs, seed), "sizes"), weights, repeats)
    taken = _times(_sized(docs, seed, F.struct("*").alias("row")), limits).where("times > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
