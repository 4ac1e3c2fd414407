"""Similar titles: a join by first word, author and length with proven bounds for the Ratcliff/Obershelp ratio.

The ratio of titles of ``m`` and ``n`` letters is ``2 M / (m + n)``, where the ``M`` matching letters stand in the
same order in both.  So a ratio of ``t`` leaves at most ``m - t (m + n) / 2`` letters of the one unmatched,
and ``n - t (m + n) / 2`` of the other.  An unmatched letter spoils at most ``q`` of its title's runs of ``q``
letters, and an unmatched letter of the other title at most ``q - 1`` of them.  As the lengths differ by the factor
``(2 - t) / t`` at most, a title of ``m`` letters loses at most ``slope(q, t) * m`` of its runs to any partner.
A run that is not spoiled stands in the other title too, moved by no more letters than the one or the other leaves unmatched.
Titles meet by first word, author and a step of lengths of that factor, in cells of a bounded number of letters; inside a task,
runs near their own place and letters rule out nearly all pairs that are not similar.

Equal titles under one author are one group throughout, named by its least and greatest id.  A pair that met is never a
row of a shuffle: a cell gives its similar pairs, or only links that connect what they connect."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.sources.store import materialize

#: What title words hold.
ALPHABET = np.frombuffer(b" abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
#: Titles, and letters of titles, that a cell compares with as many others as there are.
BLOCK, LETTERS = 512, 100_000
#: Papers of a block whose pairs with another block are made at once.
IDS = 1024
#: Titles of which a task remembers what they are linked with.
KNOWN = 100_000
#: Rows that a task hands over at once.
ROWS = 4096


# ------------------------------------------------------------------ bounds


def slope(q: int, t: float) -> float:
    """Runs of ``q`` letters that a title can lose to a partner of ratio ``t``, for each of its letters."""

    def lost(r: float) -> float:  # r: the partner's length over its own; linear in r, so an end has the most
        both = t * (1 + r) / 2
        return q * (1 - both) + (q - 1) * (r - both)

    return max(lost(t / (2 - t)), lost((2 - t) / t))


def run_length(t: float) -> tuple[int, int]:
    """The longest runs, four letters at most, of which a title keeps a fair part, and the least length that keeps one."""
    q = next((q for q in (4, 3, 2) if slope(q, t) <= 0.75), 1)
    return q, math.floor((q - 1) / (1 - slope(q, t)) + 1e-9) + 1


def letters_needed(m: int, n: int, t: float) -> int:
    """The least number of matching letters whose ratio reaches ``t`` as floating numbers have it."""
    k = math.ceil(t * (m + n) / 2 - 1e-9)
    while 2.0 * k / (m + n) < t:
        k += 1
    while k and 2.0 * (k - 1) / (m + n) >= t:
        k -= 1
    return k


# ------------------------------------------------------------------ groups of equal titles


def title_groups(papers: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Members ``id, title, authors``, and groups ``title, t, n, block, author, lo, hi`` of a title and an author; ``title`` is a number."""
    keys = F.filter(F.transform("authors", lambda a: X.author_key(a)), lambda a: a.isNotNull() & (a != ""))
    rows = papers.select(F.col(id_).alias("id"), X.title_words("title").alias("t"), F.array_sort(F.array_distinct(keys)).alias("authors"))
    rows = materialize(rows.where("t <> '' and id is not null and size(authors) > 0"))
    names = materialize(rows.select("t").distinct().select("t", F.monotonically_increasing_id().alias("title"), X.block_key("t").alias("block")))
    members = materialize(rows.join(names.hint("merge"), "t").select("id", "title", "authors"))
    groups = members.select("id", "title", F.explode("authors").alias("author")).groupBy("title", "author").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return members, materialize(groups.join(names.hint("merge"), "title").select("title", "t", F.length("t").alias("n"), "block", "author", "lo", "hi"))


def tasks(spark: SparkSession) -> int:
    """A number of partitions that adaptive execution leaves as it is: few bytes are much work here."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


# ------------------------------------------------------------------ inside a task


class _Title:
    """A title with the places of its letters, made when they are asked for; ``lo`` and ``hi``: the ids of its group."""

    def __init__(self, t: str, lo=None, hi=None, name: int = 0, author: str = ""):
        self.t, self.n, self.lo, self.hi, self.name, self.author = t, len(t), lo, hi, name, author

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.t.encode(), np.uint8)  # title words are ASCII

    @cached_property
    def letters(self) -> np.ndarray:
        """How often each letter of the alphabet stands in it."""
        return np.bincount(self.bytes, minlength=128)[ALPHABET].astype(np.int32)

    @cached_property
    def places(self) -> dict[str, int]:
        """A bit for each place of a letter."""
        out: dict[str, int] = {}
        for k, x in enumerate(self.t):
            out[x] = out.get(x, 0) | 1 << k
        return out

    @cached_property
    def at(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for k, x in enumerate(self.t):
            out.setdefault(x, []).append(k)
        return out

    @cached_property
    def seeds(self) -> dict[str, list[int]]:
        """The letters that a match can start from: of 200 letters and more, difflib leaves out those of over a hundredth."""
        return {x: p for x, p in self.at.items() if self.n < 200 or len(p) <= self.n // 100 + 1}

    def runs(self, q: int) -> np.ndarray:
        """The runs of ``q`` letters as numbers, before 31 bits for a place."""
        b, n = self.bytes.astype(np.int64), max(0, self.n - q + 1)
        return sum(b[k : k + n] << 8 * k for k in range(q)) << 31

    def common(self, y: str, least: float) -> bool:
        """Whether the longest common subsequence has ``least`` letters; the matching letters of a ratio are a common one.

        After ``k`` letters of ``y``, no more than those that may stay unmatched are, and the others lie
        among as many first letters of this title and those that it may leave unmatched."""
        same = next((k for k, (a, b) in enumerate(zip(self.t, y, strict=False)) if a != b), min(self.n, len(y)))
        if same >= least:
            return True
        full, spare, loose = (1 << self.n) - 1, self.n - least, len(y) - least
        v, every = full - ((1 << same) - 1), max(16, len(y) // 8)  # a common head is matched as it stands
        for k in range(same + 1, len(y) + 1):
            u = v & self.places.get(y[k - 1], 0)
            v = ((v + u) | (v - u)) & full
            if k % every == 0:
                head = min(self.n, math.floor(k + spare + 1e-9))
                if head - (v & ((1 << head) - 1)).bit_count() < k - loose - 1e-9:
                    return False
                if self.n - v.bit_count() >= least:
                    return True
        return self.n - v.bit_count() >= least - 1e-9

    def longest(self, y: _Title, rows: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """difflib's longest match of these parts; ``rows`` are the places of letters that are seeds of ``y``."""
        a, b, i0, j0, size, before = self.t, y.t, alo, blo, 0, -1
        ends: dict[int, int] = {}
        for i in rows[bisect_left(rows, alo) : bisect_left(rows, ahi)]:
            if i != before + 1:
                ends = {}
            before, new, places = i, {}, y.seeds[a[i]]
            for j in places[bisect_left(places, blo) : bisect_left(places, bhi)]:
                k = new[j] = ends.get(j - 1, 0) + 1
                if k > size:
                    i0, j0, size = i - k + 1, j - k + 1, k
            ends = new
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        return i0, j0, size

    def reaches(self, y: _Title, t: float) -> bool:
        """Whether ``difflib.SequenceMatcher(None, self.t, y.t).ratio() >= t``; parts are matched the largest first until that is settled."""
        least = letters_needed(self.n, y.n, t)
        rows = sorted(k for x in y.seeds for k in self.at.get(x, ()))
        open_, found, left = [(min(self.n, y.n), 0, self.n, 0, y.n)], 0, min(self.n, y.n)
        while open_ and found < least <= found + left:
            most, alo, ahi, blo, bhi = open_.pop()
            left -= most
            i, j, k = self.longest(y, rows, alo, ahi, blo, bhi)
            found += k
            for part in ((min(i - alo, j - blo), alo, i, blo, j), (min(ahi - i - k, bhi - j - k), i + k, ahi, j + k, bhi)):
                if not k or not part[0]:
                    continue
                if bisect_left(rows, part[1]) == bisect_left(rows, part[2]):  # without a seed, only a common head matches
                    found += next((z for z in range(part[0]) if self.t[part[1] + z] != y.t[part[3] + z]), part[0])
                else:
                    open_.append(part)
                    left += part[0]
            open_.sort()
        return found >= least


class _Cell:
    """The titles of a cell, in the order of length and name, and where their runs stand."""

    def __init__(self, titles: list[_Title], t: float):
        self.titles, self.t, (self.q, self.short) = titles, t, run_length(t)
        self.order, self.n = [(x.n, x.name) for x in titles], np.array([x.n for x in titles], np.int64)
        self.letters = np.array([x.letters for x in titles])
        runs = [x.runs(self.q) for x in titles]
        keys = np.concatenate([r + np.arange(len(r)) for r in runs]) if runs else np.zeros(0, np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[by], np.repeat(np.arange(len(runs)), [len(r) for r in runs])[by]

    def shared(self, y: _Title, some: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """How many runs of ``y`` stand in each of some titles, moved by no more letters than these and ``y`` leave unmatched, or more."""
        runs = y.runs(self.q)
        at = np.arange(len(runs))
        lo = np.searchsorted(self.keys, runs + np.maximum(at - int(behind.max()), 0))
        k = np.searchsorted(self.keys, runs + at + int(ahead.max()), "right") - lo
        if k.sum() > 16 * y.n * len(some):  # runs that repeat so often cost more than the ratios
            return np.full(len(some), y.n)
        found = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())
        place = np.full(len(self.titles), -1)
        place[some] = np.arange(len(some))
        x, p = place[self.owner[found]], np.repeat(at, k)
        mine = x >= 0
        x, p, moved = x[mine], p[mine], (self.keys[found[mine]] & (1 << 31) - 1) - p[mine]
        near = (moved <= ahead[x]) & (-moved <= behind[x])
        hit = np.zeros((len(some), len(runs)), bool)
        hit[x[near], p[near]] = True
        return np.count_nonzero(hit, axis=1)

    def near(self, y: _Title) -> list[_Title]:
        """Titles before ``y`` in the order that can have the ratio, the likeliest first."""
        # bounds that are a hair low never rule out a pair of the ratio
        a, b = int(np.searchsorted(self.n, y.n * self.t / (2 - self.t) - 1e-6)), bisect_left(self.order, (y.n, y.name))
        if a >= b:
            return []
        some = a + np.flatnonzero(np.minimum(self.letters[a:b], y.letters).sum(axis=1) >= self.t * (self.n[a:b] + y.n) / 2 - 1e-6)
        if not len(some):
            return []
        m, q = self.n[some], self.q
        least = self.t * (m + y.n) / 2 - 1e-6
        ahead, behind = m - least, y.n - least  # letters that the one and the other leave unmatched
        shared = self.shared(y, some, ahead, behind)
        kept = np.flatnonzero((m < self.short) | (shared >= y.n - q + 1 - q * behind - (q - 1) * ahead))
        found = [self.titles[k] for k in some[kept[np.argsort(-shared[kept], kind="stable")]]]
        # short runs rule out little
        return found if q == 4 else [x for x in found if x.common(y.t, self.t * (x.n + y.n) / 2)]


def _met(batches: Iterator[pd.DataFrame], t: float) -> Iterator[tuple[_Title, list[_Title]]]:
    """Each title of each cell with those that can have the ratio; rows come cell by cell, a cell's own titles first."""
    rows = (r for b in batches for r in zip(*(b[c].tolist() for c in ("cell", "salt", "own", "t", "lo", "hi", "title", "author")), strict=True))
    for _, one in groupby(rows, key=lambda r: r[:2]):
        cell = _Cell([], t)
        for own, part in groupby(one, key=lambda r: r[2]):
            titles = (_Title(*r[3:]) for r in part)
            if own:
                cell = _Cell(titles := list(titles), t)
            for y in titles:
                yield y, cell.near(y)


def _handed(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) == ROWS:
            yield pd.DataFrame(out, columns=names)
            out = []
    if out:
        yield pd.DataFrame(out, columns=names)


def _pairs(batches: Iterator[pd.DataFrame], t: float) -> Iterator[tuple]:
    """All that can have the ratio."""
    return ((x.name, y.name, y.author) for y, near in _met(batches, t) for x in near)


def _similar(batches: Iterator[pd.DataFrame], t: float) -> Iterator[tuple]:
    """All that have the ratio in an order that some papers of the two groups have."""
    for y, near in _met(batches, t):
        for x in near:
            forward, backward = x.lo < y.hi and x.reaches(y, t), y.lo < x.hi and y.reaches(x, t)
            if forward or backward:
                yield x.name, y.name, y.author, forward, backward


def _links(batches: Iterator[pd.DataFrame], t: float) -> Iterator[tuple]:
    """Links between groups that connect what the similar ones connect: titles that are connected already are not compared."""
    known: dict = {}

    def root(a):
        while (b := known.setdefault(a, a)) != a:
            known[a] = a = known.setdefault(b, b)
        return a

    for y, near in _met(batches, t):
        if len(known) > KNOWN:
            known.clear()  # its links are handed over; only comparisons are lost
        for x in near:
            a, b = root(x.lo), root(y.lo)
            if a != b and ((x.lo < y.hi and x.reaches(y, t)) or (y.lo < x.hi and y.reaches(x, t))):
                known[a] = b
                yield min(x.lo, y.lo), max(x.lo, y.lo)


# ------------------------------------------------------------------ the join


def _compared(groups: DataFrame, threshold: float, block: int, look: Callable[[Iterator[pd.DataFrame], float], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """What ``look`` finds in each cell.  Lengths that allow the ratio differ by the factor ``(2 - t) / t`` at most, so with steps
    of that factor a title meets those of its own step and of the next; a cell has a part of a step's titles, and all of both steps pass by."""
    if not 0 < threshold <= 1:
        raise ValueError("a ratio's threshold lies over 0 and at most at 1")
    factor = (2 - threshold) / threshold
    step = F.floor(F.log(F.col("n").cast("double")) / (math.log(factor) * (1 + 1e-9))).cast("int") if factor > 1 else F.col("n")
    key = ["block", "author", "step"]
    met = groups.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("step", F.when(F.col("own"), step).otherwise(step - 1))
    own = F.count_if("own")
    cut = F.ceil(F.greatest(own / block, F.sum(F.when(F.col("own"), F.col("n"))) / LETTERS)).cast("int")
    sized = met.groupBy(*key).agg(own.alias("owns"), F.count("*").alias("all"), cut.alias("cuts")).where("owns > 0 and all > 1")
    sized = materialize(sized.select(*key, "cuts", F.monotonically_increasing_id().alias("cell")))
    salts = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = met.join(sized.hint("merge"), key).select("cell", "own", "cuts", salts.alias("salt"), "t", "n", "lo", "hi", "title", "author")
    dealt = dealt.withColumn("own", F.col("own") & (F.pmod(F.xxhash64("title"), F.col("cuts")) == F.col("salt"))).drop("cuts")
    cells = dealt.repartition(tasks(groups.sparkSession), "cell", "salt").sortWithinPartitions("cell", "salt", F.desc("own"), "n", "title")
    return cells.mapInPandas(lambda batches: _handed(look(batches, threshold), schema.names), schema)


def _found(groups: DataFrame, names: str, *more: T.StructField) -> T.StructType:
    kind = {"a": "lo", "b": "lo", "x": "title", "y": "title", "author": "author"}
    return T.StructType([*(T.StructField(c, groups.schema[kind[c]].dataType) for c in names.split()), *more])


def candidates(groups: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``x, y, author``: titles that share first word and author, and whose lengths, runs and letters allow the ratio."""
    return _compared(groups, threshold, block, _pairs, _found(groups, "x y author"))


def similar_groups(groups: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``x, y, author, forward, backward``: whether the ratio of the titles reaches the threshold in this and in the other order.

    It is not symmetric, and false for an order that no two papers of the groups have."""
    both = [T.StructField(c, T.BooleanType()) for c in ("forward", "backward")]
    return _compared(groups, threshold, block, _similar, _found(groups, "x y author", *both))


def fuzzy_edges(papers: DataFrame, threshold: float, id_: str = "arxiv_id", block: int = BLOCK) -> DataFrame:
    """``a, b``: edges that connect what similar titles connect, about one for each member and each group of a cell, not one for each pair.

    Of two papers the ratio is that of the title of the lesser id to the other's."""
    members, groups = title_groups(papers, id_)
    least = groups.select("title", "author", "lo").hint("merge")
    equal = members.select("id", "title", F.explode("authors").alias("author")).join(least, ["title", "author"]).where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    if threshold == 1:  # only equal titles have it
        return equal.distinct()
    return _compared(groups, threshold, block, _links, _found(groups, "a b")).unionByName(equal).distinct()


def fuzzy_pairs(papers: DataFrame, threshold: float, id_: str = "arxiv_id", block: int = BLOCK) -> DataFrame:
    """``a, b``: all pairs of papers, for a report; it grows with the square of the number of papers of one title and author.

    Papers of one title and the same authors lie in blocks of ids.  Two blocks meet once, under the least author that they
    share, and their pairs are made where they are handed over: none is moved or compared with others.  Only pairs of
    an id that has several titles or lists of authors can come twice."""
    members, groups = title_groups(papers, id_)
    n, same = tasks(papers.sparkSession), ["title", "authors", "many"]
    rows = members.distinct().withColumn("many", F.count("*").over(Window.partitionBy("id")) > 1)
    rows = materialize(rows)
    sized = rows.groupBy(*same).agg(F.ceil(F.count("*") / IDS).cast("int").alias("cuts"))
    held = rows.join(sized.hint("merge"), same).groupBy(*same, F.pmod(F.xxhash64("id"), F.col("cuts")).alias("salt")).agg(F.collect_list("id").alias("ids"))
    held = materialize(held.select(*same, "ids", F.monotonically_increasing_id().alias("k")))
    each = held.withColumn("author", F.explode("authors"))
    side = lambda df, z: df.select("author", *[F.col(c).alias(f"{c}{z}") for c in df.columns if c != "author"])
    # blocks of one title: a key of many is dealt
    cuts = each.groupBy("title", "author").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
    dealt = each.join(cuts.hint("merge"), ["title", "author"])
    ours = side(dealt.withColumn("cut", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int")), "x")
    theirs = side(dealt.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))), "y")
    equal = ours.join(theirs.hint("merge"), (ours.author == theirs.author) & (F.col("titlex") == F.col("titley")) & (F.col("cutx") == F.col("cuty")) & (F.col("kx") <= F.col("ky"))).drop(theirs.author)
    equal = equal.withColumn("forward", F.lit(True)).withColumn("backward", F.col("kx") != F.col("ky"))
    met = [equal]
    if threshold < 1:
        links = materialize(similar_groups(groups, threshold, block)).withColumnsRenamed({"x": "titlex", "y": "titley"})
        met.append(links.join(side(each, "x").hint("merge"), ["titlex", "author"]).join(side(each, "y").hint("merge"), ["titley", "author"]))
    once = F.col("author") == F.array_min(F.array_intersect("authorsx", "authorsy"))
    names = ["kx", "ky", "idsx", "idsy", "manyx", "manyy", "forward", "backward"]
    blocks = reduce(DataFrame.unionByName, [df.where(once).select(*names) for df in met])
    many = F.col("manyx") | F.col("manyy")

    def pairs(some: DataFrame) -> DataFrame:
        made = some.repartition(n, "kx", "ky").withColumn("p", F.explode("idsx")).withColumn("q", F.explode("idsy"))
        # of one block, forward alone makes each pair once
        near = made.where((F.col("p") != F.col("q")) & F.when(F.col("p") < F.col("q"), F.col("forward")).otherwise(F.col("backward")))
        return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    return pairs(blocks.where(~many)).unionByName(pairs(blocks.where(many)).distinct())
