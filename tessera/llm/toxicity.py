"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Lexicons come from the labelled training rows: a lower-cased word that stands in
many more toxic documents than others, by smoothed log-odds of its document
counts, enters a tier by its strength.  The features of a text are densities of
the tiers, how near second-person words stand to lexicon words, capitals,
punctuation, repeated characters and obfuscation (digits or symbols inside a
word, and lexicon words that appear only once these are undone).  Labels,
language, source and id are no inputs.

The classifier is fitted on a bounded sample of the labelled training rows, and one
plan serves every size: labels are drawn by a hash of their id, about ``LABELLED``
of them (all, where there are fewer), and go to the texts, whose labelled rows are
written once.  All of these make the lexicon, without a bound on its words; the
trees are fitted on about ``SAMPLE`` of them, drawn by a hash of id and text, whose
features alone reach the driver.  Scoring reads every whole text in Arrow batches.

Defined cases: a null text counts as empty and gets the score of the empty text;
several labels of one id count once each, conflicting ones too; without labelled
rows, or with labels of one kind, every score is that share (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm._common import column, coded_words, slices, small_batches, split_words, starts_of, stored

#: Labelled rows that the classifier is fitted on, about, and those of them that its trees see.
LABELLED, SAMPLE = 500_000, 20_000
FOLDS, HELD_OUT = 5, 0
#: Smoothed log-odds from which a word enters tier 0, 1, 2.
TIERS = (1.5, 2.5, 3.5)
#: Toxic documents that hold a lexicon word, at least, and its log-likelihood ratio, at least: chance passes one word in 10,000.
LEAST_DOCS, LEAST_RATIO = 4, 15.1
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»„“”‚‘’…"
# Second-person words, and the letters that symbols stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu toi te vous votre vos ton ta tes tú usted ustedes vosotros tuyo vuestro os".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None})
FEATURES = (
    "tier0 tier1 tier2 hits tier2_count distinct near_you you_density longest_run capital_words capital_letters "
    "exclamations questions punctuation digits mixed_words undone_hits repeats log_words mean_word sum_odds max_odds"
).split()


def _fold(column: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds


def held_out() -> Column:
    """Null ids are in no fold: they count as training rows."""
    return F.coalesce(_fold() == HELD_OUT, F.lit(False))


# ------------------------------------------------------------------ features


def bare(word: str) -> str:
    return word.strip(EDGE)


def undone(word: str) -> str:
    return word.translate(LOOKALIKE)


_RUN = re.compile(r"(.)\1\1")


def word_table(words: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """Numbers of each distinct word, as it stands in the text: one row per word."""
    out = np.zeros((len(words), 13))
    for i, w in enumerate(words.to_numpy(zero_copy_only=False)):
        b = bare(w)
        low = b.lower()
        odds = lexicon.get(low, 0.0)
        row = out[i]
        if odds:
            row[0], row[1], row[2] = odds < TIERS[1], TIERS[1] <= odds < TIERS[2], odds >= TIERS[2]
        row[3] = low in SECOND_PERSON
        alpha = b.isalpha()
        row[4] = len(b) > 1 and b.isupper()
        row[5] = 0 if w.islower() else sum(c.isupper() for c in w)
        if not w.isalnum():
            row[6], row[7] = w.count("!"), w.count("?")
            row[8] = sum(not c.isalnum() for c in w)
        if not alpha:
            row[9] = sum(c.isdigit() for c in w)
            if low and any(c.isalpha() for c in low):
                row[10] = 1
                if not odds:
                    hidden = undone(low)
                    odds = lexicon.get(hidden, 0.0) if hidden != low else 0.0
                    row[11] = odds > 0
        elif not odds and _RUN.search(low):
            odds = lexicon.get(re.sub(r"(.)\1+", r"\1", low), 0.0)
            row[11] = odds > 0
        row[12] = odds
    return out


def features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """``len(texts)`` rows of the numbers named in ``FEATURES``."""
    codes, words, n = coded_words(texts)
    size = len(n)
    if not len(codes):
        return np.zeros((size, len(FEATURES)))
    table = word_table(words, lexicon)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)
    at, full = starts_of(n), n > 0
    begin = at[:-1][full]

    def total(x: np.ndarray, how=np.add) -> np.ndarray:
        out = np.zeros(size)
        out[full] = how.reduceat(x, begin)
        return out

    sums = np.stack([total(table[codes, k]) for k in range(13)], axis=1)
    chars = np.maximum(total(length[codes]), 1.0)
    many = np.maximum(n, 1)
    odds = table[codes, 12]
    hit = odds > 0
    doc = np.repeat(np.arange(size), n)
    you = np.flatnonzero(table[codes, 3] > 0)
    near, hits = np.zeros(size), np.flatnonzero(hit)
    if len(you) and len(hits):
        j = np.searchsorted(you, hits)
        for k in (np.clip(j - 1, 0, len(you) - 1), np.clip(j, 0, len(you) - 1)):
            close = (doc[you[k]] == doc[hits]) & (np.abs(you[k] - hits) <= 5)
            np.add.at(near, doc[hits[close]], 1.0)
    run = np.zeros(size)
    if len(hits):
        breaks = np.flatnonzero(np.diff(hits, prepend=-9) != 1)
        same = np.diff(np.append(breaks, len(hits)))
        np.maximum.at(run, doc[hits[breaks]], same)
    distinct = np.zeros(size)
    if len(hits):
        np.add.at(distinct, np.unique(doc[hits] * np.int64(len(words)) + codes[hits]) // len(words), 1.0)
    repeated = np.zeros(size)
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]))
    np.add.at(repeated, doc[same], 1.0)
    cols = [
        *(sums[:, k] / many for k in (0, 1, 2)), sums[:, :3].sum(1), sums[:, 2], distinct, near, sums[:, 3] / many, run, sums[:, 4] / many, sums[:, 5] / chars,
        sums[:, 6] / many, sums[:, 7] / many, sums[:, 8] / chars, sums[:, 9] / chars, sums[:, 10] / many, sums[:, 11], repeated / many, np.log1p(n),
        chars / many, sums[:, 12] / many, total(odds, np.maximum),
    ]
    return np.stack(cols, axis=1)


# ------------------------------------------------------------------ trees


@dataclass
class Trees:
    """Boosted regression trees on the log-loss, over features cut into ``bins`` quantile bins."""

    depth: int = 4
    rounds: int = 80
    rate: float = 0.12
    bins: int = 48
    ridge: float = 2.0
    least: float = 2.0
    base: float = 0.0
    cuts: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = []
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            middle = (values[1:] + values[:-1]) / 2
            self.cuts.append(middle if len(middle) < self.bins else np.unique(np.quantile(x[:, k][x[:, k] > values[0]], quantiles)))
        b = self.binned(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        at = np.full(len(y), self.base)
        width = max(len(c) for c in self.cuts) + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-at))
            tree, leaf = self._grow(b, y - p, np.maximum(p * (1 - p), 1e-6), width)
            self.trees.append(tree)
            at += self.rate * tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[tuple, np.ndarray]:
        size = 2**self.depth - 1
        feature, cut = np.zeros(size, np.int64), np.full(size, width, np.int64)  # `width`: all rows go left
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for k in range(b.shape[1]):
                key = (node - first) * width + b[:, k]
                gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                where = gain.argmax(1)
                value = gain[np.arange(n), where]
                better = value > best
                best[better], feature[first : first + n][better], cut[first : first + n][better] = value[better], k, where[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - size
        gs, hs = np.bincount(leaf, g, size + 1), np.bincount(leaf, h, size + 1)
        return (feature, cut, gs / (hs + self.ridge)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += self.rate * value[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing fit of ``y`` on ``x``."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # least x, most x, weight, mean
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, a, 1.0, b])
        while len(blocks) > 1 and (blocks[-2][3] >= blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            lo, hi = blocks[-2], blocks.pop()
            blocks[-1] = [lo[0], hi[1], lo[2] + hi[2], (lo[2] * lo[3] + hi[2] * hi[3]) / (lo[2] + hi[2])]
    knots = np.array([v for b in blocks for v in b[:2]])
    # each end keeps half a row of the other label, so that no score is a certainty
    level = np.array([(b[2] * b[3] + 0.5 * y.mean()) / (b[2] + 0.5) for b in blocks for _ in range(2)])
    return knots, np.maximum.accumulate(level)


# ------------------------------------------------------------------ model


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        m = self.trees.margin(features(texts, self.lexicon))
        # the margin settles ties inside a calibrated step
        return np.clip(0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m)), 0, 1)


def lexicon_of(labelled: DataFrame, least: int = LEAST_DOCS) -> dict[str, float]:
    """Words and their log-odds, from document counts over all of ``labelled`` (``text, toxic``).

    Every word that is evidence of toxicity beyond chance enters; rows of ``labelled`` bound how many there can be."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, n = split_words(column(part, "text"))
                toxic = np.repeat(column(part, "toxic").to_numpy(zero_copy_only=False), n)
                doc = np.repeat(np.arange(len(n)), n)
                d = flat.dictionary_encode()
                table = pa.array([bare(w).lower() for w in d.dictionary.to_numpy(zero_copy_only=False)], pa.string()).dictionary_encode()
                code = table.indices.to_numpy()[d.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                k = np.int64(max(len(table.dictionary), 1))
                once, where = np.unique(doc * k + code, return_index=True)
                code, bad = once % k, toxic[where]
                yield pa.RecordBatch.from_arrays(
                    [table.dictionary, pa.array(np.bincount(code[bad == 1], minlength=len(table.dictionary))), pa.array(np.bincount(code[bad == 0], minlength=len(table.dictionary)))],
                    ["word", "bad", "good"],
                )

    small_batches(labelled.sparkSession)
    sizes = labelled.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not all(sizes):
        return {}
    counts = labelled.mapInArrow(words, "word string, bad long, good long").where("word <> ''").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.1) / (sizes[0] + 0.2)) - F.log((F.col("good") + 0.1) / (sizes[1] + 0.2))
    found = counts.withColumn("odds", odds).where((F.col("bad") >= least) & (F.col("odds") >= TIERS[0]) & (_ratio("bad", "good", *sizes) >= LEAST_RATIO))
    return {w: float(o) for w, o in found.select("word", "odds").collect()}


def _ratio(bad: str, good: str, n_bad: int, n_good: int) -> Column:
    """Log-likelihood ratio of a word's two document counts against one rate for both kinds."""
    with_word, total = F.col(bad) + F.col(good), n_bad + n_good
    cell = lambda c, row, col: F.when(c > 0, c * F.log(c * float(total) / (row * col))).otherwise(0.0)
    held = cell(F.col(bad), with_word, F.lit(n_bad)) + cell(F.col(good), with_word, F.lit(n_good))
    return 2 * (held + cell(n_bad - F.col(bad), total - with_word, F.lit(n_bad)) + cell(n_good - F.col(good), total - with_word, F.lit(n_good)))


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit lexicon, trees and calibration on ``labelled`` (``doc_id, text, toxic``)."""
    labelled = labelled.select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")
    ).where("toxic in (0, 1)")
    labelled = stored(labelled, "labelled")
    lexicon = lexicon_of(labelled)
    kept = _drawn(labelled, "h", labelled.count(), sample)
    fields = ", ".join(f"f{k} double" for k in range(len(FEATURES)))
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(column(part, "text"), shared.value)
                yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), column(part, "toxic"), column(part, "h")], [*(f"f{k}" for k in range(x.shape[1])), "toxic", "h"])

    table = kept.mapInArrow(rows, f"{fields}, toxic int, h long").toPandas().sort_values(["h", "toxic", *(f"f{k}" for k in range(len(FEATURES)))])
    y = table["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = table[[f"f{k}" for k in range(len(FEATURES))]].to_numpy()
    fold = np.abs(table["h"].to_numpy()) % 5
    margins = np.zeros(len(y))
    for k in range(5):  # calibrated on margins of rows that the trees have not seen
        out = fold == k
        if out.any() and 0 < y[~out].sum() < (~out).sum():
            margins[out] = Trees().fit(x[~out], y[~out]).margin(x[out])
    return Model(lexicon, Trees().fit(x, y), isotonic(margins, y), float(y.mean()))


def _drawn(rows: DataFrame, h: str, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows by their hash; all, where there are no more."""
    parts = 1 << 30
    return rows.where(F.pmod(F.col(h), F.lit(parts)) < int(min(1.0, most / max(n, 1)) * parts))


def score_rows(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` added (replaced, if there)."""
    docs = docs.drop(name)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(column(part, "text")))], [*part.schema.names, name])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = 5) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled rows outside the held-out fold, about ``most`` of them.

    The labels are drawn before they meet the texts, so what is broadcast is bounded by ``most`` (16 bytes each)."""
    own = labels.select(F.col("doc_id").alias("_l_id"), F.col("toxic").alias("_l_toxic")).where("_l_toxic is not null and _l_id is not null").where(_fold("_l_id") != HELD_OUT)
    drawn = _drawn(own.withColumn("_l_h", F.xxhash64(F.lit(seed), "_l_id", "_l_toxic")), "_l_h", own.count(), most)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_l_id")).select("doc_id", "text", F.col("_l_toxic").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` added, by a model of the training fold of ``labels``."""
    return score_rows(docs, train(training_rows(docs, labels)))
