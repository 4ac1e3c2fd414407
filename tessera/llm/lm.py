"""Language-model scoring by a hashed maximum-entropy model.

Tokens are words, lower-cased in A-Z, then one end per text.  The probability of a
token is factored: its class after the history, its slot in that class after the
history, and its share of the slot's training tokens, one added for each known
token and one for all unknown ones.  Each of the ``OWN`` slots of a class belongs
to one frequent word; the words of a shape (script, ending, length) share the other
slots of a class by hash.  Both softmaxes have weights for hashed features of the
history: the word before and its cell, the word before that, the last two words,
and the skip pair of the last and the third last.

Counts cover all training texts: each group of documents names its distinct words
once, the rows of a word are summed where they meet, and return to their groups;
no table of all words is ever in one place.  The weights are trained on all
training texts, at every size, in ``STEPS`` minibatches, a hash of the id deciding
which; each task sums the gradient of its tokens in sparse batches, the sums are added
by blocks of weights, and the driver moves the weights.  What reaches it or is
broadcast has the fixed size of the weight tables and of the ``TOP`` list.

Defined cases: null text counts as empty (one end token); null ids train, and are
scored, as any other; repeated rows each count; words are told apart by a 64-bit
hash; without training texts every token is unknown; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import U64, coded_words, column, hash_words, mix, pack, partitions, slices, small_batches, starts_of, stored, text_bytes, unpack

FOLDS, HELD_OUT = 7, 2
CLASSES = SLOTS = 32
#: Slots of a class that are one word's own; the others are shared by hash.
OWN = 20
TOP, CELLS = CLASSES * OWN, CLASSES * SLOTS
SHAPES = 30
#: Rows of a hashed weight table, and features of a history with the bias.
ROWS, FEATURES = 1 << 14, 6
#: Minibatches; every training document is in one of them.
STEPS = 6
#: Bytes of text in one group of documents.
GROUPED = 24 << 20
#: Tokens of a batch, of a training task at least, and rows of a block of weights.
BATCH, TASK, BLOCK = 1 << 12, 8 << 20, 1 << 10
#: What holds back the weights of rare features.
RIDGE, DAMPING = 0.3, 1.0
END = int.from_bytes(xxhash.xxh3_128_digest(b" end")[:8], "big")  # no word has a space
START = int.from_bytes(xxhash.xxh3_128_digest(b" start")[:8], "big")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def shapes_of(words: pa.Array) -> np.ndarray:
    """One of ``SHAPES`` for each word: script by the first two bytes beyond ASCII, ending, bytes."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[at[1:] - 1]
    letter = (last > 127) | (last - 65 < 26) | (last - 97 < 26)  # unsigned: below 65 wraps
    ending = np.where(letter, 0, np.where(last == 46, 1, 2))
    beyond = np.append(np.flatnonzero(data[: at[-1]] > 127), at[-1])
    first = beyond[np.searchsorted(beyond, at[:-1])]
    wide = first < at[1:]
    first = np.minimum(first, len(data) - 2) if len(data) > 1 else np.zeros_like(first)
    pair = data[first].astype(np.int64) << 8 | data[np.minimum(first + 1, len(data) - 1)]
    script = np.where(wide, 1 + (pair * 2654435761 >> 8) % 4, 0)
    return (script * 3 + ending) * 2 + (np.diff(at) > 6)


# ------------------------------------------------------------------ counts


def _hashed(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of some texts: word number of each token, tokens of each text, hashes of the words; the end is the last word."""
    codes, words, n = coded_words(column(part, "text"), lower=True)
    h = np.append(hash_words(words)[0], U64(END)) if len(words) else np.array([END], U64)
    size = n + 1
    ends = np.cumsum(size) - 1
    token = np.full(int(size.sum()), len(words), np.int64)
    token[np.delete(np.arange(len(token)), ends)] = codes
    return token, size, h, words


def _shapes(words: pa.Array) -> np.ndarray:
    return np.append(shapes_of(words), SHAPES)


def _requests(docs: DataFrame) -> DataFrame:
    """``g, h, n, shape``: of each group its distinct tokens and how often they train."""

    def distinct(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, shapes = [], [], []
        for batch in batches:
            for part in slices(batch):
                token, size, h, words = _hashed(part)
                trains = np.repeat(~column(part, "held_out").to_numpy(zero_copy_only=False), size)
                hashes.append(h)
                counts.append(np.bincount(token, trains, len(h)))
                shapes.append(_shapes(words))
        h, first, where = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.bincount(where, np.concatenate(counts), len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), key[0].as_py(), np.int32)), pa.array(h.view(np.int64)), pa.array(n), pa.array(np.concatenate(shapes)[first].astype(np.int32))], ["g", "h", "n", "shape"]
        )

    return docs.groupBy("g").applyInArrow(distinct, "g int, h long, n long, shape int")


@dataclass
class Model:
    """Sums over all training tokens, and weights; of fixed size."""

    top: np.ndarray  # hashes of the TOP tokens, ascending, and their cells
    top_cell: np.ndarray
    cell_tokens: np.ndarray | None = None
    cell_distinct: np.ndarray | None = None
    weights: tuple[np.ndarray, np.ndarray] | None = None  # of classes, and of slots

    @property
    def tokens(self) -> int:
        return int(self.cell_tokens.sum())

    def cells(self, h: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = np.minimum(shapes, CLASSES - 1) * SLOTS + OWN + (h % U64(SLOTS - OWN)).astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
            found = self.top[at] == h
            out[found] = self.top_cell[at[found]]
        return out

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.tokens + int(self.cell_distinct.sum()) + 1.0))

    def inside(self, n: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Logarithm of a token's share of its cell."""
        return np.log10((n + 1.0) / (self.cell_tokens + self.cell_distinct + 1.0)[cells])

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        share = (self.cell_tokens + self.cell_distinct + 1.0).reshape(CLASSES, SLOTS)
        return share.sum(axis=1) / share.sum(), share / share.sum(axis=1, keepdims=True)


def _summed(vocabulary: DataFrame) -> Model:
    """The model without weights: its TOP list and the sums of its cells, CELLS rows."""
    rows = vocabulary.where("n > 0").orderBy(F.col("n").desc(), "h").limit(TOP).collect()
    top = np.array([r["h"] for r in rows], np.int64).view(U64)
    order = np.argsort(top)
    model = Model(top[order], (order // OWN * SLOTS + order % OWN).astype(np.int64))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), np.int64)
        for b in batches:
            n = b.column("n").to_numpy()
            cell = model.cells(b.column("h").to_numpy().view(U64), b.column("shape").to_numpy().astype(np.int64))
            sums[0] += np.bincount(cell, n, CELLS).astype(np.int64)
            sums[1] += np.bincount(cell[n > 0], minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(sums[0]), pa.array(sums[1])], ["cell", "tokens", "known"])

    model.cell_tokens, model.cell_distinct = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for cell, tokens, known in vocabulary.mapInArrow(cells, "cell long, tokens long, known long").groupBy("cell").agg(F.sum("tokens"), F.sum("known")).collect():
        model.cell_tokens[cell], model.cell_distinct[cell] = tokens, known
    return model


# ------------------------------------------------------------------ the softmaxes


def feature_rows(words: np.ndarray, cells: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class table and of the slot table for each token of texts of so many tokens.

    ``words`` are hashes, ``cells`` the tokens' own cells; rows of the slot table hang on the token's class too."""
    place = np.arange(len(words)) - np.repeat(starts_of(size)[:-1], size)

    def back(x: np.ndarray, k: int, start) -> np.ndarray:
        out = np.full(len(x), start, x.dtype)
        out[k:] = x[:-k] if len(x) > k else out[k:]
        out[place < k] = start
        return out

    one, two, three = (back(words, k, U64(START)) for k in (1, 2, 3))
    before = back(cells, 1, CELLS).astype(U64)
    odd = U64(0x9E3779B97F4A7C15)
    keys = [mix(x + U64(k * int(odd) % 2**64)) for k, x in enumerate((before, one, two, one * odd + two, one * odd + three), 1)]
    within = lambda h, n: ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)
    own = cells // SLOTS
    scaled = (own.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)
    classes = np.stack([np.zeros(len(words), np.int32), *(1 + within(h, ROWS - 1) for h in keys)])
    slots = np.stack([own.astype(np.int32), *(CLASSES + within((h ^ scaled) * odd, ROWS - CLASSES) for h in keys)])
    return classes, slots


def log_shares(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural logarithms of all probabilities, for each column of feature rows."""
    x = _sums(rows, weights)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def shares(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """All probabilities, for each column of feature rows."""
    x = np.exp(_sums(rows, weights))
    return x / x.sum(axis=1, keepdims=True)


def _sums(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = weights[rows[0]]
    for r in rows[1:]:
        x += weights[r]
    return x - x.max(axis=1, keepdims=True)


def token_logs(words: np.ndarray, cells: np.ndarray, size: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each token's cell."""
    out = np.zeros(len(words))
    for rows, table, label in zip(feature_rows(words, cells, size), weights, (cells // SLOTS, cells % SLOTS), strict=True):
        for k in range(0, len(out), BATCH):
            x = _sums(rows[:, k : k + BATCH], table)
            out[k : k + BATCH] += x[np.arange(len(x)), label[k : k + BATCH]] - np.log(np.exp(x).sum(axis=1))
    return out


def _batches(docs: DataFrame, model: Model) -> DataFrame:
    """``step, packed``: the training tokens of each minibatch, as hashes, cells and text sizes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                token, size, h, words = _hashed(part)
                cell = model.cells(h, _shapes(words)).astype(np.uint16)[token]
                word, steps = (h >> U64(32)).astype(np.uint32)[token], column(part, "step").to_numpy()
                out = []
                for step in np.unique(steps).tolist():
                    own = steps == step
                    some = np.repeat(own, size)
                    out.append((step, pack(word[some], cell[some], size[own].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["step", "packed"])

    step = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(STEPS)).cast("int").alias("step")
    return docs.where(~F.col("held_out")).select("text", step).mapInArrow(encode, "step int, packed binary")


def gradient(words: np.ndarray, cells: np.ndarray, size: np.ndarray, weights: tuple[np.ndarray, np.ndarray], sums: list[list[np.ndarray]]) -> None:
    """Adds to ``sums``, for both tables, how often each outcome was seen (a row per feature row) and expected (a column per feature row)."""
    for rows, table, label, (seen, expected) in zip(feature_rows(words, cells, size), weights, (cells // SLOTS, cells % SLOTS), sums, strict=True):
        width = table.shape[1]
        for r in rows:
            seen += np.bincount(r * np.int64(width) + label, minlength=ROWS * width).reshape(ROWS, width)
        wide = 16 * BATCH
        for k in range(0, len(words), wide):
            some = rows[:, k : k + wide].astype(np.intp)
            p = np.concatenate([shares(some[:, j : j + BATCH], table) for j in range(0, some.shape[1], BATCH)])
            for outcome, own in enumerate(np.ascontiguousarray(p.T)):
                for r in some[1:]:
                    expected[outcome] += np.bincount(r, own, ROWS)
                expected[outcome, :width] += np.bincount(some[0], own, width)  # a bias row is the class, or 0


def moved(table: np.ndarray, seen: np.ndarray, expected: np.ndarray, free: int) -> np.ndarray:
    """The weights after one step, each scaled by its curvature; rows before ``free`` are biases, which nothing draws to 0."""
    total = np.maximum(seen.sum(axis=1, keepdims=True), 1.0)
    drawn = np.full((ROWS, 1), RIDGE)
    drawn[:free] = 0
    # FEATURES weights move together, hence the division
    move = (seen - expected - drawn * table) / (FEATURES * (expected * (1 - np.minimum(expected / total, 0.999)) + DAMPING))
    return (table + np.clip(move, -1.5, 1.5)).astype(np.float32)


def train(batches: DataFrame, model: Model, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both softmaxes after one step for each minibatch; they begin at the shares of the cells."""
    spark = batches.sparkSession
    classes, slots = model.priors()
    weights = (np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SLOTS), np.float32))
    weights[0][0], weights[1][:CLASSES] = np.log(classes), np.log(slots)
    parts = max(spark.sparkContext.defaultParallelism, model.tokens // (steps * TASK))
    for step in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def partial(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [[np.zeros((ROWS, w), np.int64), np.zeros((w, ROWS))] for w in (CLASSES, SLOTS)]
            some = False
            for b in rows:
                for packed in b.column("packed").to_pylist():
                    word, cell, size = unpack(packed)
                    gradient(word.astype(U64), cell.astype(np.int64), size.astype(np.int64), shared.value, sums)
                    some = True
            if some:
                blocks = [(t * ROWS + k, pack(seen[k : k + BLOCK].astype(np.uint32).reshape(-1), expected[:, k : k + BLOCK].T.astype(np.float32).reshape(-1))) for t, (seen, expected) in enumerate(sums) for k in range(0, ROWS, BLOCK)]
                yield _blocks(blocks)

        def added(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, expected = 0, 0
            for b in rows:
                for packed in b.column("packed").to_pylist():
                    x, y = unpack(packed)
                    seen, expected = seen + x.astype(np.int64), expected + y.astype(np.float64)
            yield _blocks([(key[0].as_py(), pack(seen, expected))])

        sums = batches.where(F.col("step") == step).select("packed").coalesce(parts).mapInArrow(partial, "block long, packed binary").groupBy("block").applyInArrow(added, "block long, packed binary")
        seen, expected = np.zeros((2 * ROWS, SLOTS), np.int64), np.zeros((2 * ROWS, SLOTS))
        for block, packed in sums.collect():  # the size of the weight tables
            x, y = unpack(packed)
            seen[block : block + BLOCK], expected[block : block + BLOCK] = x.reshape(-1, SLOTS), y.reshape(-1, SLOTS)
        weights = tuple(moved(w, seen[k * ROWS : (k + 1) * ROWS], expected[k * ROWS : (k + 1) * ROWS], free) for k, (w, free) in enumerate(zip(weights, (1, CLASSES), strict=True)))
        shared.destroy()
    return weights


def _blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["block", "packed"])


# ------------------------------------------------------------------ scoring


def _scored(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(own: pa.Table, counted: pa.Table) -> pa.Table:
        model, out = shared.value, []
        h = column(counted, "h").to_numpy().view(U64)
        order = np.argsort(h)
        h, n, shapes = h[order], column(counted, "n").to_numpy()[order], column(counted, "shape").to_numpy()[order].astype(np.int64)
        cells = model.cells(h, shapes)
        base, inside, known = model.base(n), model.inside(n, cells), (n > 0).astype(np.int64)
        for part in slices(own):
            token, size, words, _ = _hashed(part)
            at = np.searchsorted(h, words)[token]
            # the same 32 bits of a word that training saw
            logs = token_logs((words >> U64(32))[token], cells[at], size, model.weights) / np.log(10)
            begin = starts_of(size)[:-1]
            total = lambda x: np.add.reduceat(x, begin)  # noqa: E731, B023
            out.append(
                pa.table(
                    {
                        "doc_id": column(part, "doc_id"),
                        "held_out": column(part, "held_out"),
                        "n_tokens": size.astype(np.int64),
                        "n_known": total(known[at]),
                        "train_tokens": np.full(len(size), model.tokens),
                        "base_score": total(base[at]),
                        "score": total(inside[at] + logs),
                    }
                )
            )
        return pa.concat_tables(out)

    return docs.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(score, schema)


def _grouped(docs: DataFrame) -> DataFrame:
    n = partitions(docs.sparkSession, text_bytes(docs), GROUPED)
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"), group)


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training rows of ``_grouped`` documents, and the counts that each group needs (``g, h, n, shape``)."""
    word = Window.partitionBy("h")
    counted = _requests(rows).select("g", "h", "shape", F.sum("n").over(word).alias("n"), F.row_number().over(word.orderBy("g")).alias("nr"))
    counted = stored(counted.select("g", "h", "n", "shape", (F.col("nr") == 1).alias("first")), "counts")
    model = _summed(counted.where("first"))
    model.weights = train(stored(_batches(rows, model), "tokens", "step"), model)
    return model, counted.select("g", "h", "n", "shape")


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = _grouped(docs)
    model, counts = fit(rows)
    return _scored(rows, counts, model)
