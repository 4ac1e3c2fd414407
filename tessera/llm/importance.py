"""Target-distribution importance resampling over hashed word features.

Identical texts are collapsed by grouping the full text, so that features and weight
of a text are made once, however many rows hold it.  A text's features are its runs of
1 to ``longest`` words, each in the bucket of its crc32.  Buckets are counted over the
distinct texts, each count times the rows that hold the text; with the counts of the
target texts they give a gain for each bucket, a table of fixed size.  A text's weight
is the floored mean of its gains.  Weights go back to the rows by a 128-bit name of the
text, and only then meet the noise of the row's id.  Ranks come from a range
partitioning and one offset for each partition.

Defined cases: a null text has no words, as an empty one; without features the weight
is 0; rows equal in id and text have the same score and ranks next to each other; ties
go to the smaller id, then to fewer features, then to the lower weight; a null id is
smaller than all and has the noise of the text ``null``; empty tables give no gain and
no row; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import column, longs, slices, small_batches, split_words, starts_of, stored, window_rows
from tessera.operators.rank import global_rank

#: Words are runs of ASCII digits, letters and all beyond ASCII; every other byte parts them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def fold(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and each byte between words as a blank: the bytes beyond ASCII stay as they are."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, at, data = texts.buffers()
    plain = (data.to_pybytes() if data else b"").translate(_FOLD)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, at, pa.py_buffer(plain)], offset=texts.offset)


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every feature, text by text for each length of runs."""
    flat, n = split_words(fold(texts))
    owners, out = [], []
    for width in range(1, longest + 1):
        first, owner = window_rows(n, width)
        runs = flat.take(pa.array(first))
        for k in range(1, width):
            runs = pc.binary_join_element_wise(runs, flat.take(pa.array(first + k)), pa.scalar(" ", flat.type))
        coded = runs.dictionary_encode()
        crc = np.array([zlib.crc32(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.int64) % buckets
        owners.append(owner)
        out.append(crc[coded.indices.to_numpy(zero_copy_only=False)] if len(first) else np.zeros(0, np.int64))
    return np.concatenate(owners), np.concatenate(out)


def _counted(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``_t1, _t2, copies, n_features, buckets, counts`` of ``_t1, _t2, copies, text``: each text's buckets, and features in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, bucket = features(column(part, "text"), longest, buckets)
                keys, counts = np.unique(owner * buckets + bucket, return_counts=True)
                at = pa.array(starts_of(np.bincount(keys // buckets, minlength=part.num_rows)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((keys % buckets, pa.int32()), (counts, pa.int64()))]
                total = np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(column(part, k) for k in ("_t1", "_t2", "copies")), pa.array(total, pa.int64()), *lists], ["_t1", "_t2", "copies", "n_features", "buckets", "counts"]
                )

    return texts.mapInArrow(count, "_t1 long, _t2 long, copies long, n_features long, buckets array<int>, counts array<long>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of every list entry of a batch."""
    own, counts = column(batch, "buckets"), column(batch, "counts")
    n = pc.list_value_length(own).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), n), own.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()


def bucket_counts(counted: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket over all rows; ``buckets`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            row, bucket, count = _lists(batch)
            np.add.at(total, bucket, count * longs(batch, "copies")[row])
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    out = [0] * buckets
    for bucket, n in counted.select("copies", "buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of target to raw share of each bucket, floored, both shares smoothed by one."""
    s, t, k = sum(raw), sum(target), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(raw, target, strict=True)], np.int64)


def _weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, count = _lists(batch)
            total, n = np.zeros(batch.num_rows, np.int64), longs(batch, "n_features")
            np.add.at(total, row, gain[bucket] * count)
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in ("_t1", "_t2", "n_features")), pa.array(total // np.maximum(n, 1))], ["_t1", "_t2", "n_features", "weight"])

    return counted.select("_t1", "_t2", "n_features", "buckets", "counts").mapInArrow(weigh, "_t1 long, _t2 long, n_features long, weight long")


def text_keys() -> list[Column]:
    """128 bits that name a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def noise(seed: int) -> Column:
    """Thousandths of a Gumbel number that the row's id decides, floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least: int = 20, share: tuple[int, int] = (10, 100), seed: int = 2024) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_features, weight, score, rank``, and ``_t1, _t2``, which name its text.

    Of the rows with at least ``least`` words, that share with the highest scores is drawn and ranked from 1; others have no rank.
    With ``longest`` over 1 the least number of words counts as that of features of one word."""
    small_batches(docs.sparkSession)
    same = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    counted = stored(_counted(same.select(*text_keys(), "copies", "text"), longest, buckets), "features")
    aim = _counted(target.select(*text_keys(), F.lit(1).cast("long").alias("copies"), "text"), longest, buckets)
    gain = gains(bucket_counts(counted, buckets), bucket_counts(aim, buckets))
    weights = _weighed(counted, gain)
    rows = docs.select("doc_id", *text_keys()).join(weights.hint("merge"), ["_t1", "_t2"])
    # a text of w words has w + (w-1) + ... features: as many as this, if it has the words
    enough = sum(max(0, least - k) for k in range(longest))
    rows = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (F.col("n_features") >= enough).alias("_enough"), "_t1", "_t2")
    ranked = global_rank(rows, [F.desc("_enough"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")])
    drawn = F.floor(F.lit(share[0]) * F.col("_n") / share[1])
    n = ranked.agg(F.count_if("_enough").alias("_n"))
    rank = F.when(F.col("_enough") & (F.col("rank") < drawn), F.col("rank") + 1)
    return ranked.join(F.broadcast(n)).select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "_t1", "_t2")  # n: one row


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns; rows equal in id and text stay together."""
    won = scored(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("_t1").alias("_w1"), F.col("_t2").alias("_w2"))
    rows = docs.select(F.struct("*").alias("row"), *text_keys())
    kept = rows.join(won.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_w1")) & (F.col("_t2") == F.col("_w2")), "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
