"""Shared helpers: word splitting on Arrow arrays, hashing, shared storage.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``.  All helpers
treat a null text as an empty one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 4 << 20
#: Bytes of text in one shuffled group of documents.
GROUP_BYTES = 12 << 20
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


# ------------------------------------------------------------------ session


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound Arrow batches by bytes, so that long documents do not pile up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a machine-local one only on a local master, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t", *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, by folders of ``by``, and read it back: later reads survive lost executors.

    Folders go at exit, or before by ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(*done: DataFrame) -> None:
    """Remove stored tables that no plan in use reads any more."""
    for df in done:
        for file in df.inputFiles()[:1]:
            _remove(df.sparkSession, file.rsplit("/", 1)[0])


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession, n_bytes: float, per: int = GROUP_BYTES) -> int:
    """Number of shuffled groups for so many bytes, no fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(n_bytes / per) + 1)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one number reaches the driver."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def row_keys(first: str = "_k1", second: str = "_k2") -> list[Column]:
    """128 bits that name a row by id and text, never null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), text).alias(first), F.xxhash64(text, F.lit(1), F.col("doc_id"), F.col("doc_id").isNull()).alias(second)]


def with_columns(rows: DataFrame, names: list[str], **more: Column) -> DataFrame:
    """The fields ``names`` of the column ``row``, and the columns ``more``, which replace fields of these names."""
    taken = {name.lower() for name in more}
    return rows.select(*[F.col("row").getField(name).alias(name) for name in names if name.lower() not in taken], *[c.alias(name) for name, c in more.items()])


def keep_named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys ``_k1, _k2`` stand in ``kept``, with their columns; of rows equal in id and text, one.

    Texts move once: the copies of a row are found in the partition of its keys."""
    names = kept.select(F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"))
    rows = docs.select(F.struct("*").alias("row"), *row_keys()).hint("merge")
    found = rows.join(names, (rows["_k1"] == names["_n1"]) & (rows["_k2"] == names["_n2"]), "left_semi").dropDuplicates(["_k1", "_k2"])
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


# ------------------------------------------------------------------ Arrow


def column(batch, name: str) -> pa.Array:
    """A column as one array that starts at the head of its buffers: string kernels go wrong on slices of a batch."""
    c = batch.column(name)
    chunks = c.chunks if isinstance(c, pa.ChunkedArray) else [c]
    return pa.concat_arrays([*chunks, pa.array([], c.type)])


def longs(batch, name: str, null: int = 0) -> np.ndarray:
    return pc.fill_null(column(batch, name), null).to_numpy(zero_copy_only=False)


def slices(batch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Row slices of a batch or table whose texts hold about ``limit`` bytes, one row at least."""
    n = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, x in enumerate(n):
        if total and total + x > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += x
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    size = pc.binary_length(flat)
    if pc.min(size).as_py() != 0:
        return flat, np.diff(at)
    real = pc.not_equal(size, 0)  # a text without words gives one empty word
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), before[at[1:]] - before[at[:-1]]


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each word, the distinct words, the number of words of each text."""
    flat, n = split_words(texts, lower)
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary, n


def hash_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word (the halves of a 128-bit one)."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False))), dtype=">u8")
    h = h.astype(U64).reshape(-1, 2)
    return h[:, 0].copy(), h[:, 1].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1)


def window_hash(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the words i .. i+width-1 for every i, over a whole run of words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k, a in enumerate(odd_numbers(width, seed)):
        out += h[k : k + n] * a
    return mix(out)


def starts_of(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def window_rows(n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``n`` words each: the first words of the windows that lie in one text, and their text."""
    at = starts_of(n)
    each = np.maximum(n - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), each)
    return np.arange(each.sum()) - np.repeat(starts_of(each)[:-1], each) + at[:-1][doc], doc


# ------------------------------------------------------------------ packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes: each split into byte planes, then compressed."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        kind = a.dtype.str.encode().ljust(8)
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        parts += [kind, np.uint32(len(a)).tobytes(), planes]
    return zstandard.compress(b"".join(parts), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    k, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for _ in range(k):
        dtype = np.dtype(raw[at : at + 8].decode().strip())
        n = int(np.frombuffer(raw, np.uint32, 1, at + 8)[0])
        at += 12
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out
