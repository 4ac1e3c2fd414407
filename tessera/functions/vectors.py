"""Vector columns over ``array<float>``; arithmetic in double."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n < EPS, 0.0).otherwise(dot(a, b) / n)


def centroid(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """One row ``centroid``: the mean of the unit vectors, again of length one."""
    unit = vectors.select(F.posexplode(l2_normalize(F.col(column))).alias("pos", "x"))
    mean = unit.groupBy("pos").agg(F.avg("x").alias("m"))
    listed = mean.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("all"))  # as many entries as dimensions
    return listed.select(l2_normalize(F.transform("all", lambda e: e["m"])).alias("centroid"))


def bucket(token: str, dim: int) -> tuple[int, float]:
    h = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % dim, 1.0 if h[4] & 1 else -1.0


class _Buckets:
    """Buckets and signs of tokens, remembered per worker up to a bound of about 30 MB."""

    def __init__(self, dim: int, most: int = 100_000):
        self.dim, self.most = dim, most
        self.words: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """Of a word and, from three letters on, of its trigrams between borders: twice the bucket, and one more for a plus."""
        found = self.words.get(w)
        if found is None:
            grams = [f"c:{p[k : k + 3]}" for p in (f"#{w}#",) for k in range(len(w))] if len(w) >= 3 else []
            found = np.array([2 * at + (sign > 0) for at, sign in (bucket(g, self.dim) for g in (w, *grams))], np.int32).tobytes()
            if len(self.words) < self.most:
                self.words[w] = found
        return found


def hash_embed(df: DataFrame, tokens: str, dim: int = 256, name: str = "vector") -> DataFrame:
    """``df`` with signed feature hashing of the words in ``tokens``, their bigrams and character trigrams.

    The features are those of :func:`tessera.functions.text.hash_tokens`; each distinct word of a
    batch is hashed once.  No built-in function has this hash."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(dim)
        for whole in batches:
            for b in _slices(whole, tokens):
                yield pa.RecordBatch.from_arrays([*b.columns, _embedded(b.column(tokens), known)], [*b.schema.names, name])

    return df.mapInArrow(embed, StructType([*df.schema.fields, StructField(name, ArrayType(FloatType()))]))


def _slices(whole: pa.RecordBatch, tokens: str, most: int = 100_000, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of so many rows, and of so many tokens where a row doesn't hold more."""
    n = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(tokens)), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < whole.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(n, before + most, "right"))))
        yield whole.slice(at, end - at)
        at, before = end, n[end - 1] if end else 0


def _embedded(lists: pa.Array, known: _Buckets) -> pa.Array:
    dim, rows = known.dim, len(lists)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(rows), n)
    parts = [known.word(w) for w in names]
    size = np.array([len(p) // 4 for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.int32)
    where, each = np.concatenate([[0], np.cumsum(size)]), size[codes]
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - where[codes], each)
    cell = np.repeat(doc, each) * dim + flat[at] // 2
    out = np.bincount(cell, flat[at] % 2 * 2.0 - 1, rows * dim)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, back = np.unique(codes[inside] * np.int64(max(len(names), 1)) + codes[inside + 1], return_inverse=True)
    hashed = np.array([bucket(f"{names[p // len(names)]}_{names[p % len(names)]}", dim) for p in pairs.tolist()]).reshape(-1, 2)
    out += np.bincount(doc[inside] * dim + hashed[back, 0].astype(np.int64), hashed[back, 1], rows * dim)
    out = out.astype(np.float64).reshape(rows, dim)
    out /= np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), EPS)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(out.reshape(-1), pa.float32()))
