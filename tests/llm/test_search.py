"""Hard negatives, importance resampling and SimHash groups against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import DATA, same
from tessera.llm import importance, pivots, queries, simhash

LOW = {c: c + 32 for c in range(65, 91)}
least = lambda x: (x is not None, x or 0)


def collected(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance"])
def test_sql(spark, name):
    same(spark, name, queries.queries(), queries.oracle_sql())


# ------------------------------------------------------------------ hard negatives


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    vec = lambda n=6: [rng.choice([rng.gauss(0, 1), 0.0, 0.5, -0.25, 1.0]) for _ in range(n)]
    near = [vec() for _ in range(4)]
    rows = [(k, [x + rng.gauss(0, 0.2) for x in near[k % 4]] if k % 3 else vec(), rng.choice([0, 0, 0, 1, 2, 9])) for k in range(400)]
    rows += [(500, near[0], 1)] * 3 + [(600, None, 1), (700, near[1], None), (800, [float("nan"), 1.0], 0), (801, [1.0, None], 0), (900, [float("inf")], 0)]
    rows += [(1000, [], 0), (1100, [0.5, 0.5], 2), (1200, [1e12] * 6, 0), (None, near[2], 0), (-100, near[3], 0), (1300, near[0], 77), (401, near[0], 0), (402, near[0], 1)]
    return [(*r, "x", 1, 2, 3.0) for r in rows]


def plain_negatives(rows, positives, negatives):
    live = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    live = [r for r in live if sum(x * x for x in r[1]) <= 2**56]
    out = []
    for k, (a, v, lab) in enumerate(live):
        if a is None or a % 100:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), least(i), i, b, n) for n, (i, w, b) in enumerate(live)]
        for s, _, p, _, _ in sorted(x for x in score if x[3] == lab and x[4] != k)[:positives]:
            fit = sorted(x for x in score if x[3] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, place + 1, n, -s, -t) for place, (t, _, n, _, _) in enumerate(fit)]
    return sorted(out, key=repr)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("chunk", "slice_rows", "positives", "negatives"), [(2048, 1 << 18, 5, 10), (3, 50, 2, 3), (1, 1000, 1, 1)])
def test_hard_negatives(spark, vectors, chunk, slice_rows, positives, negatives):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, row string, id int, norm int, score double").repartition(3)
    got = pivots.hard_negatives(df, positives=positives, negatives=negatives, chunk=chunk, slice_rows=slice_rows)
    want = plain_negatives(vectors, positives, negatives)
    assert collected(got, *NEGATIVES) == want and len(want) > 5


def test_no_vectors(spark):
    for rows in ([], [(100, [1.0], 1)], [(100, None, 1)], [(1, [1.0], 1), (2, [2.0], 2)]):
        assert pivots.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 9))
def test_brackets_hold(seed, rows, dim):
    rng = np.random.default_rng(seed)
    v = rng.integers(-300, 300, (rows, dim)).astype(float)
    most = float((v * v).sum(axis=1).max())
    p = pivots.far_apart(pivots.augmented(v, most), 4)
    d, da = pivots.distances(pivots.augmented(v, most), p), pivots.distances(np.concatenate([v, np.zeros((rows, 1))], axis=1), p)
    s = object.__new__(pivots.Search)
    s.most = most
    near, far = np.abs(da[:, None] - d[None]).max(axis=2), (da[:, None] + d[None]).min(axis=2)
    low, high = s.bracket(near, far, (v * v).sum(axis=1)[:, None])
    assert (low <= v @ v.T).all() and (v @ v.T <= high).all()


def test_brackets_save_scores():
    """Rows in tight clusters: most pairs are ruled out by their distances alone."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (8, 16))
    v = (centres[np.arange(4000) % 8] + rng.integers(-20, 20, (4000, 16))).astype(float)
    v = v[np.argsort(np.arange(4000) % 8, kind="stable")]
    most = float((v * v).sum(axis=1).max())
    p = pivots.far_apart(pivots.augmented(v, most), 8)
    d, da = pivots.distances(pivots.augmented(v, most), p), pivots.distances(np.concatenate([v, np.zeros((4000, 1))], axis=1), p)
    held = range(0, 4000, 100)
    blobs = lambda m, kind: pa.array([m[k].astype(kind).tobytes() for k in held])
    names = ["row", "label", "v", "da", "lo", "hi"]
    bounds = [pa.array([[x]] * len(held), pa.list_(pa.int64())) for x in (pivots.LEAST, pivots.GREATEST)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([0] * len(held), pa.int64()), blobs(v, "<i4"), blobs(da, "<f8"), *bounds], names)
    s = pivots.Search([batch], 16, most, True, 5)
    for g in range(0, 4000, 250):
        at = np.arange(g, g + 250)
        s.pass_by(0, at, at, v[at].astype(np.int64), d[at])
        s.pool.settle()
    got = s.found()
    want = [(a, -t, i) for a in held for t, i in sorted((-int(v[a] @ v[i]), i) for i in range(4000) if i != a)[:5]]
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("row", "score", "found_id")), strict=True)) == sorted(want)
    assert s.scored < 0.6 * len(held) * 4000


# ------------------------------------------------------------------ importance


def plain_importance(rows, target, longest=1, least_words=20, share=(10, 100), buckets=10_000):
    def grams(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW).encode())
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(b for r in rows for b in grams(r[1])[0]), Counter(b for x in target for b in grams(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for r in rows:
        g, n = grams(r[1])
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least_words])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], least(r[0]), r[1], r[2]))
    for k, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


SCORES = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize(("longest", "share"), [(1, (10, 100)), (3, (60, 100))])
def test_importance(spark, docs, corpus, longest, share):
    target = [corpus[3][1], corpus[7][1], None, "", "Été\x00naïve-no. 7 x_y", corpus[3][1]]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.scored(docs, aim, longest=longest, share=share)
    assert collected(got, *SCORES) == plain_importance(corpus, target, longest, share=share)


def test_importance_draw(spark, docs, corpus):
    aim = spark.createDataFrame([(corpus[3][1],)], "text string")
    got = importance.draw(docs, aim, share=(30, 100))
    ranked = importance.scored(docs, aim, share=(30, 100)).where("rank is not null")
    assert got.columns == docs.columns
    assert {(r[0]) for r in got.select("doc_id").collect()} == {r[0] for r in ranked.select("doc_id").collect()}


def test_importance_of_nothing(spark, docs, nothing, corpus):
    none = spark.createDataFrame([], "text string")
    assert importance.scored(nothing, none).count() == 0 and importance.draw(nothing, none).count() == 0
    assert collected(importance.scored(docs, none), *SCORES) == plain_importance(corpus, [])


def test_words_are_bytes():
    texts = [None, "Ab-c1_é É\x7fz\x00", "", "÷x·y"]
    want = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW).encode()) for t in texts]
    for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        assert [x.encode().split() for x in importance.fold(array).to_pylist()] == want


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(fps, radius=3):
    """For each fingerprint, all that links reach from it."""
    fps, seen = sorted(set(fps)), {}
    array = np.array(fps, np.uint64)
    for fp in fps:
        if fp in seen:
            continue
        group, todo = {fp}, [fp]
        while todo:
            for x in array[np.bitwise_count(array ^ np.uint64(todo.pop())) <= radius].tolist():
                if x not in group:
                    group.add(x)
                    todo.append(x)
        seen |= dict.fromkeys(group, frozenset(group))
    return seen


def test_simhash(docs, corpus, nothing):
    fps = [plain_fingerprint(r[1]) for r in corpus]
    group = plain_roots(fps)
    want = [(r[0], fp, min((s[0] for s, x in zip(corpus, fps, strict=True) if x in group[fp]), key=least)) for r, fp in zip(corpus, fps, strict=True)]
    got = simhash.similar_groups(docs).select("doc_id", F.conv(F.hex("fp"), 16, 10).alias("fp"), "component_id")
    assert sorted(((a, int(b), c) for a, b, c in got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.similar_groups(nothing).count() == 0


def test_long_text_in_steps(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("AbcdEfghij") for _ in range(n)) for n in (1, 2, 3, 500, 0, 40)] + [None]
    monkeypatch.setattr(simhash, "STEP", 37)
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


def clustered(seed, sizes, alone):
    """Fingerprints in walks of few flipped bits from a centre each, and some at random."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(alone)} | {0, 2**64 - 1, 1, 2**63}
    for size in sizes:
        centre = rng.getrandbits(64)
        bits = rng.sample(range(64), 16)
        own = [centre]
        for _ in range(size):
            x = rng.choice(own)
            for b in rng.sample(bits, rng.randint(1, 5)):
                x ^= 1 << b
            own.append(x)
        out |= set(own)
    return sorted(out)


@pytest.mark.parametrize(("block", "seed"), [(8192, 1), (7, 2), (40, 3)])
def test_components_of_fingerprints(spark, block, seed):
    fps = clustered(seed, (300, 40, 6, 2, 2), 150)
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.linked_classes(classes, block).collect()}
    group = plain_roots(fps)
    for a, b in combinations(fps, 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (b in group[a])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_no_pair_escapes_the_grid(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    u, v = simhash.unary(np.array([x, y], np.uint64)).tolist()
    assert (u ^ v).bit_count() <= (x ^ y).bit_count()
    assert any((u ^ v) & (m % (1 << 64)) == 0 for m in simhash.masks())
