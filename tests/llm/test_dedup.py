"""Exact, substring, line and near deduplication against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import _common, exact_dedup, line_dedup, near_dedup, substring_dedup
from tessera.llm._common import column, pack, slices, split_words, unpack

LOW = {c: c + 32 for c in range(65, 91)}
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
least = lambda x: -1 if x is None else x


def collected(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_split_words_of_slices():
    texts = ["a bb", None, " x\x0by\x0c z\x1cq ", "", "É é", "last one"] * 40
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got, n = [], []
    for part in slices(batch, limit=20):
        flat, k = split_words(column(part, "text"))
        got += flat.to_pylist()
        n += k.tolist()
    assert got == [w for t in texts for w in words(t)] and n == [len(words(t)) for t in texts]


def test_pack():
    arrays = [np.arange(7, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int32), np.array([3, -1], np.int32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


# ------------------------------------------------------------------ exact


def test_exact(docs, corpus, nothing):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in corpus:
        groups[plain(r[1])].append((-len(r[1] or ""), least(r[0]), r[0], r[1]))
    want = []
    for r in corpus:
        g = groups[plain(r[1])]
        _, _, keep, text = min(g, key=lambda x: x[:2])
        want.append((r[0], keep, len(g), r[0] == keep and r[1] == text, sha(plain(r[1]))))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collected(exact_dedup.exact_groups(docs), *names) == sorted(want, key=repr)
    assert collected(exact_dedup.exact_groups(docs, (2, 5)), *names) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.fixture
def plans(monkeypatch):
    """The plans that an operator writes on its way."""
    seen = []

    def noting(df, name="t"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return _common.stored(df, name)

    monkeypatch.setattr(exact_dedup, "stored", noting)
    monkeypatch.setattr(line_dedup, "stored", noting)
    return seen


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, exact_dedup.drop_copies, line_dedup.dedup_lines])
def test_native(docs, plans, operator):
    plans.append(operator(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and not any(re.search("Python|Pandas|Arrow|RDD", p.replace("Scan ExistingRDD", "")) for p in plans)


# ------------------------------------------------------------------ lines


def plain_lines(rows):
    rows = sorted(set((r[0], r[1] or "") for r in rows), key=lambda r: (least(r[0]), r[1]))
    at = defaultdict(list)
    for d, (doc, t) in enumerate(rows):
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            w = "\n".join(lines[k : k + 3])
            if words(w):
                at[w].append((d, k))
    gone = defaultdict(set)
    for found in at.values():
        for d, k in found[1:]:
            gone[d] |= {k, k + 1, k + 2}
    return {r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[d]) for d, r in enumerate(rows)}


def test_lines(docs, corpus, nothing):
    want = plain_lines(corpus)
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(corpus)
    assert any(r["n_removed"] for r in out)
    for r in out:
        text = want[r["doc_id"], r["text"] or ""]
        assert r["kept_text"] == text or (text == "" and r["kept_text"] == "")
        assert r["n_lines"] == len((r["text"] or "").split("\n"))
        assert (r["_ld_id"], r["_k1"], r["row"]) == (8, 9, 10)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_of_long_documents(spark):
    """Work is linear in lines: four times as many take less than eight times as long."""
    took = []
    for n in (16_000, 64_000):
        rows = [(k, "\n".join(f"line {j} {k if j % 9 == 4 else ''}" for j in range(n))) for k in range(2)]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()
        df.count()
        began = time.perf_counter()
        out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
        took.append(time.perf_counter() - began)
        want = plain_lines(rows)
        assert all(out[k]["kept_text"] == want[k, t] for k, t in rows) and out[1]["n_removed"] > n / 2
    assert took[1] < 8 * took[0]


# ------------------------------------------------------------------ substrings


def plain_substrings(rows, width):
    first = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, 10**9), least(r[0]))
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < least(r[0]):
                gone |= set(range(k, k + width))
        out.append((r[0], len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("width", [13, 4])
def test_substrings(docs, corpus, nothing, width):
    want = plain_substrings(corpus, width)
    assert any(r[2] for r in want)
    assert collected(substring_dedup.dedup_substrings(docs, width), *NAMES) == want
    assert substring_dedup.dedup_substrings(nothing, width).count() == 0


@pytest.mark.parametrize("cells, size", [(1 << 6, 1 << 4), (1 << 12, 1 << 7)])
def test_substrings_with_a_full_sketch_and_many_ranges(docs, corpus, monkeypatch, cells, size):
    """A sketch too small for the corpus lets more through and changes nothing; ranges and buckets neither."""
    monkeypatch.setattr(substring_dedup, "LEAST_CELLS", cells)
    monkeypatch.setattr(substring_dedup, "CELLS_PER_WINDOW", 0)
    monkeypatch.setattr(substring_dedup, "RANGE", size)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1000)
    assert collected(substring_dedup.dedup_substrings(docs, 6), *NAMES) == plain_substrings(corpus, 6)


def test_sketch_has_room_at_every_size():
    """Few unrepeated windows pass a row, whatever the number of windows."""
    for bits in (14, 20):
        h = np.random.default_rng(1).integers(0, 2**63, (1 << bits) // substring_dedup.CELLS_PER_WINDOW, dtype=np.uint64)
        cells, twice = substring_dedup._asked(h, 0, bits)
        assert (len(h) - (~twice).sum()) / len(h) < 0.25


# ------------------------------------------------------------------ near


def plain_near(rows, share=75):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    comp = defaultdict(list)
    for k, r in enumerate(rows):
        comp[root(k)].append(r[0])
    out = []
    for k, r in enumerate(rows):
        c = min(comp[root(k)], key=least) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), c, c == r[0]))
    return sorted(out, key=repr)


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near(docs, corpus, nothing):
    assert collected(near_dedup.near_groups(docs), *NEAR) == plain_near(corpus)
    assert near_dedup.near_groups(nothing).count() == 0
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[:3] for r in plain_near(corpus) if r[3]})


@pytest.fixture(scope="module")
def chain(spark):
    """Texts that drift: neighbours are near, ends are not; and many copies of two that meet half-way."""
    rows, w = [], [f"w{k}" for k in range(60)]
    for k in range(40):
        rows.append((500 - k, " ".join(w)))
        w = [*w[:k], f"x{k}", *w[k + 1 :]]
    for k in range(60):
        v = [f"v{j}" for j in range(50)]
        for j in range(k % 6):
            v[(7 * k + 9 * j) % 50] = f"y{k}"
        rows.append((1000 + k, " ".join(v)))
    return rows


@pytest.mark.parametrize("size", [4 << 20, 1500])
def test_near_chains(spark, chain, size):
    """Streams and blocks of a few sets change nothing."""
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert collected(near_dedup.near_groups(df, block=size, stream=size), *NEAR) == plain_near(chain)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_near_mixed_groups(spark, seed):
    """Groups whose members lie around the threshold, so that hubs settle few of them."""
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(70)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(6)}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_dedup.near_groups(df, block=6000, stream=6000), *NEAR) == plain_near(rows)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1100)} | {2000: 2000, 2001: 2000}
    assert got == want


def test_signature_estimates():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = near_dedup.signature(np.sort(both[:2500])), near_dedup.signature(np.sort(both[500:]))
    assert abs((a == b).mean() - 2000 / 3000) < 0.15
    assert Counter(a.tolist()).most_common(1)[0][1] == 1


def test_extra_columns_pass(docs):
    assert set(docs.columns) <= set(line_dedup.dedup_lines(docs).columns)
    assert exact_dedup.drop_copies(docs).where(F.col("doc_id") == 103).count() == 1
