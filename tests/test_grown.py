"""What grows by harvests: the stored index, components; and many patterns in one pass."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph, lexicon, patterns, rank
from tessera.sources import store
from tessera.streaming import harvest


def scores(df, key):
    return {r[key]: round(r["bm25"], 9) for r in df.collect() if r["bm25"]}


def test_index_after_harvests_is_that_of_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(0, 40)))) for k in range(200)] + [(200, None), (201, "W3 w3, w3!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = lexicon.Index(spark, str(tmp_path / "i"), buckets=32)
    assert index.bm25("w1").count() == 0
    assert index.add(df.where("doc_id < 90"), F.col("text")) == 90
    assert index.add(df.where("doc_id >= 60"), F.col("text")) == 112  # thirty of them again
    assert index.add(df, F.col("text")) == 0
    for query in ("w1 w7 W3 none w1", "w250", "none", ""):
        assert scores(index.bm25(query), "doc") == scores(rank.bm25(df, F.col("text"), query), "doc_id")
    read = index.store.near("postings", spark.createDataFrame([("w1",), ("w7",)], "term string")).inputFiles()
    every = [f for files in index.store.manifest("postings")["files"].values() for f in files]
    assert 0 < len(read) <= 4 < len(every)  # two buckets of two harvests


def test_index_add_that_was_lost_on_the_way(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "a c c")], "doc_id long, text string")
    index = lexicon.Index(spark, str(tmp_path / "i"), buckets=4)
    real = index.store.append

    def lost(name, rows):
        if name == "docs":
            raise OSError("lost")
        real(name, rows)

    monkeypatch.setattr(index.store, "append", lost)
    with pytest.raises(OSError):
        index.add(df, F.col("text"))
    monkeypatch.setattr(index.store, "append", real)
    assert index.add(df, F.col("text")) == 2
    assert scores(index.bm25("a c"), "doc") == scores(rank.bm25(df, F.col("text"), "a c"), "doc_id")


# ------------------------------------------------------------------ patterns


@pytest.mark.parametrize("part", [1 << 20, 60])
def test_patterns(spark, part):
    rng = random.Random(2)
    made = lambda n: "".join(rng.choice("ab -c1.") for _ in range(n))
    texts = [(k, made(rng.randint(0, 60))) for k in range(120)] + [(200, None), (201, "")]
    told = sorted({made(rng.randint(1, 4)).strip() or "a" for _ in range(60)}) + ["", "a", "a", "b-rep"]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in told], "pattern string")
    want = {(k, p) for k, t in texts for p in told if p and t and p in t}
    assert sorted(map(tuple, patterns.occurrences(df, "id", F.col("t"), asked, part=part).collect())) == sorted(want)
    terms = [t for t in dict.fromkeys(told) if re.fullmatch("[a-z0-9]+", t)]
    got = patterns.occurrences(df, "id", X.normalize("t"), asked.where(F.col("pattern").isin(terms)), bordered=True, part=part)
    want = {(r["id"], t) for r in df.select("id", X.matched_terms(X.normalize("t"), terms).alias("m")).collect() for t in r["m"]}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert patterns.occurrences(df, "id", F.col("t"), asked.limit(0)).count() == 0


def test_first_matches(spark):
    texts = spark.createDataFrame([(3, "The  first\npart", 1), (1, "some other first PART", 2), (2, "none", 0)], "id long, t string, at int")
    quotes = spark.createDataFrame([("q1", "First part"), ("q2", "first   part "), ("q3", "absent"), ("q4", "  "), ("q5", None), ("q6", "OTHER")], "q string, quote string")
    got = lambda **kw: {r["q"]: (r["id"], r["n"]) for r in patterns.first_matches(texts, "id", F.col("t"), quotes, "q", F.col("quote"), **kw).collect()}
    assert got() == {"q1": (1, 2), "q2": (1, 2), "q6": (1, 1)}
    assert got(order="at", part=10) == {"q1": (3, 2), "q2": (3, 2), "q6": (1, 1)}


# ------------------------------------------------------------------ components


def test_components_grow(spark, tmp_path):
    rng = random.Random(3)
    grown = graph.Components(spark, str(tmp_path / "c"), buckets=8)
    edges: list[tuple[int, int]] = []
    for batch in range(4):
        new = [tuple(rng.sample(range(batch * 20, 60 + batch * 30), 2)) for _ in range(25)] + [(5, 5)] + edges[:3]
        edges += new
        before = dict(grown.store.manifest("nodes")["files"])
        grown.add(spark.createDataFrame(new, "a long, b long"))
        full = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert dict(grown.read().collect()) == dict(full.collect())
        after = grown.store.manifest("nodes")["files"]
        assert all(after[k][: len(v)] == v for k, v in before.items())  # what is known is never rewritten
    some = spark.createDataFrame([(edges[0][0],), (10**6,)], "node long")
    assert [r["node"] for r in grown.roots(some).collect()] == [edges[0][0]]


def test_untouched_components_stay(spark, tmp_path):
    grown = graph.Components(spark, str(tmp_path / "c"), buckets=64)
    add = lambda *e: grown.add(spark.createDataFrame(list(e), "a long, b long"))
    add(*[(2 * k, 2 * k + 1) for k in range(100)])
    assert add((0, 2)) == 1
    assert sum(len(v) for v in grown.store.manifest("moved")["files"].values()) == 1  # one component moved: one bucket written
    assert add((0, 3), (1, 2)) == 0 and add((3, 10)) == 1
    assert {r["root"] for r in grown.read().where("node in (0, 1, 2, 3, 10, 11)").collect()} == {0}
    assert grown.read().where("node <> root").count() == 100 + 2


# ------------------------------------------------------------------ what a harvest moves


def test_terms_are_counted_inside_the_row(spark):
    texts = [(1, "b a b c a b"), (2, ""), (3, None), (4, "x")]
    df = spark.createDataFrame(texts, "id long, text string").select("id", lexicon.term_counts(X.tokens("text")).alias("t"))
    assert {r["id"]: [tuple(x) for x in r["t"]] for r in df.collect()} == {1: [("a", 2), ("b", 3), ("c", 1)], 2: [], 3: [], 4: [("x", 1)]}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_an_add_keeps_no_words_twice(spark, tmp_path, monkeypatch):
    """What is stored on the way holds each term of a document once, and postings are computed once."""
    kept = []
    real = store.materialize

    def noting(df):
        out = real(df)
        kept.append(out)
        return out

    monkeypatch.setattr(lexicon, "materialize", noting)
    monkeypatch.setattr(store, "materialize", noting)
    df = spark.createDataFrame([(1, "abcdef " * 500), (2, "abcdef"), (2, "abcdef"), (None, "x")], "doc_id long, text string")
    index = lexicon.Index(spark, str(tmp_path / "i"), buckets=4)
    assert index.add(df, F.col("text")) == 2
    held = [str(r).count("abcdef") for out in kept for r in out.collect()]
    assert max(held) == 1 and sum(held) == 3
    assert {(r["doc"], r["tf"], r["dl"]) for r in index.postings("abcdef").collect()} == {(1, 500, 500), (2, 1, 1)}


def test_a_harvest_leaves_what_is_there(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "s"), buckets=2)
    made = lambda ids, day: spark.createDataFrame([(str(k), datetime(2024, 1, day)) for k in ids], "arxiv_id string, published timestamp")
    held = lambda: {f for files in own.manifest("papers")["files"].values() for f in files}
    assert harvest.take(own, made(range(10), 1)) == 10
    before = held()
    assert harvest.take(own, made([*range(5, 15), 14], 2)) == 5
    assert before < held()  # the papers of the first harvest were not written again
    assert harvest.take(own, made(range(15), 2)) == 0 and own.read("papers").count() == 15 and own.read("papers").select("arxiv_id").distinct().count() == 15


def test_one_paper_for_an_id_that_enrichment_repeats(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "s"), buckets=2)
    one = spark.createDataFrame([("1", datetime(2024, 1, 1))], "arxiv_id string, published timestamp")
    assert harvest.take(own, one, lambda df: df.unionByName(df)) == 1 and own.read("papers").count() == 1


def test_a_writer_in_between_is_a_conflict(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "s"), buckets=2)
    one = spark.createDataFrame([("1", datetime(2024, 1, 1))], "arxiv_id string, published timestamp")

    def prepare(df):
        harvest.take(store.Store(spark, str(tmp_path / "s")), one)
        return df

    with pytest.raises(store.Conflict):
        harvest.take(own, one, prepare)
    assert own.read("papers").count() == 1
