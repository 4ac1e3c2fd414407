"""The join of similar titles against all pairs."""

import difflib
import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import graph, titles

plain = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))


def plain_pairs(rows, threshold):
    rows = [(i, plain(t), {" ".join(a.lower().split()) for a in who or [] if a} - {""}) for i, t, who in rows if i is not None]
    out = set()
    for a, t, x in rows:
        for b, u, y in rows:
            if a < b and t and u and t.split()[0] == u.split()[0] and x & y and difflib.SequenceMatcher(None, t, u).ratio() >= threshold:
                out.add((a, b))
    return out


def made(seed, n, first=("the", "a", "on", "x1"), most=12):
    """Titles that are changed letter by letter, word by word and in length, with equal ones, under few authors."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlcmx7") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out)[1])
            for _ in range(rng.randint(0, max(1, len(t) // 8))):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 2)] = rng.choice(["", "e", "Q", " ", "an", "-"])
            t = "".join(t)
        else:
            t = " ".join([rng.choice(first), *(rng.choice(words) for _ in range(rng.randint(0, most)))])
        out.append((k, t, rng.sample(["Ann B", "ann  b", "C D", "É F", "", "G"], rng.randint(0, 3))))
    return out + [(n, None, ["C D"]), (n + 1, "", ["C D"]), (n + 2, "?!", ["C D"]), (None, out[0][1], ["C D"]), (n + 3, out[0][1], None), (n + 4, "a", ["C D"]), (n + 5, "A ", ["c d", None])]


@pytest.mark.parametrize(("threshold", "block", "seed"), [(0.9, 3, 2), (0.8, 2048, 3), (0.6, 2, 4)])
def test_pairs_and_groups(spark, threshold, block, seed):
    rows = made(seed, 220)
    df = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>").repartition(3)
    want = plain_pairs(rows, threshold)
    assert {tuple(r) for r in titles.fuzzy_pairs(df, threshold, "doc_id", block).collect()} == want and len(want) > 20
    edges = titles.fuzzy_edges(df, threshold, "doc_id", block)
    assert {tuple(r) for r in edges.collect()} <= want
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for pair in want for x in pair}
    assert dict(graph.components(edges).collect()) == {x: root[x] for x in linked}


def test_copies_cost_no_pairs(spark):
    """A thousand equal titles, and one that is similar: about as many edges as papers."""
    df = spark.createDataFrame([(k, "The same long title of all of them", ["A"]) for k in range(1000)] + [(1000, "The same long title of all of then", ["A"])], "doc_id long, title string, authors array<string>")
    edges = titles.fuzzy_edges(df, 0.9, "doc_id")
    assert edges.count() == 1000 and {r["root"] for r in graph.components(edges).collect()} == {0}


def test_ratio_of_one_compares_no_titles(spark, monkeypatch):
    """Only equal titles have it, so unlike ones of a first word never meet."""
    rows = made(5, 220)
    df = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>")
    monkeypatch.setattr(titles, "candidates", lambda *_: pytest.fail("titles were compared"))
    want, root = plain_pairs(rows, 1.0), {}
    for a, b in sorted(want):
        root.setdefault(a, a)
        root[b] = min(root.get(b, b), root[a])
    for _ in rows:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(graph.components(titles.fuzzy_edges(df, 1.0, "doc_id")).collect()) == root and len(root) > 20


def test_common_letters_are_the_longest_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        x, y = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(2))
        y = x[: rng.randint(0, len(x))] + y
        best = [0] * (len(y) + 1)
        for a in x:
            row = [0]
            for k, b in enumerate(y):
                row.append(best[k] + 1 if a == b else max(row[k], best[k + 1]))
            best = row
        known = titles._Title(x, 1, 1.0)
        assert known.common(y, best[-1]) and not known.common(y, best[-1] + 0.5)


def test_titles_meet_once_by_letters(spark):
    """Titles of like runs and unlike letters never reach the comparison, and a pair of two authors reaches it once."""
    rows = [(k, f"the model of {'abcdefghij'[k % 10] * 12} and graphs", ["A", "B"]) for k in range(200)] + [(200, "the model of aaaaaaaaaaab and graphs", ["A", "B"])]
    df = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>")
    _, groups = titles.title_groups(df, "doc_id")
    met = titles.candidates(groups, 0.9)
    assert met.count() == 2 and met.select("x", "y").distinct().count() == 1  # the last title and the first, under either author
    assert titles.fuzzy_edges(df, 0.9, "doc_id").count() == 191


def test_no_titles(spark):
    df = spark.createDataFrame([], "doc_id long, title string, authors array<string>")
    assert titles.fuzzy_pairs(df, 0.9, "doc_id").count() == 0 and titles.fuzzy_edges(df, 0.9, "doc_id").count() == 0
    with pytest.raises(ValueError):
        titles.fuzzy_edges(df, 0.0, "doc_id")


def test_hot_block_is_thinned(spark):
    """Unlike titles of one first word and author: few of all pairs meet."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows = [(k, "the " + " ".join(rng.sample(words, 6)), ["A"]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>")
    _, groups = titles.title_groups(df, "doc_id")
    assert titles.candidates(groups, 0.9).count() < 0.3 * 400 * 399 / 2


@settings(max_examples=500, deadline=None)
@given(st.text("ab c1", min_size=1, max_size=60), st.data(), st.sampled_from([0.6, 0.75, 0.8, 0.9, 0.95, 1.0]))
def test_bound_holds(a, data, t):
    """Titles of the ratio keep a run of the stated number of their rarest, in any order of runs."""
    b = list(a)
    for _ in range(data.draw(st.integers(0, 8))):
        at = data.draw(st.integers(0, len(b)))
        b[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "a", "b", "c", " "]))
    a, b = plain(a), plain("".join(b))
    if not a or not b or difflib.SequenceMatcher(None, a, b).ratio() < t:
        return
    q, short = titles.run_length(t)
    if min(len(a), len(b)) < short:
        q = 1
        assert max(len(a), len(b)) < short * (2 - t) / t + 1
    salt = data.draw(st.integers(0, 5))
    rare = lambda s: sorted({s[k : k + q] for k in range(len(s) - q + 1)}, key=lambda g: hash((g, salt)))[: int(titles.slope(q, t) * len(s) + 1e-9) + 1]
    assert set(rare(a)) & set(rare(b))


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["abc ", "etaoin shrdlu", "eeeeeetttttaaaooo nnn xqzj"]), st.integers(1, 420), st.randoms(use_true_random=False), st.sampled_from([0.6, 0.9, 0.95, None]))
def test_settled_as_by_difflib(letters, n, rng, t):
    """Long titles too, of which difflib leaves out the frequent letters."""
    x = "".join(rng.choice(letters) for _ in range(n))
    y = list(x)
    for _ in range(rng.randint(0, n // 7 + 1)):
        at = rng.randrange(len(y) + 1)
        y[at : at + rng.randint(0, 2)] = rng.choice(["", rng.choice(letters)])
    y = "".join(y) or "a"
    ratio = difflib.SequenceMatcher(None, x, y).ratio()
    t = t or ratio or 0.5
    assert titles._Title(x).reaches(titles._Title(y), t) == (ratio >= t)


def test_pairs_of_copies_are_not_moved(spark):
    """Pairs are made where they are handed over: each comes once, under two authors and for papers whose id is repeated, and only pairs of such ids are compared."""
    rows = made(7, 120) + [(k, "The same long title of all of them", ["C D", "G"]) for k in range(500, 540)]
    rows += [(500, "the same long title of all of then", ["C D"]), (501, "The same long title of all of them", ["Ann B", "C D"]), (501, "The same long title of all of them", ["G", "c d"])]
    df = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>").repartition(3)
    pairs = titles.fuzzy_pairs(df, 0.9, "doc_id")
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_pairs(rows, 0.9)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Aggregate" not in plan.split("Generate")[0]


def test_linked_titles_are_not_compared(spark, monkeypatch):
    """Three hundred unlike titles that are all similar: about a link and a comparison each, no pairs."""
    rows = [(k, f"the long title of all of these many papers number {k:03d}", ["A"]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>")
    edges = titles.fuzzy_edges(df, 0.9, "doc_id")
    assert edges.count() == 299 and {r["root"] for r in graph.components(edges).collect()} == {0}
    compared, reaches = [], titles._Title.reaches
    monkeypatch.setattr(titles._Title, "reaches", lambda x, y, t: compared.append(1) or reaches(x, y, t))
    cell = pd.DataFrame([(0, 0, True, t, k, k, k, "a") for k, t, _ in rows], columns=["cell", "salt", "own", "t", "lo", "hi", "title", "author"])
    assert len(list(titles._links(iter([cell]), 0.9))) == 299 and len(compared) < 600
