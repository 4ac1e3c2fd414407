"""Levels and order of dependency graphs against plain versions."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph


def plain_order(ids, edges):
    ids = list(dict.fromkeys(ids))
    at = {x: k for k, x in enumerate(ids)}
    needs = {x: {d for s, d in edges if s == x and d in at and d != x} for x in ids}
    ready, out = [at[x] for x in ids if not needs[x]], []
    heapq.heapify(ready)
    while ready:
        x = ids[heapq.heappop(ready)]
        out.append(x)
        for y in ids:
            if x in needs[y]:
                needs[y].remove(x)
                if not needs[y]:
                    heapq.heappush(ready, at[y])
    return out, [x for x in ids if needs[x]]


def plain_levels(ids, edges):
    order, rest = plain_order(ids, edges)
    level = dict.fromkeys(rest)
    for x in order:
        level[x] = 1 + max((level[d] for s, d in edges if s == x and d in level and d != x), default=-1)
    return level


def made(seed, n, per, cycles):
    rng = random.Random(seed)
    order = rng.sample(range(n), n)
    edges = [(order[k], order[rng.randrange(k)]) for k in range(1, n) for _ in range(rng.randint(0, per))]
    edges += [(a, b) for a, b in zip(order[: n // 3], order[1 : n // 3], strict=False) if rng.random() < 0.7 for a, b in [(b, a)]]  # runs
    edges += [(order[i], order[j]) for _ in range(cycles) for i, j in [sorted(rng.sample(range(n), 2))]]
    return edges + [(1, 1), (0, 10**6), (10**6, 0)] + edges[:5]


@pytest.mark.parametrize(("seed", "n", "per", "cycles"), [(1, 40, 3, 0), (4, 40, 1, 4)])
def test_random_graphs(spark, seed, n, per, cycles):
    edges = made(seed, n, per, cycles)
    ids = random.Random(seed + 9).sample(range(n), n)
    ids += ids[:4]
    nodes = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "id long, position long")
    links = spark.createDataFrame(edges, "src long, dst long")
    assert dict(graph.topological_levels(nodes.select("id"), links).collect()) == plain_levels(ids, edges)
    got = [r["id"] for r in graph.topological_order(nodes, links).orderBy("place").collect()]
    assert got == [x for part in plain_order(ids, edges) for x in part]


@pytest.fixture
def rounds(monkeypatch):
    seen = []

    def noting(df):
        seen.append(1)
        return real(df)

    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", noting)
    return seen


def test_long_chain(spark, rounds):
    n = 100_000
    ids = spark.range(n)
    edges = ids.where("id > 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    levels = graph.topological_levels(ids, edges)
    assert levels.where("level = id").count() == n
    assert len(rounds) < 22  # the given rows, a table a round, one in sixteen for the settled, the result


def test_long_ring_and_its_tail(spark, rounds):
    n = 1000
    ids = spark.range(2 * n)
    edges = ids.select(F.col("id").alias("src"), F.when(F.col("id") == 0, n - 1).otherwise(F.col("id") - 1).alias("dst"))
    assert graph.topological_levels(ids, edges).where("level is null").count() == 2 * n
    assert len(rounds) < 20


@pytest.mark.parametrize("cycles", [0, 3])
def test_what_nothing_points_to_takes_no_round(spark, monkeypatch, cycles):
    """A small deep core under many nodes, and more on top of these."""
    rng = random.Random(7)
    core = made(3, 30, 2, cycles)
    edges = core + [(k, rng.randrange(30)) for k in range(30, 400) for _ in range(3)] + [(k, rng.randrange(30, 400)) for k in range(400, 2500) for _ in range(2)]
    given = []
    real = graph.propagate
    monkeypatch.setattr(graph, "propagate", lambda rows, most: given.append(rows.where("dst is not null").count()) or real(rows, most))
    nodes = spark.range(2600)
    got = dict(graph.topological_levels(nodes, spark.createDataFrame(edges, "src long, dst long")).collect())
    core_ids = list(range(30))
    want = plain_levels(core_ids, [e for e in core if e[1] < 30])
    points = {}
    for s, d in edges:
        if s >= 30 and d < 2600:
            points.setdefault(s, set()).add(d)
    for k in range(30, 2600):
        below = [want[d] for d in points.get(k, ())]
        want[k] = None if None in below else 1 + max(below, default=-1)
    assert got == want and given[0] <= len(core)


def test_nothing(spark):
    none = spark.createDataFrame([], "id string, position long")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert graph.topological_levels(none.select("id"), edges).count() == 0 and graph.topological_order(none, edges).count() == 0


@pytest.mark.parametrize("cycles", [0, 3])
def test_the_order_takes_one_propagation(spark, monkeypatch, cycles):
    """Positions that fall along runs, and nodes on top of these that nothing points to."""
    rng = random.Random(11)
    core = [(k, k - 1) for k in range(1, 30)] + [(k, rng.randrange(k)) for k in range(1, 60) for _ in range(2)] + [(k, rng.randrange(60)) for k in range(cycles)]
    edges = core + [(k, rng.randrange(60)) for k in range(60, 300) for _ in range(2)] + [(k, rng.randrange(60, 300)) for k in range(300, 900)] + [(5, 5), (7, 5000)]
    ids = [*range(59, -1, -1)]  # what builds on others comes first
    for k in range(60, 920):
        ids.insert(rng.randrange(len(ids) + 1), k)
    called = []
    real = graph.propagate
    monkeypatch.setattr(graph, "propagate", lambda rows, most: called.append(1) or real(rows, most))
    nodes = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "id long, position long")
    got = [r["id"] for r in graph.topological_order(nodes, spark.createDataFrame(edges, "src long, dst long")).orderBy("place").collect()]
    assert got == [x for part in plain_order(ids, edges) for x in part]
    assert len(called) == 1
