"""The shortlist by bounded heads against a ranking of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rank


def plain(rows, n, alpha, k):
    d = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[3] is None, -(r[3] or 0), r[0])))}
    x = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    fused = sorted((-(alpha / (k + d[i] + 1) + (1 - alpha) / (k + x[i] + 1)), i) for i in d)
    return [i for _, i in fused[:n]]


@pytest.mark.parametrize(("size", "n", "alpha", "k", "seed"), [(900, 20, 0.8, 60, 1), (700, 60, 0.5, 10, 2), (300, 7, 0.1, 1, 3), (12, 60, 0.8, 60, 4), (0, 5, 0.8, 60, 5)])
def test_fused_shortlist(spark, size, n, alpha, k, seed):
    rng = random.Random(seed)
    rows = [(f"p{i}", round(rng.random(), 1), rng.choice([0.0, 0.0, round(rng.random(), 2)]), rng.choice([None, rng.randrange(5)])) for i in range(size)]
    df = spark.createDataFrame(rows, "id string, sim double, bm double, at long").withColumn("at", F.timestamp_seconds("at"))
    got = rank.fused_shortlist(df, rank.ascending("sim", "at", "id"), [-F.col("bm"), F.col("id")], "id", n, alpha, k)
    assert [r["id"] for r in got.orderBy("place").collect()] == plain(rows, n, alpha, k)


def test_reach_is_bounded():
    for n in (1, 60, 1000):
        for alpha in (0.1, 0.5, 0.8, 1.0):
            m = rank.reach(n, alpha, 60)
            assert n <= m <= 2 * (60 + n) and 1 / (60 + m + 1) <= max(alpha, 1 - alpha) / (60 + n) + 1e-12
