"""Keyed streaming state over batches and restarts."""

from collections import Counter

from tessera.streaming import latest


def test_new_updated_repeated_late(spark, tmp_path):
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id string, v long"

    def go(*batches):
        for rows in batches:
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)
        latest.follow(spark, path, schema, "id", "v", out, cp, files_per_batch=1)
        return Counter((r["key"], r["version"], r["verdict"]) for r in spark.read.parquet(out).collect())

    got = go([("a", 2), ("b", 1), ("a", 1), ("a", 2), (None, 1), ("c", None)])
    want = Counter({("a", 1, "new"): 1, ("a", 2, "updated"): 1, ("a", 2, "repeated"): 1, ("b", 1, "new"): 1})
    assert got == want
    got = go([("a", 1), ("b", 5), ("d", 7)], [("b", 5), ("b", 4), ("d", 8)])  # after a restart
    want += Counter({("a", 1, "late"): 1, ("b", 5, "updated"): 1, ("d", 7, "new"): 1, ("b", 5, "repeated"): 1, ("b", 4, "late"): 1, ("d", 8, "updated"): 1})
    assert got == want
    assert go() == want
