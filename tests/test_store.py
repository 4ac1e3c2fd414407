"""Bucketed tables: what a write touches, what a reader sees, snapshots, and what is left of the lost and the old."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.sources.store import Conflict, Store

TABLE = schemas.table("k string, v int")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), {"t": TABLE, "audit_log": schemas.AUDIT, "state": schemas.STATE}, {"t": ["k"], "state": ["key"]}, buckets=8)


def rows(spark, ids, v=0):
    return spark.createDataFrame([(f"k{i}", v) for i in ids], "k string, v int")


def held(store, name="t"):
    return {f for files in store.manifest(name)["files"].values() for f in files}


def on_disk(store, name="t"):
    return {f"file:{f}" for f in glob.glob(f"{store.path}/{name}/data/**/*.parquet", recursive=True)}


def values(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_an_upsert_rewrites_its_buckets_only(spark, store):
    store.upsert("t", rows(spark, range(200)))
    before = store.manifest("t")["files"]
    assert len(before) == 8 and all(len(f) == 1 for f in before.values())
    store.upsert("t", rows(spark, [3, 500], 7))
    after = store.manifest("t")["files"]
    new = rows(spark, [3, 500]).select(store._bucket("t", 8)).distinct().collect()
    assert {k for k in after if after[k] != before[k]} == {str(r[0]) for r in new} and len(held(store) - {f for x in before.values() for f in x}) == len(new)
    assert values(store.read("t")) == {f"k{i}": 7 if i == 3 else 0 for i in range(200)} | {"k500": 7}
    store.insert_new("t", rows(spark, [3, 4, 900, 900], 8))
    assert values(store.read("t"))["k3"] == 7 and values(store.read("t"))["k900"] == 8 and store.read("t").count() == 202
    store.insert_new("t", rows(spark, [3, 4], 9))  # nothing new: no version
    assert store.manifest("t")["version"] == 3
    store.upsert("t", rows(spark, []))
    assert store.manifest("t")["version"] == 3


def test_readers_keep_what_they_opened(spark, store):
    store.upsert("t", rows(spark, range(20)))
    opened = store.read("t")
    store.append("t", rows(spark, range(20, 30)))
    store.upsert("t", rows(spark, [1], 5))
    assert opened.count() == 20 and opened.where("v = 5").count() == 0 and store.read("t").count() == 30


def test_old_files_go(spark, store):
    for v in range(5):
        store.upsert("t", rows(spark, range(50), v))
    assert store.versions("t") == [4, 5] and len(on_disk(store)) == 16 and held(store) <= on_disk(store)


def test_snapshot_copies_nothing(spark, store, tmp_path):
    store.upsert("t", rows(spark, range(50)))
    files = on_disk(store)
    other = store.snapshot(str(tmp_path / "other"))
    assert held(other) == held(store) and not on_disk(other)
    other.upsert("t", rows(spark, [1], 5))
    for v in range(1, 5):
        store.upsert("t", rows(spark, range(50), v))
    assert values(other.read("t")) == {f"k{i}": 5 if i == 1 else 0 for i in range(50)} and values(store.read("t"))["k1"] == 4
    assert files <= on_disk(store)  # pinned
    for v in range(4):
        other.upsert("t", rows(spark, range(50), v))  # does not remove files of the first store
    assert files <= on_disk(store)
    other.drop()
    store.upsert("t", rows(spark, range(50), 9))
    assert not os.path.exists(tmp_path / "other") and not files & on_disk(store) and len(on_disk(store)) == 16


def test_a_lost_write_leaves_the_table(spark, store):
    store.upsert("t", rows(spark, range(5)))
    bad = rows(spark, [1]).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.upsert("t", bad)
    with pytest.raises(Exception, match="lost"):
        store.replace("t", bad)
    assert values(store.read("t")) == {f"k{i}": 0 for i in range(5)} and store.versions("t") == [1]


def test_two_writers(spark, store):
    store.upsert("t", rows(spark, range(5)))
    now = store.manifest("t")
    store.upsert("t", rows(spark, [1], 1))
    with pytest.raises(Conflict):
        store._rewrite("t", now, ["0"], rows(spark, [2], 2))
    assert values(store.read("t"))["k1"] == 1 and values(store.read("t"))["k2"] == 0
    assert not glob.glob(f"{store.path}/t/manifests/*.draft")


def test_point_reads(spark, store):
    store.upsert("t", rows(spark, range(50)))
    assert store.get("t", "k7")["v"] == 0 and store.get("t", "none") is None and store.get("state", "x") is None
    store.put_state("x", "1")
    store.put_state("x", "2")
    assert store.get_state("x") == "2"


def test_many_small_appends_become_one_file(spark, store, monkeypatch):
    monkeypatch.setattr(Store, "MANY", 3)
    for k in range(6):
        store.log("e", {"n": k}, F.lit("2026-01-01").cast("timestamp"))
    assert store.read("audit_log").count() == 6 and len(held(store, "audit_log")) <= 4
    kept = {f for v in store.versions("audit_log") for files in store._load(store._manifest_path("audit_log", v))["files"].values() for f in files}
    assert on_disk(store, "audit_log") == kept
