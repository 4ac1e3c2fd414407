"""The feed as a stream and a batch source, and the delivery of whole files."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources import delivery, feed


def page(path, entries):
    at = lambda m: (datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=m)).isoformat().replace("+00:00", "Z")
    body = "".join(f'<entry><id>http://arxiv.org/abs/{i}v1</id><published>{at(m)}</published><title>{i}</title><summary>s</summary><author><name>A</name></author><category term="{c}"/><category term="cs.X"/></entry>' for i, m, c in entries)
    path.write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')


@pytest.fixture
def recorded(spark, tmp_path):
    feed.register(spark)
    (tmp_path / "feed").mkdir()
    page(tmp_path / "feed" / "1.xml", [("a", 1, "cs.LG"), ("b", 2, "cs.CV"), ("c", 3, "cs.LG")])
    return tmp_path


def titles(df):
    return sorted(r["title"] for r in df.select("title").collect())


def test_stream_goes_on_from_its_offset(spark, recorded):
    def go():
        rows = spark.readStream.format("preprint_feed").option("feed", str(recorded / "feed")).load()
        q = rows.writeStream.format("parquet").option("path", str(recorded / "out")).option("checkpointLocation", str(recorded / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return titles(spark.read.parquet(str(recorded / "out")))

    assert go() == ["a", "b", "c"]
    assert go() == ["a", "b", "c"]  # nothing new: nothing again
    # a page that repeats old entries and brings another of the newest time, and newer ones
    page(recorded / "feed" / "2.xml", [("c", 3, "cs.LG"), ("d", 3, "cs.LG"), ("e", 9, "cs.CV"), ("a", 1, "cs.LG")])
    assert go() == ["a", "b", "c", "d", "e"]
    page(recorded / "feed" / "3.xml", [("f", 9, "cs.LG"), ("g", 12, "cs.LG")])
    assert go() == ["a", "b", "c", "d", "e", "f", "g"]


def test_batch_with_pushed_filters(spark, recorded):
    rows = spark.read.format("preprint_feed").option("feed", str(recorded / "feed")).load()
    assert titles(rows) == ["a", "b", "c"]
    since = rows.where("published >= '2026-01-01T00:02:00Z'")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    both = since.where(F.col("category").isin("cs.LG", "cs.XX"))
    for df, want in ((since, ["b", "c"]), (both, ["c"])):
        assert titles(df) == want and "Filter (" not in plan(df)  # the source took them: none is left to Spark
    assert "Filter (" in plan(both.where("title = 'c'"))
    assert titles(rows.where("published > '2026-01-01T00:02:00Z' and category = 'cs.CV'")) == []
    assert titles(rows.where("title = 'b' and category = 'cs.CV'")) == ["b"]
    only = spark.read.format("preprint_feed").option("feed", str(recorded / "feed")).option("categories", "cs.CV").option("since", "2026-01-01").load()
    assert titles(only) == ["b"]


def test_offsets():
    class Fixed(feed.Feed):
        def _rows(self, since, categories, most):
            for i, when in (("x", "2026-01-02T00:00:00Z"), ("y", "2026-01-02T00:00:00Z"), ("z", "2026-01-01T00:00:00Z"), ("?", None)):
                yield (i, None, when, i, "", [], None, None, None, [])

    s = feed._Stream(Fixed({}))
    assert s.latestOffset() == {"at": "2026-01-02T00:00:00+00:00", "ids": "x y"}
    got = lambda start: [r[0] for p in s.partitions(start, s.latestOffset()) for r in s.read(p)]
    assert got(s.initialOffset()) == ["x", "y", "z"] and got({"at": "2026-01-02T00:00:00Z", "ids": "x"}) == ["y"] and got(s.latestOffset()) == []


# ------------------------------------------------------------------ delivery


def test_a_delivery_is_whole_or_the_old_one(spark, tmp_path):
    path = tmp_path / "out.md"
    lines = spark.range(500).select((499 - F.col("id")).alias("place"), F.concat(F.lit("é line "), (499 - F.col("id")).cast("string")).alias("line")).repartition(7)
    delivery.deliver(lines, path)
    want = "".join(f"é line {k}\n" for k in range(500))
    assert path.read_text() == want
    bad = lines.withColumn("line", F.when(F.col("place") == 250, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        delivery.deliver(bad, path)
    assert path.read_text() == want and os.listdir(tmp_path) == ["out.md"]
    delivery.deliver(lines.limit(0), path)
    assert path.read_text() == ""
    delivery.deliver_text(spark, "a\n\nb\n", path)
    assert path.read_text() == "a\n\nb\n"


def test_a_task_that_is_tried_again(tmp_path):
    w = delivery._Writer(str(tmp_path / "f"))
    row = lambda p, t: {"place": p, "line": t}
    lost = w.write(iter([row(1, "lost")]))  # the first try of a task, whose message never came
    second, first = w.write(iter([row(5, "b")])), w.write(iter([row(1, "a")]))
    w.commit([second, None, first, w.write(iter([]))])
    assert (tmp_path / "f").read_text() == "a\nb\n" and not os.path.exists(lost.path) and os.listdir(tmp_path) == ["f"]
