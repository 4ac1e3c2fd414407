"""What a task or the driver holds at once, and borders between the operators and the SQL."""

import re
from datetime import datetime
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import joins, models, recorded
from tessera.plans import registry, standin
from tessera.sources import html
from tessera.sources.store import merged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_with_a_table_are_not_broadcast(spark):
    a, b = (spark.range(n).select(F.col("id").cast("string").alias("arxiv_id"), F.lit("x").alias("title")) for n in (20, 30))
    assert "Broadcast" in plan(a.join(b, "arxiv_id"))
    for df in (merged(a, b, ["arxiv_id"]), joins.new_rows(b, a)):
        assert "Broadcast" not in plan(df)
    assert merged(a, b, ["arxiv_id"]).count() == 30 and joins.new_rows(b, a).count() == 10


def test_foundational_at_the_border_is_as_in_the_sql(spark, monkeypatch):
    at = lambda day, hour=0: datetime(1997, 5, day, hour)
    rows = [(1, 150, 0, at(31)), (2, 150, 20, at(31)), (3, 150, 0, at(30, 23)), (4, 99, 30, at(1)), (5, 150, 20, None), (6, None, None, None), (7, 150, 0, at(31, 1))]
    df = spark.createDataFrame(rows, "doc_id long, citations int, influential int, published timestamp")
    monkeypatch.setattr(registry, "papers", lambda *_: df)
    got = {r["doc_id"]: r["foundational"] for r in registry._items(spark, "").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False}


def test_embedding_holds_few_tokens_at_once():
    whole = pa.RecordBatch.from_pydict({"tokens": [["a"] * 30, None, ["b"] * 250, [], ["c"] * 90, ["d"] * 10, ["e"]] + [["f"]] * 9})
    parts = list(V._slices(whole, "tokens", 100, 8))
    assert pa.Table.from_batches(parts).to_pydict() == whole.to_pydict()
    sizes = [(p.num_rows, sum(len(x or ()) for x in p.column("tokens").to_pylist())) for p in parts]
    assert all(rows <= 8 and (n <= 100 or rows == 1) for rows, n in sizes)
    known = V._Buckets(256)
    for k in range(120_000):
        known.word(f"{k:06d}")
    assert len(known.words) == 100_000 and sum(map(len, known.words.values())) < 4_000_000


def test_a_task_keeps_no_prompts(spark):
    reqs = spark.range(600).repartition(1).select(F.col("id").cast("string").alias("key"), F.lit(recorded.JUDGEMENT).alias("schema"), F.lit("ask").alias("prompt"))

    def make():
        mock = models.Mock()
        mock.answers[recorded.JUDGEMENT] = lambda _: {"is_relevant": True, "score": float(len(mock.calls)), "rationale": ""}
        return mock

    most = models.answers(reqs, make).agg(F.max(F.get_json_object("payload", "$.score").cast("double")), F.count("*")).first()
    assert most[0] <= 256 and most[1] == 600


def test_pages_are_parsed_a_few_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"id": list(range(300))})
    parts = list(html._few(iter([batch, batch])))
    assert max(p.num_rows for p in parts) == 64 and pa.Table.from_batches(parts).column("id").to_pylist() == 2 * list(range(300))
    df = spark.range(300).repartition(1).select("id", F.concat(F.lit("<h1>t</h1>"), F.col("id").cast("string")).alias("html"))
    assert {r["sections"][0]["text"] for r in html.sections(df, "html").collect()} == {str(k) for k in range(300)}


def test_hash_tokens_split_a_text_once(spark):
    texts = ["", None, "a", "ab", "abc", "To be, or not to BE: ab abcd x1 y", "xyz a", "a xyz", "é9 ##", "aa bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", X.hash_tokens("text").alias("t"))

    def plain_tokens(text):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return w + [f"{a}_{b}" for a, b in pairwise(w)] + [f"c:{f'#{x}#'[k : k + 3]}" for x in w if len(x) > 2 for k in range(len(x))]

    assert {r["id"]: r["t"] for r in df.collect()} == {k: plain_tokens(t) for k, t in enumerate(texts)}
    told = registry.queries()["txt_hash_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("regexp_extract_all") == 1


def test_orders_of_papers_are_dealt_to_all_partitions(spark, tmp_path):
    """However few bytes their ids take; joined by bytes, one task would sort them all."""
    n, threshold = int(spark.conf.get("spark.sql.shuffle.partitions")), "spark.sql.autoBroadcastJoinThreshold"
    ids = spark.range(3000)
    for name, columns in {
        "documents": ["id AS doc_id", "'a' AS text", "'en' AS lang", "'s' AS source"],
        "orders": ["id AS o_orderkey", "timestamp '1998-01-01' AS o_orderdate"],
        "lineitem": ["id AS l_orderkey", "id AS l_partkey", "1.0d AS l_quantity", "'R' AS l_returnflag"],
    }.items():
        ids.selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set(threshold, "-1")
    try:
        for columns in (["doc_id", "published"], ["doc_id", "published", "citations"]):
            rows = standin.papers(spark, str(tmp_path)).select(*columns).rdd
            sizes = rows.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
            assert len(sizes) == n and sum(sizes) == 3000 and max(sizes) < 2 * 3000 / n
    finally:
        spark.conf.unset(threshold)
