"""Rankings: BM25, reciprocal rank fusion, shortlists and quota top-k.

A rank over all rows is made without bringing them into one task: rows are range
partitioned by the order, numbered inside partitions, and shifted by the sizes of
the partitions before, one number each."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as X
from tessera.operators import aggregates
from tessera.operators.filters import live
from tessera.sources.store import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, from 0 in the given order, which must be total for a fixed result."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dict(parts.groupBy("_part").count().collect())  # a number for each partition
    before = dict(zip(sorted(sizes), [0, *accumulate(sizes[k] for k in sorted(sizes))], strict=False))
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, (place - 1 + shift).cast("long")).drop("_part")


def dense_order(score: str, published: str | None, key: str) -> list[Column]:
    return [F.desc(score), *([F.desc_nulls_last(published)] if published else []), F.asc(key)]


def bm25(docs: DataFrame, text: Column, query: str, key: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``key, bm25`` of every document; one without a query term scores 0.

    Texts are split once, into what the query asks of them; only query terms are exploded, so what is shuffled is
    bounded by their occurrences."""
    spark = docs.sparkSession
    terms = sorted({t for t in spark.range(1).select(X.tokens(F.lit(query)).alias("t")).first()[0]})
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    split = docs.select(key, X.tokens(text).alias("_w"))
    kept = materialize(split.select(key, F.size("_w").alias("dl"), F.filter("_w", lambda t: F.array_contains(wanted, t)).alias("tokens")))
    n, avgdl = kept.agg(F.count("*"), F.avg("dl")).first()
    tf = kept.select(key, "dl", F.explode("tokens").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = aggregates.document_frequency(kept, key=key)
    idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / max(avgdl or 0.0, 1e-9)))
    scored = tf.join(F.broadcast(idf), "term").groupBy(key).agg(F.sum(part).alias("bm25"))  # idf: a row for each query term
    return kept.select(key).join(scored, key, "left").select(key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def fuse(ranks: DataFrame, dense: str, lexical: str, alpha: float = 0.8, k: int = 60) -> Column:
    """Reciprocal rank fusion of two ranks from 0."""
    return alpha / (k + F.col(dense) + 1) + (1 - alpha) / (k + F.col(lexical) + 1)


def reach(n: int, alpha: float, k: int) -> int:
    """How many rows from the head of both rankings hold the first ``n`` by fused rank.

    The first ``n`` of the heavier ranking have more than ``w / (k + n)`` each, ``w`` being its weight.  A row beyond
    place ``m`` in both has at most ``1 / (k + m + 1)``, which is no more once ``m + k + 1 >= (k + n) / w``."""
    return max(n, math.ceil((k + n) / max(alpha, 1 - alpha) - k - 1 + 1e-9))


def ascending(score: str, published: str | None, key: str) -> list[Column]:
    """The order of :func:`dense_order` as columns that all ascend."""
    dated = [F.col(published).isNull(), -F.unix_micros(published)] if published else []
    return [-F.col(score), *dated, F.col(key)]


def fused_shortlist(df: DataFrame, dense: list[Column], lexical: list[Column], key: str, n: int, alpha: float = 0.8, k: int = 60) -> DataFrame:
    """``key, place, fused``: the first ``n`` rows of ``df`` by reciprocal rank fusion, ties by ``key``, as if all were ranked.

    ``dense`` and ``lexical`` are total orders as lists of ascending columns.  No ranking is made of all rows.  The heads
    of both orders come from bounded heaps, and hold the shortlist (see :func:`reach`); their ranks in the other
    order are counts of the rows before them, from one pass that looks each row up among the heads.  What
    reaches the driver is bounded by the heads."""
    m = reach(n, alpha, k)
    both = {"_d": dense, "_l": lexical}
    rows = materialize(df.select(F.col(key).alias("_key"), *[F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]).alias(name) for name, order in both.items()]))
    heads = rows.orderBy("_d").limit(m).unionByName(rows.orderBy("_l").limit(m)).dropDuplicates(["_key"])
    heads = materialize(heads)
    marks = heads.agg(*[F.array_sort(F.collect_list(name)).alias(f"{name}s") for name in both])  # one row of 2 m marks at most
    # the number of marks that are not after a row: the row stands before all others
    met = lambda name: F.size(F.filter(f"{name}s", lambda x: x <= F.col(name)))
    placed = lambda x: x.join(F.broadcast(marks)).select("_key", met("_d").alias("_d"), met("_l").alias("_l"))
    seen = placed(rows).select(F.explode(F.array(F.struct(F.lit("_d").alias("order"), F.col("_d").alias("at")), F.struct(F.lit("_l").alias("order"), F.col("_l").alias("at")))).alias("x"))
    counts = {name: [0] * (2 * m + 2) for name in both}
    for order, at, c in seen.groupBy("x.order", "x.at").agg(F.count("*")).collect():
        counts[order][at] = c
    before = {name: [0, *accumulate(c)] for name, c in counts.items()}
    found = []
    for row in placed(heads).collect():  # a head's own mark is counted: its rank is that of the rows before the mark
        a, b = before["_d"][row["_d"]], before["_l"][row["_l"]]
        found.append((-(alpha / (k + a + 1) + (1 - alpha) / (k + b + 1)), row["_key"]))
    top = [(x, place, -score) for place, (score, x) in enumerate(sorted(found)[:n])]
    return df.sparkSession.createDataFrame(top, f"{key} {df.schema[key].dataType.simpleString()}, place long, fused double")


def shortlist(df: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows, and the rest; ``n`` bounds what is broadcast."""
    key = df.columns[0]
    first = materialize(df.orderBy(*order).limit(n).select(key))
    return df.join(F.broadcast(first), key, "left_semi"), df.join(F.broadcast(first), key, "left_anti")


def select_top(items: DataFrame, config: Config) -> DataFrame:
    """Up to ``top_n`` live items by score, the best foundational ones up to the reserved number among them."""
    top, reserved = config.delivery.top_n, max(0, min(config.scoring.foundational_reserved_slots, config.delivery.top_n))
    active = live(items)
    lane = active.where("foundational").orderBy(F.desc("score"), "id").limit(reserved).withColumn("_lane", F.lit(1))
    best = active.orderBy(F.desc("score"), "id").limit(top).withColumn("_lane", F.lit(0))
    both = lane.unionByName(best).groupBy("id").agg(F.max("_lane").alias("_lane"), *[F.first(c).alias(c) for c in items.columns if c != "id"])
    return both.orderBy(F.desc("_lane"), F.desc("score"), "id").limit(top).drop("_lane").select(*items.columns).orderBy(F.desc("score"), "id")


def plain_top(items: DataFrame, n: int) -> DataFrame:
    return live(items).orderBy(F.desc("score"), "id").limit(n)
