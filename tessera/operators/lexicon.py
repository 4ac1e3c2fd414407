"""A stored inverted index: harvests add postings, queries read those of their terms.

Postings lie in buckets by term and carry their document's length, so a query is a read of its terms' buckets
and one aggregate; document frequencies are counts of the postings read.  The number of
documents and of tokens is kept as a sum a harvest.  A harvest moves what a document holds of each term, once
by document and once by term.  A document that is there already is not added again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.sources.store import Store, materialize


def term_counts(words: Column) -> Column:
    """``term, tf`` of each word of an array, in order; made inside the row, so nothing is shuffled."""
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  (x is computed once)
    run = lambda w, starts: F.transform(starts, lambda at, k: F.struct(w[at].alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(w)) - at).alias("tf")))
    first = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda at: (at == 0) | (w[at] != F.get(w, at - 1)))
    counted = bound(F.sort_array(words), lambda w: bound(first(w), lambda starts: run(w, starts)))
    return F.when(F.size(words) > 0, counted).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


class Index:
    def __init__(self, spark: SparkSession, path: str, key: T.DataType | None = None, buckets: int = 64):
        """``key``: the type of document ids, long if not given."""
        id_ = T.StructField("doc", key or T.LongType())
        n = lambda *names: [T.StructField(x, T.LongType()) for x in names]
        tables = {"postings": T.StructType([T.StructField("term", T.StringType()), id_, *n("tf", "dl")]), "docs": T.StructType([id_, *n("dl")]), "harvests": T.StructType(n("batch", "docs", "tokens"))}
        self.spark = spark
        self.store = Store(spark, path, tables, {"postings": ["term", "doc"], "docs": ["doc"], "harvests": ["batch"]}, buckets, {"postings": ["term"]})

    def add(self, docs: DataFrame, text: Column, key: str = "doc_id") -> int:
        """Add the documents whose id is not there yet; how many.  Of rows of one id, one is taken."""
        counted = docs.select(F.col(key).alias("doc"), X.tokens(text).alias("_w")).where("doc is not null").select("doc", F.size("_w").alias("dl"), term_counts(F.col("_w")).alias("_t"))
        # tokens hold no space, so a text's terms are one string; rows are numbered, to take the same one of an id at each reading
        given = materialize(counted.select("doc", "dl", F.array_join("_t.term", " ").alias("terms"), F.col("_t.tf").alias("tf"), F.monotonically_increasing_id().alias("row")))
        one = given.groupBy("doc").agg(F.min_by("dl", "row").alias("dl"), F.min("row").alias("row"))
        new = materialize(one.join(self.store.near("docs", given).select("doc").hint("merge"), "doc", "left_anti"))
        batch, n, tokens = new.agg(F.bit_xor(F.xxhash64("doc")), F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n:
            rows = given.where("dl > 0").join(new.select("doc", "row").hint("merge"), ["doc", "row"], "left_semi")
            self.store.append("postings", rows.select("doc", "dl", F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), "tf"))))
            # documents are named last: an add that was lost on the way is made again with the same effect
            self.store.upsert("harvests", self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(n).alias("docs"), F.lit(tokens).alias("tokens")))
            self.store.append("docs", new.select("doc", "dl"))
        return n

    def postings(self, query: str) -> DataFrame:
        """``term, doc, tf, dl`` of the query's terms, each with its ``df``."""
        terms = self.spark.range(1).select(F.explode(F.array_distinct(X.tokens(F.lit(query)))).alias("term"))
        found = self.store.near("postings", terms).join(F.broadcast(terms), "term", "left_semi").dropDuplicates(["term", "doc"])  # a row for each term of the query
        return found.join(F.broadcast(found.groupBy("term").agg(F.count("*").alias("df"))), "term")

    def bm25(self, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """``doc, bm25`` of the documents that hold a term of the query; all others score 0."""
        n, tokens = self.store.read("harvests").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        mean = max(tokens / n if n else 0.0, 1e-9)
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
        return self.postings(query).groupBy("doc").agg(F.sum(part).alias("bm25"))
