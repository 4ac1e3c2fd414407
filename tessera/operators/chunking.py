"""Word-bounded chunks of sectioned texts, without a loop over words.

A limitation section stands alone; between two of them, packing words greedily is
the same as cutting the joined words every ``max_tokens``.  A chunk is named after
the section that owns its first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.filters import is_limitation


def chunks(sections: DataFrame, key: str, max_tokens: int, max_chunks: int | None = None, patterns: tuple[str, ...] = (), order: str = "pos") -> DataFrame:
    """``key, chunk_index, text, section, page, n_words, is_limitation``, from rows ``key, pos, title, text, page``."""
    size = max(1, int(max_tokens))
    w = Window.partitionBy(key).orderBy(order)
    rows = sections.withColumns({"_words": X.words("text"), "_lim": is_limitation(F.col("title"), patterns)})
    # each limitation section is a run of its own; what lies between two of them is one run
    rows = rows.withColumn("_run", F.sum(F.col("_lim").cast("int")).over(w) * 2 - F.col("_lim").cast("int"))
    kept = rows.where((F.size("_words") > 0) | (F.col("_lim") & (F.coalesce(F.col("title"), F.lit("")) != "")))
    run = kept.groupBy(key, "_run").agg(
        F.max("_lim").alias("is_limitation"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("title").alias("title"), F.col("page").alias("page"), F.col("_words").alias("words")))).alias("parts"),
    )
    joined = run.withColumn("_all", F.flatten(F.transform("parts", lambda p: p["words"])))
    n = F.greatest(F.ceil(F.size("_all") / size).cast("int"), F.lit(1))
    owners = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i, F.greatest(F.size(p["words"]), F.lit(0)))))
    cut = joined.withColumn("_owner", owners).select(key, "_run", "is_limitation", "parts", "_owner", "_all", F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    owner = F.coalesce(F.get("_owner", F.col("_k") * size), F.lit(0))
    piece = F.slice("_all", F.col("_k") * size + 1, F.lit(size))
    out = cut.select(
        key, "_run", "_k", "is_limitation",
        F.array_join(piece, " ").alias("text"),
        F.nullif(F.coalesce(F.get("parts", owner)["title"], F.lit("")), F.lit("")).alias("section"),
        F.get("parts", owner)["page"].alias("page"),
        F.size(piece).cast("long").alias("n_words"),
    )
    if max_chunks is not None:
        out = truncated(out, key, max_chunks)
    at = F.row_number().over(Window.partitionBy(key).orderBy("_run", "_k"))
    return out.withColumn("chunk_index", (at - 1).cast("long")).drop("_run", "_k")


def truncated(chunk_rows: DataFrame, key: str, most: int) -> DataFrame:
    """All limitation chunks, and of the others the earliest that the budget leaves room for."""
    whole = Window.partitionBy(key)
    place = F.row_number().over(Window.partitionBy(key, "is_limitation").orderBy("_run", "_k"))
    lim = F.count_if(F.col("is_limitation")).over(whole)
    total = F.count("*").over(whole)
    marked = chunk_rows.withColumns({"_place": place, "_limited": lim, "_total": total})
    room = F.greatest(F.lit(0), F.lit(most) - F.col("_limited"))
    return marked.where((F.col("_total") <= most) | F.col("is_limitation") | (F.col("_place") <= room)).drop("_place", "_limited", "_total")


def split_words(words: Column, size: int) -> Column:
    n = F.ceil(F.size(words) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(words, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))
