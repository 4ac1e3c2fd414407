"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

Lines end at ``\\n``.  Every three consecutive lines, one at least of which is not
blank, make a window, named by the MD5 of its text.  Where a window occurs more
than once in the corpus, the occurrence with the smallest (``doc_id``, text hash,
line number) stays and the lines of all others go; overlapping windows merge by
the lines they cover.  Windows are judged on the input, not on what is left.

A text is split once: what stays is the slices of its lines between the covered
ones, so the work is linear in the lines of a document.

Defined cases: null text counts as one empty line; a text of fewer than three
lines stays whole; rows equal in ``doc_id`` and text are one document and get
the same result; a null ``doc_id`` comes first; other columns pass unread, but for
``kept_text``, ``n_lines`` and ``n_removed``, which are replaced where they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored, with_columns

WINDOW = 3


def repeated_windows(docs: DataFrame) -> DataFrame:
    """First lines of later occurrences: ``doc_id, text_key, starts`` (an array), one row per document."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), lines.alias("lines")).where(F.size("lines") >= WINDOW)
    window = lambda i: F.slice("lines", i + 1, WINDOW)
    windows = (
        rows.select("doc_id", "text_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), lambda i: F.array_join(window(i), "\n"))).alias("pos", "window"))
        .where(F.col("window").rlike(r"[^\x20\x09-\x0D]"))
        .select(F.struct("doc_id", "text_key", "pos").alias("at"), F.unhex(F.md5("window")).alias("name"))
    )
    first = stored(windows.groupBy("name").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("name", "first"), "windows")
    return windows.join(first, "name").where("at <> first").groupBy("at.doc_id", "at.text_key").agg(F.array_sort(F.collect_set("at.pos")).alias("starts"))


def uncovered(lines: Column, starts: Column) -> Column:
    """The lines outside all windows that begin at ``starts``, which is sorted."""
    begin = F.concat(F.array(F.lit(-WINDOW)), starts)
    end = F.concat(starts, F.array(F.size(lines)))
    between = F.zip_with(begin, end, lambda a, b: F.slice(lines, a + WINDOW + 1, F.greatest(F.lit(0), b - a - WINDOW)))
    return F.flatten(between)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_removed`` added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = repeated_windows(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "starts")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("key"), text.alias("said"))
    joined = rows.join(marks, rows["id"].eqNullSafe(marks["_id"]) & (rows["key"] == marks["_key"]), "left")
    # one array of one array of lines, so that the lambda's variable holds lines split once
    kept = lambda starts: F.get(F.transform(F.array(F.split("said", "\n")), lambda lines: F.struct(F.size(lines).alias("n"), uncovered(lines, starts).alias("kept"))), F.lit(0))
    done = joined.select("row", "said", "starts", kept(F.coalesce("starts", F.array().cast("array<int>"))).alias("cut"))
    return with_columns(
        done,
        docs.columns,
        kept_text=F.when(F.col("starts").isNull(), F.col("said")).otherwise(F.array_join("cut.kept", "\n")),
        n_lines=F.col("cut.n").cast("long"),
        n_removed=(F.col("cut.n") - F.size("cut.kept")).cast("long"),
    )
