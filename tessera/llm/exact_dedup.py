"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted.  Each such normalised text is cut where its own
content says so (a punctuation mark before a letter of the first half of the
alphabet or any character beyond ASCII), so a chunk keeps its borders wherever
it stands.  A chunk moves once, to the group of its SHA-256 digest, where its
text is compared with all others of that digest: only when no digest has two texts
are digests identifiers.  Documents are compared by their ordered lists of
identifiers, a fraction of their size, so long documents don't move again.

Defined cases: null text counts as empty; all empty texts are equal; rows equal
in ``doc_id`` and text are one document, repeated, and share a verdict; a null
``doc_id`` comes before all others; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keep_named, row_keys, stored

#: Least and most characters of a chunk.
CHUNK = (256, 4096)
SPACES = " \t\n\x0b\x0c\r"


def chunk_pattern(least: int, most: int) -> str:
    """Lazily up to the first border behind ``least`` characters, else ``most``, else the rest."""
    border = r"(?<=\p{Po})(?=[A-Ma-m\x{80}-\x{10FFFF}])"
    return rf"(?s).{{{least},{most - 1}}}?{border}|.{{1,{most}}}"


def exact_groups(docs: DataFrame, chunk: tuple[int, int] = CHUNK) -> DataFrame:
    """One row per document row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``_k1, _k2``.

    The row with the most code points in its original text stays, then the
    smallest ``doc_id``.  ``_k1, _k2`` name the document by id and original text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = F.lit(chunk_pattern(*chunk))
    pieces = docs.select("doc_id", *row_keys(), F.char_length(text).alias("chars"), F.translate(text, SPACES, "").alias("plain"))
    cut = pieces.select("doc_id", "_k1", "_k2", "chars", F.sha2("plain", 256).alias("text_sha256"), F.regexp_extract_all("plain", pattern, F.lit(0)).alias("chunks"))
    chunks = cut.select(F.explode("chunks").alias("chunk")).select("chunk", F.unhex(F.sha2("chunk", 256)).alias("digest"))
    if not chunks.groupBy("digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").isEmpty():
        raise RuntimeError("two chunks share a SHA-256 digest")
    # every digest is now the identifier of one chunk: a recipe is made where its document lies
    recipe = F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256)))
    recipes = stored(cut.select("doc_id", "_k1", "_k2", "chars", "text_sha256", recipe.alias("recipe")), "recipes")
    groups = stored(
        recipes.groupBy("recipe")
        .agg(F.min(F.struct((-F.col("chars")).alias("c"), "doc_id", "_k1", "_k2")).alias("keep"), F.count("*").alias("group_size"))
        .select("recipe", "keep", "group_size"),
        "groups",
    )
    return recipes.join(groups, "recipe").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.struct("_k1", "_k2") == F.struct("keep._k1", "keep._k2")).alias("kept"),
        "text_sha256",
        "_k1",
        "_k2",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows equal in id and text, one."""
    return keep_named(docs, exact_groups(docs).where("kept"))
