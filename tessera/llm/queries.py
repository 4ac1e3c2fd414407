"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, exact_dedup, gif, importance, line_dedup, lm, mixing, near_dedup, packing, pivots, simhash, substring_dedup, toxicity


def public_tokenizer(name: str = packing.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_documents(spark, sf_dir).select("doc_id", "text"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d WHERE len(words) >= 13),
w AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY md5(array_to_string(words[pos:pos + 12], ' '))) AS least FROM n),
c AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(pos, pos + 13))))) AS gone FROM w WHERE least < doc_id GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed, words, gone FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM k),
g AS (SELECT doc_id, unnest(gone) AS pos FROM c),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.pos = g.pos
      WHERE g.pos IS NULL GROUP BY u.doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN t ON k.doc_id = t.doc_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_documents(spark, sf_dir).select("doc_id", "text", "source"), columns=("doc_id",))
    return plan.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_times")).alias("taken"),
        F.col("mix_times").alias("times"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
n AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM d WHERE len(lines) >= 3),
w AS (SELECT doc_id, pos, array_to_string(lines[pos:pos + 2], chr(10)) AS win FROM n),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nr FROM w
      WHERE regexp_matches(win, '[^ \\t\\n\\x0b\\x0c\\r]')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM k WHERE nr > 1),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizer())


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_column(gif.store_column(_documents(spark, sf_dir)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+', '', 'g') AS plain FROM documents),
g AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY plain) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.toxicity(docs, labels)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return pivots.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved)


OP11_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance.scored(_documents(spark, sf_dir).select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
v AS (SELECT DISTINCT word, hex(word) AS h FROM w),
b AS (SELECT word, list_transform(range(1, length(h), 2), lambda x: 16 * (position(h[x] IN '0123456789ABCDEF') - 1) + position(h[x + 1] IN '0123456789ABCDEF') - 1) AS bytes FROM v),
f AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM b, crc),
c AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM w JOIN f ON w.word = f.word GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM c, z),
m AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN f ON w.word = f.word JOIN g ON f.bucket = g.bucket WHERE side = 0 GROUP BY id),
h AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: position(substr(sha256('2024:' || doc_id), i, 1) IN '0123456789abcdef') - 1)), lambda x, y: 16 * x + y) AS h
      FROM documents LEFT JOIN m ON doc_id = id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM r
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.similar_groups(_documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_near_dedup": op4_near_dedup,
        "op5_mixing": op5_mixing,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_gif": op8_gif,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_importance": op12_importance,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op6_line_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance": OP12_SQL}
