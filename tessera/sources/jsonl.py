"""Line files of requests and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``key, payload``: of one key's lines the last, by time of writing and place in the file; malformed lines are left out.

    Files of one append, which are of one time, go by name."""
    lines = spark.read.text(path).select(F.from_json("value", "key string, payload variant").alias("j"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("n"))
    kept = lines.select("j.key", F.to_json("j.payload").alias("payload"), F.struct("t", "f", "o", "n").alias("at")).where("key is not null")
    return kept.groupBy("key").agg(F.max_by("payload", "at").alias("payload"))


def write_requests(requests: DataFrame, path: str) -> None:
    requests.select("key", "schema", "prompt").write.mode("overwrite").json(path)


def clear_requests(spark: SparkSession, path: str) -> None:
    """Requests that were answered and applied go."""
    write_requests(spark.createDataFrame([], "key string, schema string, prompt string"), path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, schema string, prompt string").json(path)


def append_answers(answers: DataFrame, path: str) -> None:
    """``payload`` is JSON text and is written as an object."""
    answers.select(*schemas.ANSWERS.names).select("key", F.parse_json("payload").alias("payload")).write.mode("append").json(path)
