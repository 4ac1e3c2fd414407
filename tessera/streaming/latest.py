"""Keyed streaming state: the newest version of each key, and what became of every delivery.

Each row of the stream is ``new``, ``updated``, ``repeated`` or ``late`` (older than the version that the key has),
decided by state that is kept by key and survives restarts; a micro-batch touches the state of its own keys
and nothing else.  A key's rows of one micro-batch are held together, so batches are bounded by their files.  State goes ``ttl`` after a key's last change, if one is given."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICTS = ("new", "updated", "repeated", "late")


class Latest(StatefulProcessor):
    """Verdicts on the rows of a key, oldest version first within a batch."""

    def __init__(self, key: str, version: str, ttl: int | None = None):
        self.key, self.version, self.ttl = key, version, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("version", T.LongType())])
        self.state = handle.getValueState("version", kind, self.ttl) if self.ttl else handle.getValueState("version", kind)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get()[0] if self.state.exists() else None
        before = held
        given = pd.concat(list(rows)).sort_values(self.version, kind="stable")
        verdicts = []
        for version in given[self.version].tolist():
            verdicts.append("new" if held is None else "updated" if version > held else "repeated" if version == held else "late")
            held = version if held is None else max(held, version)
        if held != before:
            self.state.update((int(held),))
        yield pd.DataFrame({"key": [key[0]] * len(given), "version": given[self.version].astype("int64"), "verdict": verdicts})

    def close(self) -> None:
        pass


def verdicts(rows: DataFrame, key: str, version: str, ttl: int | None = None) -> DataFrame:
    """``key, version, verdict`` of a stream; rows without key or version are left out.  Versions are longs, such as a time in microseconds."""
    given = rows.select(F.col(key).alias("key"), F.col(version).cast("long").alias("version")).where("key is not null and version is not null")
    schema = T.StructType([T.StructField("key", given.schema["key"].dataType), T.StructField("version", T.LongType()), T.StructField("verdict", T.StringType())])
    return given.groupBy("key").transformWithStateInPandas(Latest("key", "version", ttl), schema, "Append", "ProcessingTime" if ttl else "None")


def follow(spark: SparkSession, path: str, schema: T.StructType | str, key: str, version: str, out: str, checkpoint: str, ttl: int | None = None, files_per_batch: int = 1000) -> None:
    """Take the parquet files that came to ``path`` since the last run and add their verdicts to ``out``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = verdicts(stream, key, version, ttl).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
