"""Incremental harvest: new files in, papers upserted once, a cursor that moves last.

A file stream with ``availableNow`` takes what is new since its checkpoint; each
batch is deduplicated against itself and the store, so a batch that runs twice has
the effect of one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.operators import filters
from tessera.operators.joins import new_rows
from tessera.sources.store import Store, materialize

CURSOR = "last_harvest"


def cursor_of(state: str | None) -> datetime | None:
    """The cursor's time; a value without a zone is in UTC."""
    if not state:
        return None
    at = datetime.fromisoformat(state)
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def _micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def take(store: Store, batch: DataFrame, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, stored: bool = False) -> int:
    """Add the batch's unknown papers, not older than the cursor, as SEEN; then move the cursor.

    ``stored``: the batch is read from files that stay as they are, so it need not be written for its further uses.
    Papers are added to their buckets; what is there is not moved."""
    batch = batch if stored else materialize(batch)
    last = cursor_of(store.get_state(CURSOR))
    since = F.timestamp_micros(F.lit(_micros(last))) if last else F.lit(None).cast("timestamp")
    now = store.manifest("papers")
    fresh = prepare(new_rows(batch.where(filters.since(F.col("published"), since)), store.near("papers", batch, now)))  # the buckets of the batch's ids alone
    fresh = fresh.withColumn("status", F.lit(schemas.SEEN))
    missing = [f for f in schemas.PAPERS.fields if f.name not in fresh.columns]
    fresh = fresh.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    n = store.append("papers", fresh.dropDuplicates(["arxiv_id"]), now)  # the rows lie by key already, unless prepare moves them
    newest = batch.agg(F.unix_micros(F.max("published"))).first()[0]
    if newest is not None and (last is None or newest > _micros(last)):
        store.put_state(CURSOR, (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=newest)).isoformat(" "))
    return n


def run(spark: SparkSession, store: Store, path: str, schema: StructType | str, checkpoint: str, read: Callable[[DataFrame], DataFrame] = lambda x: x, files_per_batch: int = 1000) -> None:
    """Harvest the parquet files that came to ``path`` since the last run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = read(stream).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: take(store, df) and None).start()
    query.awaitTermination()


def distinct_events(spark: SparkSession, path: str, schema: StructType | str, out: str, checkpoint: str, key: str = "event_id", at: str = "ts", late: str = "1 day") -> None:
    """A stream of rows written once each, whatever the number of their deliveries within ``late``."""
    stream = spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

