"""A sink of one text file that is either the new one, whole, or the old one.

Tasks write their lines beside the file; when all have, the driver joins the parts by place and moves the
result over the old file in one step.  A failed job removes its parts and leaves the old file.  The
folder must be one that all machines have."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = Path(path)
        self.draft = self.path.parent / f".{self.path.name}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        self.draft.mkdir(parents=True, exist_ok=True)
        part, first, n = self.draft / uuid.uuid4().hex, 0, 0  # a task that is tried again has a file of its own
        with part.open("w", encoding="utf-8", newline="") as f:
            for row in rows:
                first = row["place"] if not n else first
                n += 1
                f.write(f"{row['line']}\n")
        return _Part(str(part), first, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.draft.mkdir(parents=True, exist_ok=True)
        whole = self.draft / "whole"
        with whole.open("wb") as out:
            for m in sorted((m for m in messages if m and m.lines), key=lambda m: m.first):
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, out)
        os.replace(whole, self.path)
        shutil.rmtree(self.draft)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.draft, ignore_errors=True)


class DeliverySink(DataSource):
    """``lines.write.format("delivery")``, of ``place long, line string``, in parts that are ordered by place."""

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def schema(self) -> str:
        return "place long, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def deliver(lines: DataFrame, path: str | Path) -> None:
    """Replace the file at ``path`` by ``lines`` (``place, line``) in the order of place."""
    lines.sparkSession.dataSource.register(DeliverySink)
    rows = lines.select(F.col("place").cast("long").alias("place"), F.coalesce("line", F.lit("")).alias("line")).orderBy("place")  # a range for each task
    rows.write.format("delivery").option("path", str(path)).mode("append").save()


def deliver_text(spark, text: str, path: str | Path) -> None:
    """The same of one text."""
    deliver(spark.createDataFrame(list(enumerate(text.removesuffix("\n").split("\n"))), "place long, line string"), path)
