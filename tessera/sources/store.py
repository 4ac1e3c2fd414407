"""Keyed tables of hashed buckets, copied on write, each version a manifest that lists its files.

Files are never changed.  A write puts new files into a folder of its own and then names them in a
new manifest, whose appearance under its number is the commit: a lost job leaves the table as
it was, of two writers at once the second fails, and a reader keeps the files that it began with.  These stay
for two further versions; who reads longer takes a snapshot.
Parquet has no MERGE, so an upsert joins the new rows with the rows of the buckets that their
keys fall into, and only these buckets get new files.  A snapshot is a copy of manifests.
The driver holds file names, not rows: few bytes of compressed files may be many rows, so joins with what a
table holds are never broadcast."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, ``spark.checkpoint.dir``; on a local master a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to shared storage and read back, for results that must not change between uses."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class Store:
    #: Files of a bucket, or of a table without keys, beyond which the next write makes one of them.
    MANY = 32
    #: Newest versions whose files stay.
    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType] | None = None, keys: dict[str, list[str]] | None = None, buckets: int = 16, by: dict[str, list[str]] | None = None):
        """``buckets``: of tables made here, so many that one's rows suit a task; a table keeps the number that it was made with.
        ``by``: those of a table's keys that decide the bucket, where it is not all."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.tables, self.keys = tables or schemas.TABLES, keys or schemas.KEYS
        self.by = self.keys | (by or {})

    # -------------------------------------------------------------- files and manifests

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(p)

    def _listed(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _load(self, path: str) -> dict[str, Any]:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, path: str, content: dict[str, Any]) -> None:
        """A new file, whole at once; one of this name is an error."""
        sc = self.spark.sparkContext
        fs, draft = self._fs(f"{path}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(content), "utf-8"))
        stream.close()
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration())
        plain = sc._gateway.new_array(getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._fs(path)[1], plain)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(path) from e
            raise

    def versions(self, name: str) -> list[int]:
        return sorted(int(x[1:-5]) for x in self._listed(f"{self.path}/{name}/manifests") if x.endswith(".json"))

    def _manifest_path(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/manifests/v{version:08d}.json"

    def manifest(self, name: str) -> dict[str, Any]:
        """``version, buckets``, and ``files`` by bucket; those of no bucket under a blank."""
        found = self.versions(name)
        return self._load(self._manifest_path(name, found[-1])) if found else {"version": 0, "buckets": self.buckets, "files": {}}

    def _commit(self, name: str, old: dict[str, Any], files: dict[str, list[str]]) -> None:
        new = {"version": old["version"] + 1, "buckets": old["buckets"], "files": {k: v for k, v in files.items() if v}}
        self._put(self._manifest_path(name, new["version"]), new)
        self.vacuum(name)

    def vacuum(self, name: str) -> int:
        """Remove own files that neither one of the newest versions nor a snapshot names, and old manifests; how many files went."""
        old = self.versions(name)[: -self.KEPT]
        gone = self._let_go(name, [self._load(self._manifest_path(name, v)) for v in old]) if old else 0
        for v in old:
            self._delete(self._manifest_path(name, v))
        return gone

    def _let_go(self, name: str, manifests: list[dict[str, Any]]) -> int:
        """Remove the own files of manifests that no newest version and no snapshot names."""
        held = lambda ms: {f for m in ms for files in m["files"].values() for f in files}
        pins = [self._load(f"{self.path}/{name}/pins/{x}") for x in self._listed(f"{self.path}/{name}/pins") if x.endswith(".json")]
        keep = held([*(self._load(self._manifest_path(name, v)) for v in self.versions(name)[-self.KEPT :]), *pins])
        own = self._fs(f"{self.path}/{name}/data")[1].toString()
        gone = {f for f in held(manifests) - keep if f.startswith(own)}
        for f in gone:
            self._delete(f)
        return len(gone)

    def _delete(self, path: str, whole: bool = False) -> None:
        fs, p = self._fs(path)
        fs.delete(p, whole)

    # -------------------------------------------------------------- reads

    def _rows(self, name: str, files: list[str]) -> DataFrame:
        schema = self.tables[name]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """The rows as they are now: later writes don't change what this frame reads."""
        return self._rows(name, [f for files in self.manifest(name)["files"].values() for f in files])

    def get(self, name: str, *key: Any) -> Row | None:
        """The row of a key, from the files of its bucket alone."""
        names, now = self.keys[name], self.manifest(name)
        wanted = self.spark.createDataFrame([key], T.StructType([self.tables[name][k] for k in names]))
        (bucket,) = wanted.select(self._bucket(name, now["buckets"])).first()
        found = self._rows(name, now["files"].get(str(bucket), []))
        return found.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(names, key, strict=True)])).first()

    def near(self, name: str, wanted: DataFrame, now: dict[str, Any] | None = None) -> DataFrame:
        """The rows of the buckets that the rows of ``wanted`` fall into, by its columns of the table's names; no other file is read.

        ``now``: the manifest to read by, the newest if not given."""
        now, names = now or self.manifest(name), self.by[name]
        if not now["files"]:
            return self._rows(name, [])
        typed = wanted.select(*[F.col(k).cast(self.tables[name][k].dataType).alias(k) for k in names])
        buckets = sorted(r[0] for r in typed.select(self._bucket(name, now["buckets"])).distinct().collect())  # numbers of buckets
        return self._rows(name, [f for k in buckets for f in now["files"].get(str(k), [])])

    # -------------------------------------------------------------- writes

    def _bucket(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.by[name]), F.lit(n)).cast("int").alias("_bucket")

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.tables[name].fields])

    def _write(self, name: str, df: DataFrame, n: int) -> dict[str, list[str]]:
        """New files by bucket, one for each bucket that has rows; in the table's own layout where it has no keys."""
        where = f"{self.path}/{name}/data/{uuid.uuid4().hex}"
        if name in self.keys:
            df.withColumn("_bucket", self._bucket(name, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(where)
        else:
            df.write.parquet(where)
        fs, p = self._fs(where)
        files, out = fs.listFiles(p, True), {}
        while files.hasNext():
            f = files.next().getPath()
            if not f.getName().startswith(("_", ".")):
                folder = f.getParent().getName()
                out.setdefault(folder.removeprefix("_bucket=") if folder.startswith("_bucket=") else "", []).append(f.toString())
        return out

    def replace(self, name: str, df: DataFrame) -> None:
        """All rows anew."""
        old = self.manifest(name)
        self._commit(name, old, self._write(name, self._typed(name, df), old["buckets"]))

    def _touched(self, name: str, rows: DataFrame) -> tuple[dict[str, Any], DataFrame, list[str], DataFrame]:
        """The manifest, ``rows`` stored, the buckets of their keys, and the rows that these buckets hold."""
        now = self.manifest(name)
        rows = materialize(rows)
        buckets = sorted(str(r[0]) for r in rows.select(self._bucket(name, now["buckets"])).distinct().collect())  # numbers of buckets
        return now, rows, buckets, self._rows(name, [f for k in buckets for f in now["files"].get(k, [])])

    def _rewrite(self, name: str, now: dict[str, Any], buckets: list[str], df: DataFrame) -> None:
        if buckets:
            files = self._write(name, self._typed(name, df), now["buckets"])
            self._commit(name, now, {k: v for k, v in now["files"].items() if k not in buckets} | files)

    def upsert(self, name: str, rows: DataFrame, keep: tuple[str, ...] = ()) -> None:
        """Replace rows by key; the columns in ``keep`` hold their first value (``created_at``, say)."""
        now, rows, buckets, old = self._touched(name, self._typed(name, rows))
        self._rewrite(name, now, buckets, merged(old, rows, self.keys[name], keep))  # one of a key's rows is taken in the shuffle of the join

    def insert_new(self, name: str, rows: DataFrame) -> None:
        """Add rows whose key is not there yet; what is there stays where it lies."""
        keys = self.keys[name]
        _, rows, _, old = self._touched(name, self._typed(name, rows).dropDuplicates(keys))
        self.append(name, rows.join(old.select(*keys).hint("merge"), keys, "left_anti"))

    def append(self, name: str, rows: DataFrame, now: dict[str, Any] | None = None) -> int:
        """Add files; buckets that have many are written anew as one, with the new rows.  How many rows were added.

        ``rows`` are computed once and moved once, to their buckets.  ``now``: the manifest that they were chosen by, the newest if
        not given; if another writer has made a version since, this is a :class:`Conflict`."""
        now, rows = now or self.manifest(name), self._typed(name, rows)
        files = self._write(name, rows, now["buckets"])
        n = self._rows(name, [f for one in files.values() for f in one]).count()
        if not n:
            for f in [f for one in files.values() for f in one]:
                self._delete(f)
            return 0
        full = {k for k in files if len(now["files"].get(k, [])) >= self.MANY}
        spare = [f for k in full for f in files[k]]
        if full:
            whole = self._rows(name, [f for k in full for f in [*now["files"][k], *files[k]]])
            files |= self._write(name, whole.coalesce(1) if name not in self.keys else whole, now["buckets"])
        self._commit(name, now, now["files"] | {k: v if k in full else [*now["files"].get(k, []), *v] for k, v in files.items()})
        for f in spare:  # their rows are in the one file of the bucket
            self._delete(f)
        return n

    def set_status(self, keys: DataFrame, status: str) -> None:
        """Set the status of the papers in ``keys``; a key that is not there is an error."""
        now, keys, buckets, papers = self._touched("papers", keys.select("arxiv_id").distinct())
        missing = keys.join(papers.hint("merge"), "arxiv_id", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0][0])
        hit = keys.withColumn("hit", F.lit(True))
        self._rewrite("papers", now, buckets, papers.join(hit.hint("merge"), "arxiv_id", "left").withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status"))).drop("hit"))

    def put_state(self, key: str, value: str) -> None:
        self.upsert("state", self.spark.createDataFrame([(key, value)], schemas.STATE))

    def get_state(self, key: str) -> str | None:
        row = self.get("state", key)
        return row["value"] if row else None

    def log(self, event: str, detail: dict[str, Column | int | str], at: Column) -> None:
        one = self.spark.range(1).select(at.alias("at"), F.lit(event).alias("event"), F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in detail.items()])).alias("detail"))
        self.append("audit_log", one)

    # -------------------------------------------------------------- snapshots

    def snapshot(self, path: str) -> Store:
        """A store at ``path`` with the tables as they are now, of the same files; writes to either don't show in the other.

        This store keeps the files until :meth:`drop` of the snapshot."""
        other = Store(self.spark, path, self.tables, self.keys, self.buckets, self.by)
        for name in self.tables:
            now = self.manifest(name)
            pin = uuid.uuid4().hex
            self._put(f"{self.path}/{name}/pins/{pin}.json", now)
            other._put(f"{path}/{name}/pinned/{pin}", {"store": self.path, "pin": f"{self.path}/{name}/pins/{pin}.json"})
            other._commit(name, other.manifest(name) | {"buckets": now["buckets"]}, now["files"])
        return other

    def drop(self) -> None:
        """Remove this store, and the files that another kept for it alone."""
        for name in self.tables:
            for pin in [f"{self.path}/{name}/pinned/{x}" for x in self._listed(f"{self.path}/{name}/pinned")]:
                origin, file = (self._load(pin)[k] for k in ("store", "pin"))
                kept = self._load(file)
                self._delete(file)
                Store(self.spark, origin, self.tables, self.keys)._let_go(name, [kept])
        self._delete(self.path, True)


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``new`` by key, those of ``old`` that have none, and ``keep`` columns from ``old`` where it has them."""
    o, n = old.alias("o"), new.dropDuplicates(keys).withColumn("_new", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    both = o.join(n.hint("merge"), on, "full_outer")
    fresh = F.coalesce(F.col("n._new"), F.lit(False))

    def value(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in old.columns])
