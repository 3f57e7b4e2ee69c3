"""Typed Parquet scans, written intermediates and versioned snapshots.

Intermediates that must not be recomputed (assigned ids, range-sorted parts) are written to the
shared folder named by ``spark.checkpoint.dir``, so that they survive the loss of an executor.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@functools.cache
def _single_machine_root() -> str:
    return tempfile.mkdtemp(prefix="lumencat-")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only in single-machine runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _single_machine_root()
    return root.rstrip("/") + "/lumencat"


_FRESH: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _FRESH.append(path)
    return path


@contextlib.contextmanager
def intermediates() -> Iterator[list[str]]:
    """The fresh paths that the block hands out, for ``remove`` once nothing reads them any more."""
    made: list[str] = []
    before = len(_FRESH)
    yield made
    made += _FRESH[before:]


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete folders that this application wrote under its shared root."""
    root = shared_root(spark)
    for path in paths:
        if not path.startswith(f"{root}/"):
            raise ValueError(f"{path} is not under {root}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run in the block leaves no shuffle files behind, rather than until the driver's next collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if given is None else spark.conf.set(name, given)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and fixes non-repeatable columns.

    Shuffle files of the write go with it, so that of many steps only the written rows stay on disk.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: typed scan; the declared schema saves the footer pass and prunes to known columns."""
    return spark.read.schema(schema).parquet(path)


def scan_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None,
) -> DataFrame:
    """A1 as a stream: new Parquet files of ``path``, which may also be a single file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a glob, the path may name a file; without one it must be a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a scan of few splits out to all cores, ahead of heavy work per row.

    Only a table of less than one split per core is moved; larger ones are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append(df: DataFrame, path: str) -> None:
    """A2 sink: add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder``, none where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in store.listStatus(path)] if store.exists(path) else []


class SnapshotTable:
    """A table kept as numbered Parquet versions, and a log that says which folder each version is.

    Every commit writes a folder of its own and then a whole new log, so a reader goes on with the
    folder it resolved, also while a repeated commit gives its version new rows. A log names the
    newest ``keep`` versions; logs that were replaced long ago are removed, and so are the folders
    that no log names any more. One writer at a time.
    """

    _ENTRY = T.StructType([
        T.StructField("version", T.LongType()), T.StructField("path", T.StringType()),
    ])
    _OLD_LOGS = 8

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keep: int = 64):
        self.spark, self.root, self.schema, self.keep = spark, root.rstrip("/"), schema, keep

    def _logs(self) -> list[str]:
        """Complete logs, oldest first."""
        names = sorted(children(self.spark, f"{self.root}/log"))
        while names and "_SUCCESS" not in children(self.spark, f"{self.root}/log/{names[-1]}"):
            names.pop()
        return names

    def _entries(self) -> dict[int, str]:
        """The folder of each version; at most ``keep`` of them."""
        logs = self._logs()
        if not logs:
            return {}
        rows = self.spark.read.schema(self._ENTRY).parquet(f"{self.root}/log/{logs[-1]}").collect()
        return {r["version"]: r["path"] for r in rows}

    def current_version(self, before: int | None = None) -> int | None:
        """The newest committed version, or the newest one older than ``before``."""
        return max((v for v in self._entries() if before is None or v < before), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of ``version`` (default: the newest); no rows while nothing is committed."""
        entries = self._entries()
        version = max(entries, default=None) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        if version not in entries:
            raise ValueError(f"{self.root} has no version {version}")
        return self.spark.read.schema(self.schema).parquet(entries[version])

    def commit(self, df: DataFrame, version: int | None = None) -> int:
        """Write ``df`` as ``version`` (default: next) and publish it; a known version gets new rows."""
        entries = self._entries()
        if version is None:
            version = max(entries, default=-1) + 1
        path = f"{self.root}/v{version}-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(path)
        entries[version] = path
        kept = sorted(entries.items())[-self.keep:]
        names = children(self.spark, f"{self.root}/log")
        log = f"{self.root}/log/{int(max(names, default='-1')) + 1:012d}"
        self.spark.createDataFrame(kept, self._ENTRY).coalesce(1).write.parquet(log)
        self._expire()
        return version

    def _expire(self) -> None:
        """Remove old logs, and the folders that only they named."""
        logs = self._logs()
        old, live = logs[:-self._OLD_LOGS], logs[-self._OLD_LOGS:]
        if not old:
            return

        def named(names: list[str]) -> set[str]:
            rows = self.spark.read.schema(self._ENTRY).parquet(*[f"{self.root}/log/{n}" for n in names])
            return {r["path"] for r in rows.select("path").distinct().collect()}

        for path in sorted(named(old) - named(live)) + [f"{self.root}/log/{n}" for n in old]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
