"""Derived tables that are written once for each version of their input.

A table is kept below the shared checkpoint folder and known by its name and the
identity of the input's files: their paths, lengths and times of change.  The
two latest versions of each table stay; older ones are deleted.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEPT: dict[tuple[str, str], OrderedDict[str, tuple[str, object]]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all machines share; a local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialized(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written below the shared folder and read again: the same rows, ranges and all, for every reader.

    Shuffle files of the writing go as soon as the rows are stored.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def identity(source: DataFrame) -> str:
    """Tells versions of the files of a table apart.  One listing for each folder, whatever the number of files."""
    spark, found = source.sparkSession, []
    files = set(source.inputFiles())
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        path, system = _path(spark, folder)
        for s in system.listStatus(path):
            found.append(f"{s.getPath().toUri().getPath()}\t{s.getLen()}\t{s.getModificationTime()}\t{s.getPath().toString() in files}")
    return hashlib.sha256("\n".join(sorted([*found, *sorted(files)])).encode()).hexdigest()


def remembered(source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """``build(source)`` as a stored table, made anew only if the source's files changed.

    ``source`` has to read files; tables made in memory have no identity, and are built each time.
    """
    spark = source.sparkSession
    if not source.inputFiles():
        return build(source)
    kept = _KEPT.setdefault((spark.sparkContext.applicationId, name), OrderedDict())
    now = identity(source)
    if now in kept:
        path, schema = kept[now]
        there, system = _path(spark, path)
        if system.exists(there):
            kept.move_to_end(now)
            return spark.read.schema(schema).parquet(path)
        del kept[now]
    table = build(source)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    kept[now] = (path, table.schema)
    while len(kept) > most:
        old, system = _path(spark, kept.popitem(last=False)[1][0])
        system.delete(old, True)
    return spark.read.schema(table.schema).parquet(path)
