"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators are space and the controls 0x09 to 0x0D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
GAP_PATTERN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet below the shared checkpoint folder and read again (columnar, pruned, with statistics)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_stored(table: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is run inside; then it is as it was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def lean(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Shuffle files go as soon as the step that wrote them has stored its result."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        with configured(docs.sparkSession, CLEANUP, "true"):
            return f(docs, *args, **options)

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP_PATTERN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
