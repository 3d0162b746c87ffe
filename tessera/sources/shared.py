"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of a batch that is sent to Python: rows of long texts or lists would otherwise fill a worker by the ten thousand.
BATCH_BYTES = "4m"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile send batches of BATCH_BYTES to Python."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(limit, before)


#: For rows of megabytes: Parquet looks at a page's and a row group's (compressed) size after a hundred rows only, but a task holds a row
#: group at once, as stored and decoded, whether it writes or reads.
WIDE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, name: str = "table", wide: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and survives lost executors. wide: its rows
    take megabytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At its end all tables that materialize() wrote meanwhile are deleted, but those put into the list."""
    before, kept = len(_MADE), []
    yield kept
    stay = {file.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in kept for file in df.inputFiles()[:1]}
    for path in _MADE[before:]:
        if path.rsplit("/", 1)[-1] not in stay:
            _delete(spark, path)
    _MADE[before:] = [x for x in _MADE[before:] if x.rsplit("/", 1)[-1] in stay]


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores before it as make it differ from all columns of the tables."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
