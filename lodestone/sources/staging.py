"""Tables that a query writes for itself and reads more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``). A local folder serves only a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files when they end: nothing reads them again."""
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, was)


def staged(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written to a :func:`scratch` path and read back: worked out once, whatever reads them, and there after
    an executor is lost. :func:`dropped` deletes it."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, tag)
    with shuffles_dropped(spark):
        rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.staged_at = path
    return out


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`staged` wrote and nothing will read again."""
    for rows in tables:
        if path := getattr(rows, "staged_at", None):
            fs, at = file_system(rows.sparkSession, path)
            fs.delete(at, True)


def settled(rows: DataFrame, tag: str, *spent: DataFrame) -> DataFrame:
    """``rows`` written, after which the tables it was made of can go."""
    out = staged(rows, tag)
    dropped(*spent)
    return out


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly, where Spark would read them in fewer tasks than it has cores: the texts of one small file are one task's work
    otherwise. Splits are of bounded size, so what is dealt is, too; tables of more splits are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
