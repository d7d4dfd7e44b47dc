"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever one is counted: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a new local one, but only where
    driver and executors are one machine: a cluster would lose what is written there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, survives lost executors.
    The shuffle files of the write go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path, was = new_path(spark, tag), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing will read again."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """64-bit content key of a text; null and empty texts share one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two non-null columns that name a row by what it holds, so any rescan finds the same key.

    Rows equal in id and text share it; what the operators derive from a row depends on
    just these, so such rows get the same result, and each keeps its own output row."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("k1"), text_key(text).alias("k2")]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``most`` bytes of ``column``, one row at least.

    Each run is a copy that begins at offset 0: ``ascii_lower`` of Arrow gives wrong offsets for slices of large strings."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
