"""A cache of vectors by key, stored so that asking for keys doesn't shuffle it.

Rows are bucketed and sorted by key. A probe brings the wanted keys, each once, to the buckets; the cached side is read where it
lies. A key that was put again is taken at its latest put: which of a bucket's rows that is needs no exchange either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.staging import dropped, scratch, staged


class KeyedCache:
    """The table ``name`` at ``path`` (key, vector, put), made where it isn't there yet. As many buckets as the session has shuffle partitions,
    64 at least, so that neither side is dealt anew."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"cache_{uuid.uuid4().hex}"
        self.path = path or scratch(spark, self.name)
        self.buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], "key string, vector array<double>, put long"))

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).format("parquet").saveAsTable(self.name)

    def put_many(self, rows: DataFrame, put: int) -> None:
        """Add (key, vector) rows as put number ``put``: greater numbers replace smaller ones. A key that a put holds twice keeps its
        smallest vector; rows without a key are left out."""
        one = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vector").alias("vector"))
        self._append(one.repartition(self.buckets, "key").withColumn("put", F.lit(put).cast("long")))

    def rows(self) -> DataFrame:
        """(key, vector): the latest of each key."""
        return self.spark.table(self.name).groupBy("key").agg(F.max_by("vector", "put").alias("vector"))

    def probe(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (key, others) with ``vector`` and ``found``. Wanted keys meet the cache once each, however often they are asked for."""
        known = wanted.select("key").where("key IS NOT NULL").distinct().hint("shuffle_merge").join(self.rows().withColumn("found", F.lit(True)), "key")
        return wanted.join(known, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def filled(self, wanted: DataFrame, embed, put: int) -> DataFrame:
        """``wanted`` (key, text) with vectors: those that aren't cached are worked out by ``embed`` ((key, text) to (key, vector)), each text once, and put."""
        got = staged(self.probe(wanted), "probed")
        missing = got.where(~F.col("found")).groupBy("key").agg(F.min("text").alias("text"))
        made = staged(embed(missing), "made")
        self.put_many(made, put)
        rest = made.select("key", F.col("vector").alias("made_"))
        out = staged(got.join(rest, "key", "left").withColumn("vector", F.coalesce("vector", "made_")).drop("made_"), "filled")
        dropped(got, made)
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
