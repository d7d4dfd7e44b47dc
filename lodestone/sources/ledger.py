"""Tables that grow by batches, several of them at once.

A batch writes its rows of each table into a folder of its own, and counts from the moment its entry stands in the
manifest, all tables together. A batch that stopped half-way has no entry, so nobody reads its files, and its next attempt writes over
them; one that is run again after it was committed does nothing. Readers take the batches of the manifest they saw.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.staging import file_system, shuffles_dropped


class Ledger:
    """Batches below ``path``; ``schemas`` has the columns of each table, ``parted`` a column whose values are folders in each batch.

    A base stands for all batches up to a number and replaces them: it is a batch of its own (numbered -1 - that number, so that
    no later batch can have its number), and from its entry on readers leave out what it replaces."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], parted: dict[str, str] | None = None):
        self.spark, self.path, self.schemas, self.parted = spark, path.rstrip("/"), schemas, parted or {}

    def _entry(self, batch: int) -> str:
        return f"{self.path}/_manifest/{batch}.json"

    def _committed(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def batches(self) -> list[int]:
        """Batches that count: the last base, if any, and all after it."""
        found = self._committed()
        base = max((-1 - b for b in found if b < 0), default=None)
        return [b for b in found if b >= 0] if base is None else [-1 - base, *(b for b in found if b > base)]

    def done(self, batch: int) -> bool:
        """Whether a batch was committed, as itself or in a base."""
        return any(b == batch or b < 0 and -1 - b >= batch for b in self._committed())

    def notes(self) -> DataFrame:
        """(batch, note): what each batch that counts left in the manifest, as JSON."""
        entries = [self._entry(b) for b in self.batches()]
        if not entries:
            return self.spark.createDataFrame([], "batch long, note string")
        rows = self.spark.read.text(entries, wholetext=True)
        return rows.select(F.get_json_object("value", "$.batch").cast("long").alias("batch"), F.get_json_object("value", "$.note").alias("note"))

    def folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def write(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        """Write a batch's rows of a table, over what an attempt that failed left; they don't count before :meth:`commit`. Gives them back as written."""
        out = rows.select(*[f.split()[0] for f in self.schemas[table].split(", ")]).write.mode("overwrite").option("compression", "zstd")
        with shuffles_dropped(self.spark):
            (out.partitionBy(self.parted[table]) if table in self.parted else out).parquet(self.folder(table, batch))
        return self._read(table, [batch]).drop("batch")

    def commit(self, batch: int, note: dict) -> bool:
        """Make a batch count: its entry is written elsewhere and renamed into the manifest. False if the entry was there already."""
        fs, final = file_system(self.spark, self._entry(batch))
        part = file_system(self.spark, f"{self.path}/_started/{batch}-{uuid.uuid4().hex}")[1]
        fs.mkdirs(final.getParent())
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps({"batch": batch, "note": note}).encode()))
        stream.close()
        return not fs.exists(final) and fs.rename(part, final)

    def _read(self, table: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{self.schemas[table]}, batch long")
        rows = self.spark.read.schema(f"{self.schemas[table]}, batch long").option("basePath", f"{self.path}/{table}")
        return rows.parquet(*[self.folder(table, b) for b in batches])

    def read(self, table: str) -> DataFrame:
        """Rows of all batches that count, with the batch."""
        return self._read(table, self.batches())

    def sweep(self) -> None:
        """Delete what a base has replaced: files first, then entries (the base's own entry already hides them)."""
        fs, _ = file_system(self.spark, self.path)
        live = set(self.batches())
        for b in self._committed():
            if b not in live:
                for table in self.schemas:
                    fs.delete(file_system(self.spark, self.folder(table, b))[1], True)
                if b < 0:  # entries of replaced batches stay under the base: they say what was done
                    fs.delete(file_system(self.spark, self._entry(b))[1], False)
