"""Sources and sinks: corpus folders, labelled CSV, result JSON, keyed tables, configurations."""

from __future__ import annotations

import copy
import hashlib
import json
import traceback
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.ledger import Ledger
from lodestone.sources.staging import dropped, staged

#: The column of a record that could not be read.
BAD = "_corrupt_record"
LABEL_COLUMNS = ("id", "document_id", "query", "expected_answer", "evidence_text")


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, content) of all .md, .txt and .markdown files below a folder; id is the file's name. No such file is
    an error. Rows come in no order: sort by ``source`` where one is needed."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("source"))
    raw = raw.where(F.lower("source").rlike(r"\.(md|txt|markdown)$"))
    if raw.select("source").isEmpty():
        raise FileNotFoundError(f"no document below {path}")
    return raw.select(F.element_at(F.split("source", "/"), -1).alias("id"), "source", F.col("value").alias("content"))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """Ids that several documents have."""
    return docs.groupBy("id").count().where("count > 1")


def scan_labels(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Labelled questions from CSV: needed columns are checked, rows without an id dropped, fields but the evidence trimmed.

    Rows that don't fit the header (too many or too few fields) are left out; with ``quarantine`` they are kept there as they
    stand, with the file they came from, and :func:`quarantined` counts them."""
    source = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    columns = source.csv(path).columns
    if missing := sorted(set(LABEL_COLUMNS) - set(columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    shape = ", ".join(f"`{c}` string" for c in [*columns, BAD])
    rows = source.schema(shape).option("columnNameOfCorruptRecord", BAD).csv(path).withColumn("file_", F.col("_metadata.file_path"))
    if quarantine:
        rows = _set_aside(rows, quarantine)
    rows = rows.where(F.col(BAD).isNull())
    kind = tx.strip(F.col("query_type")) if "query_type" in columns else F.lit(None).cast("string")
    trimmed = rows.select(*[tx.strip(F.col(c)).alias(c) for c in LABEL_COLUMNS if c != "evidence_text"], "evidence_text", F.coalesce(F.nullif(kind, F.lit("")), F.lit("factual")).alias("query_type"))
    return trimmed.where("id <> ''")


def _set_aside(rows: DataFrame, quarantine: str) -> DataFrame:
    """Write the rows that could not be read, and give all rows back as one read, so that both sides saw the same."""
    seen = staged(rows, "read")
    seen.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("record"), F.col("file_").alias("file"), F.current_timestamp().alias("at")).write.mode("append").json(quarantine)
    return seen


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): how many records of each file were set aside."""
    return spark.read.schema("record string, file string, at timestamp").json(path).groupBy("file").agg(F.count("*").alias("n"))


def write_labels(rows: DataFrame, docs: DataFrame, path: str) -> None:
    """Labelled questions (id, document_id, query, expected_answer, evidence_text) as CSV, fields quoted where needed.
    Each snippet of the evidence must stand word for word in its document (id, content), else nothing is written."""
    parts = rows.select("id", "document_id", F.explode(tx.evidence_parts(F.col("evidence_text"))).alias("snippet"))
    there = parts.join(docs.select(F.col("id").alias("document_id"), "content"), "document_id", "left")
    if bad := there.where("NOT coalesce(contains(content, snippet), false)").select("id", "snippet").limit(20).collect():
        raise ValueError("not in their documents: " + "; ".join(f"{r.id}: {r.snippet[:60]!r}" for r in bad))
    rows.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def scan_summaries(spark: SparkSession, path: str, shape: str | None = None, quarantine: str | None = None) -> DataFrame:
    """Result summaries below ``path``, one JSON document in each folder. With a ``shape`` (columns as DDL) documents that can't be
    read in it are left out, and kept in ``quarantine`` if that is given."""
    files = f"{path}/*/summary.json"
    if shape is None:
        return spark.read.option("multiLine", True).json(files)
    rows = spark.read.schema(f"{shape}, {BAD} string").option("multiLine", True).option("columnNameOfCorruptRecord", BAD).json(files).withColumn("file_", F.col("_metadata.file_path"))
    if quarantine:
        rows = _set_aside(rows, quarantine)
    return rows.where(F.col(BAD).isNull()).drop(BAD, "file_")


def write_artifacts(rows: DataFrame, path: str) -> None:
    """Rows by ``slug``, a folder each, as JSON: a slug that is written again replaces its rows, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").json(path)


def index_write(chunks: DataFrame, path: str) -> None:
    """Chunks added to the index at ``path``, one folder for each strategy."""
    chunks.write.mode("append").partitionBy("strategy").parquet(path)


def index_dump(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """All chunks of an index, or those of one strategy, whose folder alone is read."""
    rows = spark.read.parquet(path)
    return rows if strategy is None else rows.where(F.col("strategy") == strategy)


def index_reset(spark: SparkSession, path: str, strategy: str) -> None:
    """Drop all chunks of a strategy; the others stay."""
    empty = spark.read.parquet(path).drop("strategy").limit(0)
    empty.write.mode("overwrite").parquet(f"{path}/strategy={strategy}")


def index_count(spark: SparkSession, path: str, strategy: str | None = None) -> int:
    return index_dump(spark, path, strategy).count()


def evict(cache: DataFrame, key: str, used: str, n: int = 2048) -> DataFrame:
    """The n rows used last, ties by key; Spark keeps n of each partition."""
    return cache.orderBy(F.desc_nulls_last(used), key).limit(n)


def upsert(new: DataFrame, path: str, key: str, batch: int) -> int:
    """Rows of ``new`` whose key the table at ``path`` doesn't have, added as ``batch``; gives how many were submitted.

    The table is a :class:`Ledger`: the rows count when the batch is committed, a batch that is run again adds nothing, and of several
    batches that hold a key the first one counts (:func:`upserted`), also where two writers didn't see each other."""
    shape = ", ".join(f"{n} {t}" for n, t in new.dtypes)
    ledger = Ledger(new.sparkSession, path, {"rows": shape})
    seen = staged(new, "submitted")
    submitted = seen.count()
    if not ledger.done(batch):
        ledger.write("rows", batch, first_of(seen, key, *[c for c in new.columns if c != key]).join(ledger.read("rows").select(key), key, "left_anti"))
        ledger.commit(batch, {"submitted": submitted})
    dropped(seen)
    return submitted


def upserted(spark: SparkSession, path: str, key: str, shape: str) -> DataFrame:
    """The table that :func:`upsert` keeps: one row of each key, from its first batch."""
    return first_of(Ledger(spark, path, {"rows": shape}).read("rows"), key, "batch").drop("batch")


def probe(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``wanted`` with the cached columns and whether each key was found."""
    return wanted.join(cache.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def cache_stats(probed: DataFrame) -> DataFrame:
    hits, misses = F.count_if("found"), F.count_if(~F.col("found"))
    return probed.agg(hits.alias("hits"), misses.alias("misses"), F.round(F.coalesce(F.try_divide(hits.cast("double"), hits + misses), F.lit(0.0)), 4).alias("hit_rate"))


def pending(wanted: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Work that isn't finished: an anti-join by key, or by several columns. With the slug and the :func:`fingerprint` of its configuration,
    what was done under other settings is done again."""
    keys = [key] if isinstance(key, str) else key
    return wanted.join(done.select(*keys), keys, "left_anti")


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first in ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, *[F.col("row")[c].alias(c) for c in rest])


def run_each(spark: SparkSession, slugs: list[str], work: Callable[[str], None], errors: str, only: list[str] | None = None) -> list[str]:
    """Run ``work`` for each configuration, or those in ``only``; gives the slugs that went through. One that fails is
    written to ``errors`` (slug, error) and the others go on."""
    done, failed = [], []
    for slug in slugs:
        if only is not None and slug not in only:
            continue
        try:
            work(slug)
            done.append(slug)
        except Exception:
            failed.append((slug, traceback.format_exc()))
    if failed:
        spark.createDataFrame(failed, "slug string, error string").write.mode("append").json(errors)
    return done


def fingerprint(config: dict) -> str:
    """Twelve hex digits that name a configuration by all its values, so that resumed work isn't mixed up with other settings."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def merge(base: dict, over: dict) -> dict:
    """Deep merge of configurations: nested dicts merge, other values replace."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def grid(spark: SparkSession, chunkers: list[str], retrievers: list[str], rerankers: list[str | None]) -> DataFrame:
    """(ordinal, chunker, retriever, reranker, slug) in nested order."""
    rows = [(i, c, r, x, f"{c}__{r}__{x or 'norerank'}") for i, (c, r, x) in enumerate(product(chunkers, retrievers, rerankers))]
    return spark.createDataFrame(rows, "ordinal long, chunker string, retriever string, reranker string, slug string")
