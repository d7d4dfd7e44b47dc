"""Approximate cosine search: a coarse quantiser with inverted lists, written as a table partitioned by list.

Centroids are fitted by spherical k-means on a bounded sample; every row goes to the list of its nearest one. A search
reads only the lists that some query probes (partition pruning) and scores a query against the rows of its own
lists, where they are read: neither rows nor queries are shuffled. A list is stored in parts of about ``PART_ROWS``, so one with many copies is many tasks' work. How
many lists a query must probe for a wanted recall is measured on the data, not guessed: see :func:`calibrate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators import retrieval
from lodestone.sources.staging import dropped, scratch, staged

#: Rows that centroids are fitted on, lists at most, and rows of a part of a list.
SAMPLE, MOST_LISTS, PART_ROWS, ITERATIONS = 20_000, 4096, 8192, 12
#: Queries, and rows, that one task scores at a time.
QUERY_CHUNK, BATCH = 1024, 1024
HASH = 1 << 30


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _rows(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable(rows: DataFrame) -> DataFrame:
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where((F.size("vector") > 0) & ~bad)


def share_of(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """About ``size`` rows, drawn by a hash of their key."""
    limit = min(1.0, size / max(1, rows.count())) * HASH
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(HASH)) < F.lit(limit))


def centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit rows; a centroid without rows moves to the row least like its own. Holds the products of ``BATCH`` rows at a time."""
    rng, x = np.random.default_rng(seed), _unit(x)
    means = x[rng.permutation(len(x))[:lists]]
    for _ in range(ITERATIONS):
        near, best = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), BATCH):
            sims = x[at : at + BATCH] @ means.T
            near[at : at + BATCH], best[at : at + BATCH] = np.argmax(sims, axis=1), np.max(sims, axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(means))
        for empty in np.flatnonzero(count == 0):
            at = int(np.argmin(best))
            sums[empty], best[at] = x[at], 2.0
        means = _unit(sums)
    return means


@dataclass
class ListIndex:
    """Inverted lists at ``path`` (unit_id, vector of length one, list, part), their centroids, and parts by list."""

    rows: DataFrame
    path: str
    means: np.ndarray
    parts: np.ndarray
    kind: str
    n: int


def _nearest_lists(means: np.ndarray, n: int, column: str):
    """Adds ``column``: the nearest list; with ``n``, the n nearest as bits, one for each list."""

    def near(x: np.ndarray) -> pa.Array:
        sims = _unit(x) @ means.T
        if n == 0:
            return pa.array(np.argmax(sims, axis=1).astype(np.int32))
        bits = np.zeros(sims.shape, bool)
        np.put_along_axis(bits, np.argsort(-sims, axis=1, kind="stable")[:, :n], True, 1)
        return pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield part.append_column(column, near(_rows(part.column("vector"))))

    return run


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _unit(_rows(batch.column("vector"))).astype(np.float64)
        at = batch.schema.get_field_index("vector")
        yield batch.set_column(at, "vector", pa.array(list(x), pa.list_(pa.float64())))


def build(units: DataFrame, lists: int | None = None, sample: int = SAMPLE, path: str | None = None) -> ListIndex:
    """An index of ``units`` (unit_id, vector of one length). Vectors that are null, empty or hold anything but finite numbers are left out; all
    others, zero vectors too, are in exactly one list. ``lists`` is the square root of the rows by default, at most 4,096."""
    spark = units.sparkSession
    kind = "string" if dict(units.dtypes)["unit_id"] == "string" else "long"
    rows = _usable(units.select(F.col("unit_id").cast(kind).alias("unit_id"), F.col("vector").cast("array<double>").alias("vector")))
    n = rows.count()
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    drawn = share_of(rows, "unit_id", sample, 1).select("unit_id", "vector").collect() or rows.limit(1).select("unit_id", "vector").collect()
    drawn.sort(key=lambda r: (r["unit_id"] is None, r["unit_id"]))
    means = centroids(np.array([r["vector"] for r in drawn], np.float64), lists) if drawn else np.zeros((1, 1))
    shape = f"unit_id {kind}, vector array<double>"
    filed = staged(rows.mapInArrow(_nearest_lists(means, 0, "list"), f"{shape}, list int").mapInArrow(_normalised, f"{shape}, list int"), "filed")
    counts = np.zeros(len(means), np.int64)
    for r in filed.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    parts = np.maximum(1, -(-counts // PART_ROWS))
    many = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    dealt = filed.withColumn("part", F.pmod(F.xxhash64("unit_id", "vector", F.monotonically_increasing_id()), many).cast("int"))
    at = path or scratch(spark, "lists")
    dealt.repartition("list", "part").write.partitionBy("list").parquet(at)
    dropped(filed)
    out = spark.read.schema(f"{shape}, part int, list int").parquet(at)
    out.staged_at = at
    return ListIndex(out, at, means, parts, kind, n)


def _scored(ids: list, kind: pa.DataType, vectors: np.ndarray, probed: np.ndarray, k: int):
    """The k best rows of the task's for each query, of the lists that it probes; ``probed`` has a row of bits for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last, which = retrieval.Best(len(ids), k), None, np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.diff(lists, prepend=-1)), len(lists)]
            for start, end in zip(cuts, cuts[1:]):  # rows of one list stand together, as its files do
                if (at := lists[start]) != last:
                    last, which = at, np.flatnonzero(probed[:, at >> 3] >> (7 - (at & 7)) & 1)
                for row in range(start, end, BATCH) if len(which) else ():
                    part = batch.slice(row, min(BATCH, end - row))
                    x = _rows(part.column("vector")).T
                    for first in range(0, len(which), QUERY_CHUNK):
                        some = which[first : first + QUERY_CHUNK]
                        best.add(some, vectors[some] @ x, part.column("unit_id"))
        yield from best.rows(pa.array(ids, kind))

    return run


def search(index: ListIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, unit_id, sim, rank): the k best of the lists that are nearest to each query (query_id, vector).

    Exact where ``probes`` is all lists. As in :func:`retrieval.dense_top`, queries are read in blocks of bounded size, and each block makes one pass over
    the lists that it probes; a task holds the products of QUERY_CHUNK queries and BATCH rows at a time, and what is best so far."""
    asked = _usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")))
    kind = dict(asked.dtypes)["query_id"]
    out, shape = None, f"query_id {kind}, unit_id {index.kind}, sim double"
    if index.n:
        probed = asked.mapInArrow(_nearest_lists(index.means, max(1, min(probes, len(index.means))), "lists"), f"query_id {kind}, vector array<double>, lists binary")
        for block in retrieval.blocks(probed, k, "lists"):
            bits = np.array([np.frombuffer(b, np.uint8) for _, _, b in block])
            wanted = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0))).tolist()
            rows = index.rows.where(F.col("list").isin(wanted)) if len(wanted) < len(index.means) else index.rows
            ask = _scored([q for q, _, _ in block], to_arrow_type(asked.schema["query_id"].dataType), _unit(np.array([v for _, v, _ in block])), bits, k)
            found = rows.select("unit_id", "vector", "list").mapInArrow(ask, shape)
            out = found if out is None else out.union(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"{shape}, rank long")
    return retrieval.top(out, k, F.desc("sim"), F.col("unit_id"))


def _places(means: np.ndarray):
    """(query_id, list, place): the place of every list in a query's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-(_unit(_rows(batch.column("vector"))) @ means.T), axis=1, kind="stable")
            for i in range(len(order)):
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(np.full(len(means), i))), pa.array(order[i].astype(np.int32)), pa.array(np.arange(1, len(means) + 1, dtype=np.int32))], ["query_id", "list", "place"])

    return run


def calibrate(index: ListIndex, k: int, target: float = 0.97, sample: int = 256) -> int:
    """The fewest probes that find ``target`` of the k nearest of about ``sample`` rows of the index, by an exact search for those."""
    if not index.n:
        return 1
    asked = share_of(index.rows, "unit_id", sample, 2).select(F.col("unit_id").alias("query_id"), "vector")
    if index.kind == "string":
        asked = asked.withColumn("query_id", F.xxhash64("query_id"))
    asked = staged(asked, "asked")
    near = retrieval.dense_top(index.rows.select("unit_id", "vector"), asked, k).select("query_id", "unit_id")
    where = near.join(index.rows.select("unit_id", "list"), "unit_id")
    places = where.join(asked.mapInArrow(_places(index.means), "query_id long, list int, place int"), ["query_id", "list"])
    need, seen = len(index.means), 0
    rows = sorted((r["place"], r["count"]) for r in places.groupBy("place").count().collect())  # lists at most
    total = sum(c for _, c in rows)
    for place, c in rows:
        seen += c
        if seen >= target * total:
            need = place
            break
    dropped(asked)
    return need


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, wanted, met, recall): how much of the exact lists was found."""
    both = exact.select("query_id", "unit_id").join(found.select("query_id", "unit_id", F.lit(True).alias("there_")), ["query_id", "unit_id"], "left")
    got = both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("there_").alias("met"))
    return got.withColumn("recall", F.round(F.coalesce(F.try_divide("met", "wanted"), F.lit(0.0)), 6))
