"""Exact and approximate search: memory of a task, ties, what is shuffled."""

import tracemalloc
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import ann, retrieval
from lodestone.plans import catalogue, workflow


def peak_mb(run, *batches):
    tracemalloc.start()
    try:
        out = list(run(iter(batches)))
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def vector_batch(rng, n, dim, first=0):
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), retrieval.array_of(rng.standard_normal((n, dim)))], ["unit_id", "vector"])


def test_a_task_holds_few_products_and_hands_on_its_own_best():
    rng = np.random.default_rng(4)
    out, mb = peak_mb(retrieval._nearest(list(range(12_000)), rng.standard_normal((12_000, 8)), 5), *(vector_batch(rng, 4096, 8, 4096 * i) for i in range(2)))
    assert mb < 250 and sum(b.num_rows for b in out) == 5 * 12_000


def test_lists_of_a_batch_are_ordered_in_parts():
    rng = np.random.default_rng(5)
    out, mb = peak_mb(ann._nearest_lists(rng.standard_normal((2000, 8)), 7, "lists"), vector_batch(rng, 8000, 8))
    assert mb < 150 and sum(b.num_rows for b in out) == 8000


def test_best_equals_a_plain_sort(spark, monkeypatch):
    """Ties by id, over several parts, blocks of queries and weighings; vectors that occur often."""
    monkeypatch.setattr(retrieval, "QUERY_FLOATS", 40)
    monkeypatch.setattr(retrieval, "PRODUCTS", 2048)
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (3000, 4)).astype(np.float64)
    ids = rng.permutation(3000)
    units = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "unit_id long, vector array<double>")
    queries = units.where("unit_id < 25").withColumnRenamed("unit_id", "query_id")
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit, want = np.divide(x, length, out=np.zeros_like(x), where=length > 0), {}
    for i, v in zip(ids, unit, strict=True):
        if i < 25:
            sims = np.round(unit @ v, 6)
            want[i] = [(int(ids[j]), sims[j]) for j in np.lexsort((ids, -sims))[:7]]
    got = {q: [(r.unit_id, r.sim) for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in groupby(sorted(retrieval.dense_top(units, queries, 7).collect()), key=lambda r: r.query_id)}
    assert got == want
    named = retrieval.dense_top(units.withColumn("unit_id", F.format_string("%04d", "unit_id")), queries, 7).collect()
    assert sorted((r.query_id, int(r.unit_id), r.sim) for r in named) == sorted((q, i, s) for q, rows in want.items() for i, s in rows)


def test_a_search_of_lists_shuffles_its_best_alone(spark, sf):
    index, asked = workflow.list_index(spark, sf)
    plan = ann.search(index, asked, 10, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan


def test_label_metrics_do_not_depend_on_blocks(spark, sf, monkeypatch):
    whole = sorted(map(tuple, catalogue.vector_label_metrics(spark, sf).collect()))
    monkeypatch.setattr(retrieval, "QUERY_FLOATS", 300)
    monkeypatch.setattr(retrieval, "PRODUCTS", 4096)
    assert whole == sorted(map(tuple, catalogue.vector_label_metrics(spark, sf).collect())) and len(whole) > 1
