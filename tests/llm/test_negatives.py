import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import multi_index_negatives as mi

SHAPE = "vec_id long, label int, vector array<double>"
LAST = 1 << 63


def plain(rows, positives=5, negatives=10):
    """Every pair scored; rows are told apart by their place."""
    good = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows if lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    length = max(Counter(len(v) for _, _, v in good).items(), key=lambda x: (x[1], x[0]), default=(0, 0))[0]
    good = [r for r in good if len(r[2]) == length]
    tie = lambda i: LAST if i is None else i
    out = []
    for n, (a, lab, v) in enumerate(good):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, k == lab) for m, (i, k, w) in enumerate(good) if m != n]
        scored.sort(key=lambda s: (-s[0], tie(s[1])))
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            hits = [s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(a, pid, r, i, p, s) for r, (s, i, _) in enumerate(hits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SHAPE)
    return sorted(map(tuple, mi.mine(frame, F.col("vec_id") % 100 == 0, **options).collect()), key=repr)


def test_equal_to_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got, want = mi.op12_multi_index(spark, sf), con.sql(mi.ORACLE_SQL)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 50


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_rounds_stop_early_and_lose_nothing(spark, monkeypatch, spread):
    for name, value in (("FIRST", 30), ("GROWTH", 3), ("BLOCK_ROWS", 7), ("CHUNK", 2)):
        monkeypatch.setattr(mi, name, value)
    rng = np.random.default_rng(int(spread * 100))
    middles = rng.standard_normal((6, 6))
    rows = [(i, int(rng.integers(4)), (middles[i % 6] + spread * rng.standard_normal(6)).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(60)]  # ties and one crowded cell
    want = plain(rows)
    assert mined(spark, rows, entries=5) == want and want


def test_order_is_a_certificate(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 7))
    index = mi.MultiIndex(spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], SHAPE), 6)
    whole = np.floor(256 * vectors)
    one, two = (mi.nearest(x, b)[0] for x, b in zip((whole[:, :3], whole[:, 3:]), index.books, strict=True))
    for q in whole[:20]:
        visited = list(index.order(q))
        assert [u for _, u, _ in visited] == sorted((u for _, u, _ in visited), reverse=True)
        assert {c for c, _, _ in visited} == set(one * len(index.books[1]) + two)
        bounds = {c: (u, low) for c, u, low in visited}
        for i, s in enumerate(whole @ q):
            upper, lower = bounds[one[i] * len(index.books[1]) + two[i]]
            assert lower <= s <= upper
    index.drop()


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 20, i % 2, rng.standard_normal(4).tolist()) for i in range(40)]
    rows += [(100, 0, rows[5][2])] * 2 + [(None, 1, rows[5][2]), (None, 0, rows[3][2]), (7, -3, rows[2][2])]
    rows += [(900, None, [1.0] * 4), (1000, 1, None), (1100, 1, []), (1200, 1, [1.0, None, 1.0, 1.0]), (1300, 1, [float("nan")] * 4), (1400, 1, [float("inf")] * 4), (1500, 1, [1.0, 2.0])]
    assert mined(spark, rows) == plain(rows)
    extra = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SHAPE + ", q string, rid string, cell string")
    assert sorted(map(tuple, mi.mine(extra, F.col("vec_id") % 100 == 0).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(100, 1, [1.0])], [(100, 1, [2.0]), (1, 1, [1.0]), (2, 0, [0.5]), (3, 0, [0.5])], [(100, 0, [-1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [0.5, 1.0])]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == plain(rows)
