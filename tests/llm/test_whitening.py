import numpy as np
import pytest

from lodestone.llm import chebyshev_whitening as cw


def by_covariance(vectors):
    """x, sums, centred x and the eigenpairs of its covariance formed whole, by falling eigenvalue."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    s = x.sum(axis=0)
    c = x - s / len(x)
    values, q = np.linalg.eigh(c.T @ c / len(x))
    return x, s, c, values[::-1], q[:, ::-1]


def compare(rows, ids, vectors):
    x, s, c, values, q = by_covariance(vectors)
    k = min(8, x.shape[1])
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == len(ids) * k
    sign = {}
    for i, v, row in zip(ids, x, c, strict=True):
        far = sum((len(x) * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        for j in range(k):
            want = row @ q[:, j] / np.sqrt(values[j])
            r = by[i, j + 1].pop()
            assert r.n == len(x) and r.deviation == far
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
            if abs(want) > 1e-3:
                sign.setdefault(j, np.sign(want * r.whitened))
            assert r.whitened * sign.get(j, 1) == pytest.approx(want, abs=1e-6)
            assert r.identity_error < 1e-9


def test_whole_table_against_a_covariance_formed_whole(spark, sf):
    rows = cw.op11_chebyshev_whitening(spark, sf).collect()
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compare(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_filter_finds_close_eigenvalues_behind_a_strong_one(spark):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    spread = np.concatenate([[40.0], np.linspace(1.3, 1.25, 9), np.linspace(1.2, 0.2, 70)])
    vectors = (rng.standard_normal((3000, 80)) * spread) @ basis
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    compare(cw.whiten(frame).collect(), list(range(3000)), vectors)


def test_partials_fold_beyond_the_tasks_the_driver_adds(spark, sf, monkeypatch):
    monkeypatch.setattr(cw, "FOLD", 2)
    given = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(7)
    found, v = cw.fit(given.select(given.embedding.cast("array<double>").alias("vector")))
    values = by_covariance([r.embedding for r in given.collect()])[3]
    assert found.values == pytest.approx(values[:8], rel=1e-11) and found.residual <= 1e-12 and v.passes == found.passes


@pytest.mark.parametrize("dims", [1, 2, 9])
def test_few_dimensions(spark, dims):
    vectors = np.random.default_rng(dims).standard_normal((50, dims)).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    compare(cw.whiten(frame).collect(), list(range(50)), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(4).tolist()) for i in range(20)] + [(33, [1.0, 2.0, 3.0, 4.0])] * 2 + [(None, [0.5, 0.0, 0.0, 1.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan")] * 4), (94, [1.0, float("-inf"), 0.0, 0.0]), (95, [1.0, 2.0])]
    shape = "vec_id long, embedding array<double>, vector string, n string, component string, block string, whitened string"
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in good + bad], shape)
    rows = cw.whiten(frame).collect()
    assert rows[0].n == 23
    compare(rows, [i for i, _ in good], [v for _, v in good])


def test_without_rows_or_spread(spark):
    shape = "vec_id long, embedding array<float>"
    assert cw.whiten(spark.createDataFrame([], shape)).count() == 0
    assert cw.whiten(spark.createDataFrame([(1, None)], shape)).count() == 0
    assert cw.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], shape)).count() == 0
    line = cw.whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], shape)).collect()
    assert {r.component for r in line} == {1} and all(r.identity_error < 1e-9 for r in line)


def test_deviation_beyond_a_long_is_null(spark):
    rows = cw.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(rows) and all(r.deviation is None for r in rows)
