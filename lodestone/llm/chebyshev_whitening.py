"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of a table of vectors are found without forming V: a
block of ``components + guard`` directions Q is multiplied by V in passes over the vectors, each of
which sums centred x (xᵀQ) in its tasks. A round of ``degree`` passes runs the Chebyshev recurrence on
the interval from 0 to the least Ritz value so far, which holds the unwanted spectrum and is damped,
while everything above it grows; QR and Rayleigh-Ritz then give new directions. Rounds go on until
each wanted pair (e, u) is certified by its residual |Vu - eu|.

Vectors are made integers first, so counts, sums and centred vectors n*x - S are exact. They are
packed once into blocks of about ``BLOCK_BYTES`` in the shared folder, which every pass reads; a pass
sends one matrix of dimension by block size for each task, and beyond ``FOLD`` tasks these are added
in tasks before they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
GUARD, DEGREE, ROUNDS, TOLERANCE = 24, 12, 60, 2e-13
BLOCK_BYTES, FOLD = 2 << 20, 64
#: Integers beyond this size are cut to it, so that no sum of a block leaves a long.
LARGEST = 1 << 50


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def one_length(rows: DataFrame, column: str) -> DataFrame:
    """Usable rows whose ``column`` has the commonest length, ties the greater."""
    rows = rows.where(usable(F.col(column)))
    length = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(column) == (length["d"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths, as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def integers(column: pa.Array) -> np.ndarray:
    x = np.clip(np.floor(matrix(column) * SCALE), -LARGEST, LARGEST)
    return x.astype(np.int64) + SHIFT


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors as little-endian longs, with exact sums by dimension in two halves."""
    for batch in batches:
        x = integers(batch.column("vector"))
        step = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            high = part >> 25
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int64()), pa.array([part.astype("<i8").tobytes()], pa.binary()), pa.array([high.sum(axis=0)], pa.list_(pa.int64())), pa.array([(part - (high << 25)).sum(axis=0)], pa.list_(pa.int64()))],
                ["n", "block", "high", "low"],
            )


@dataclass
class Fit:
    """n vectors with sums by dimension; unit components as columns, their eigenvalues, the trace, and how it went."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: longs where they fit, else Python's integers."""
    bound = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) if x.size else 0
    if bound < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _summed(term: Callable[[np.ndarray], np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for block in batch.column("block"):
                part = term(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        for part in batch.column("part"):
            part = np.frombuffer(part.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def over_blocks(blocks: DataFrame, dims: int, shape: tuple[int, ...], term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``term`` (of a block's integers), one pass; the driver adds FOLD matrices at most."""
    parts = blocks.select("block").mapInArrow(_summed(term, dims), "part binary")
    if parts.rdd.getNumPartitions() > FOLD:
        parts = parts.repartition(FOLD).mapInArrow(_added, "part binary")
    return sum((np.frombuffer(r["part"], np.float64) for r in parts.collect()), np.zeros(int(np.prod(shape)))).reshape(shape)


class Covariance:
    """V times directions, by passes over blocks of vectors."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.sums, self.dims, self.passes = blocks, n, sums, len(sums), 0

    def over(self, shape: tuple[int, ...], term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The mean of ``term`` of the centred vectors x - S/n."""
        n, sums = self.n, self.sums
        self.passes += 1
        return over_blocks(self.blocks, self.dims, shape, lambda x: term(centred(x, n, sums).astype(np.float64) / n)) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self.over(q.shape, lambda x: x.T @ (x @ q))

    def trace(self) -> float:
        return float(self.over((1,), lambda x: np.array([np.sum(x * x)]))[0])


def filtered(v: Covariance, q: np.ndarray, upper: float, top: float, degree: int, held: np.ndarray) -> np.ndarray:
    """Chebyshev polynomial in V of ``q``, small on [0, upper] and scaled to one at ``top``: a pass for each degree.
    Directions ``held`` are taken out after each."""
    half = upper / 2
    sigma = first = half / (half - top)
    apart = lambda y: y - held @ (held.T @ y)
    before, now = q, apart((v.times(q) - half * q) * (first / half))
    for _ in range(degree - 1):
        follow = 1 / (2 / first - sigma)
        before, now = now, apart((v.times(now) - half * now) * (2 * follow / half) - sigma * follow * before)
        sigma = follow
    return now


def leading(v: Covariance, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors of V as columns, and the largest residual in units of its eigenvalue.

    A pair is certified when its residual is at most ``tolerance`` eigenvalues, or, where rounding allows no less, at most
    1e-10 of the first one and no longer halving in a round; it is held then and taken out of the others. A round's degree is
    less where the first direction not held would outgrow the last by over 1e8, which would drown it. The guard directions start at
    random and go through the same filter, so a direction that belongs to the wanted ones and was missed would outgrow them."""
    k, size = min(v.dims, components), min(v.dims, components + guard)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((v.dims, size)))[0]
    held, values, worst, before = np.zeros((v.dims, 0)), [], 0.0, np.inf
    for _ in range(ROUNDS):
        product = v.times(q)
        product -= held @ (held.T @ product)
        small = q.T @ product
        e, turn = np.linalg.eigh((small + small.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        first = values[0] if values else e[0]
        off = np.linalg.norm(product - q * e, axis=0)
        sure = 0
        while len(values) < k and sure < len(e):
            fine = off[sure] <= tolerance * max(e[sure], 0.0) or (not sure and before / 2 < off[0] <= 1e-10 * first) or e[sure] <= 1e-13 * v.dims * first
            if not fine:
                break
            values.append(max(float(e[sure]), 0.0))
            worst = max(worst, float(off[sure]) / max(e[sure], 1e-13 * v.dims * first, 5e-324))
            sure += 1
        if len(values) == k:
            held = np.hstack([held, q[:, :sure]])
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], held[:, order], worst
        before = off[sure] if not sure else np.inf
        held, q, e = np.hstack([held, q[:, :sure]]), q[:, sure:], e[sure:]
        if held.shape[1] + q.shape[1] < v.dims:
            upper = max(float(e[-1]), 1e-12 * first)
            growth = np.arccosh(max(2 * e[0] / upper - 1, 1 + 1e-12))
            q = filtered(v, q, upper, max(float(e[0]), 2 * upper), int(np.clip(18 / growth, 1, degree)), held)
        for _ in range(2):  # where columns have nearly met, rounding brings held directions back
            q = np.linalg.qr(q - held @ (held.T @ q))[0]
    raise ArithmeticError(f"not certified after {ROUNDS} rounds: residual {off[0]:.2e} of {e[0]:.2e}")


def fit(vectors: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> tuple[Fit | None, Covariance | None]:
    """The leading components of ``vectors`` (vector: arrays of one length, usable); None without a row.

    Components whose eigenvalue is no more than rounding (1e-13 of the first for each dimension) are left out, as nothing
    can be divided by them: one vector alone, or copies of one, have none. Equal eigenvalues give any basis."""
    blocks = materialise(vectors.select("vector").mapInArrow(_packed, "n long, block binary, high array<long>, low array<long>"), "vectors")
    at = blocks.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = at.groupBy("i").agg(F.sum("n").alias("n"), whole("s.high").alias("high"), whole("s.low").alias("low")).orderBy("i").collect()  # a row for each dimension
    if not rows:
        discard(blocks)
        return None, None
    v = Covariance(blocks, rows[0]["n"], [(int(r["high"]) << 25) + int(r["low"]) for r in rows])
    trace = v.trace()
    values, q, residual = leading(v, components, guard, degree) if trace > 0 else (np.zeros(0), np.zeros((v.dims, 0)), 0.0)
    some = values > 1e-13 * v.dims * (values[0] if len(values) else 0)
    return Fit(v.n, v.sums, q[:, some], values[some], trace, residual, v.passes), v


def identity_error(v: Covariance, found: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured in two passes."""
    w, k = found.components / np.sqrt(found.values), len(found.values)
    middle = v.over((k,), lambda x: (x @ w).sum(axis=0))
    cov = v.over((k, k), lambda x: (y := x @ w - middle).T @ y)
    return float(np.max(np.abs(cov - np.eye(k)))) if k else 0.0


_ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def _whitened(found: Fit, error: float):
    k = len(found.values)
    w = found.components / np.sqrt(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = centred(integers(part.column("vector")), found.n, found.sums)
                if d.dtype != object and float(np.max(np.abs(d))) ** 2 * d.shape[1] < 2**62:
                    far = (d * d).sum(axis=1)
                else:
                    sizes = [sum(int(c) ** 2 for c in row) for row in d]
                    far = pa.array([s if s < 1 << 63 else None for s in sizes], pa.int64()).to_numpy(zero_copy_only=False)
                m = part.num_rows
                each = lambda x: pa.array(np.repeat(x, k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(each(np.arange(m))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), each(np.full(m, found.n, np.int64)), pa.array(np.repeat(far, k), pa.int64(), from_pandas=True),
                    pa.array((d.astype(np.float64) / found.n @ w).ravel()), pa.array(np.tile(found.values / found.trace, m)), each(np.full(m, error)), pa.array(np.tile(found.values, m)),
                ], [f.split()[0] for f in _ROW.split(", ")])

    return run


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue): each usable row on each of the first ``components`` components.

    Rows whose vector is null, empty, or holds a null or non-finite entry take no part, nor do those of another length than
    most vectors have. Entries become integers floor(1024 c) + 100,000, cut at 2^50 in size. Repeated rows and ids count and
    are answered each; a null id stays null; columns beside the two are not looked at, whatever their names; an empty table, or vectors without any spread,
    gives no rows. deviation is exact, and null where a long can't hold it. Equal eigenvalues (ties) give any basis of their
    space, the same for all rows."""
    spark = rows.sparkSession
    vectors = one_length(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")), "vector")
    found, v = fit(vectors, components)
    if found is None or not len(found.values):
        if v is not None:
            discard(v.blocks)
        return spark.createDataFrame([], _ROW)
    error = identity_error(v, found)
    discard(v.blocks)
    return vectors.mapInArrow(_whitened(found, error), _ROW)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
