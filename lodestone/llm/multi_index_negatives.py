"""Hard negatives by an inverted multi-index.

Vectors are made integers and cut into two halves; each half has a codebook, and a pair of entries is
a cell. For an anchor, an entry's bound is its half-score plus the anchor's length times the entry's
radius (the farthest row from it), so a cell's summed bounds are never below the score of any of its
rows. A heap over the two sorted lists of bounds visits cells from the highest sum down and stops as soon as each
of the anchor's windows of scores is certified: it has its k rows, or all it can have, and no cell left
could hold a better one. Results are exact whatever the codebooks are.

Spark moves: rows are written by cell, a cell in blocks of about ``BLOCK_ROWS``, so one with a third
of all rows is many blocks. Searches go in rounds: round r visits what the heap reaches of the cells that begin within the
first ``FIRST * GROWTH**r`` rows of the anchor's order, and the rows found raise what later cells must
exceed. A visit carries the anchor to the blocks of a cell, where one matrix product scores a block for up
to about ``CHUNK`` anchors; only the first k rows of each window leave it. The codebooks are fitted on
about ``SAMPLE`` rows; codebooks and totals by cell are all that reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chebyshev_whitening import matrix, one_length
from .common import discard, materialise, table

SCALE, ENTRIES, SAMPLE, ITERATIONS = 256, 16, 20_000, 8
BLOCK_ROWS, CHUNK, FIRST, GROWTH = 2048, 2048, 2048, 8
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Entries beyond this size are cut to it, so that scores fit a long.
LARGEST = 1 << 22
NO_ID, FAR = (1 << 63) - 1, 1 << 62


def integers(column: pa.Array) -> np.ndarray:
    return np.clip(np.floor(matrix(column) * SCALE), -LARGEST, LARGEST).astype("<i4")


def packed_rows(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def unpacked_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1) if len(column) else np.zeros((0, 0), "<i4")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    kind = np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


# Codebooks and cells ------------------------------------------------------------------------------


def codebook(x: np.ndarray, entries: int = ENTRIES, seed: int = 0) -> np.ndarray:
    """Means of k-means over ``x``; an entry that nothing is nearest to moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0).astype(np.float64)
    means = distinct[rng.permutation(len(distinct))[:entries]]
    x = x.astype(np.float64)
    for _ in range(ITERATIONS):
        near, far = nearest(x, means)
        count = np.bincount(near, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        means = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], means)
        for empty in np.flatnonzero(count == 0):
            at = int(np.argmax(far))
            means[empty], far[at] = x[at], 0
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each row, and how far it is."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ means.T + (means * means).sum(axis=1)
    near = np.argmin(square, axis=1)
    return near, np.sqrt(((x - means[near]) ** 2).sum(axis=1))


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.drop_columns(["vector"]).append_column("q", packed_rows(integers(batch.column("vector"))))


def _assigned(books: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked_rows(batch.column("q")).astype(np.float64)
            if not len(x):
                continue
            half = x.shape[1] // 2
            (one, far1), (two, far2) = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            for name, column in (("cell", (one * len(books[1]) + two).astype(np.int64)), ("far1", far1), ("far2", far2)):
                batch = batch.append_column(name, pa.array(column))
            yield batch

    return run


_BLOCK = "cell long, block long, n long, rids binary, ids binary, labels binary, data binary"


def _block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Rows of a block as one, in the order of ties."""
    rows = rows.sort_by([("id", "ascending"), ("rid", "ascending")])
    longs = lambda c: rows.column(c).to_numpy().astype("<i8").tobytes()
    return pa.table({"cell": [key[0].as_py()], "block": [key[1].as_py()], "n": [rows.num_rows], "rids": pa.array([longs("rid")], pa.binary()), "ids": pa.array([longs("id")], pa.binary()), "labels": pa.array([longs("label")], pa.binary()), "data": pa.array([b"".join(rows.column("q").to_pylist())], pa.binary())})


class MultiIndex:
    """Rows by cell, written; ``books``, and by cell its rows and blocks. Made from (vec_id, label, vector, any others)."""

    def __init__(self, rows: DataFrame, entries: int = ENTRIES, sample: int = SAMPLE):
        rid = rows.withColumn("rid", F.monotonically_increasing_id())
        others = [f"{n} {t}" for n, t in rid.dtypes if n != "vector"]
        self.rows = materialise(rid.mapInArrow(_quantised, ", ".join([*others, "q binary"])), "rows")
        self.n = self.rows.count()
        share = F.lit(min(1.0, sample / max(1, self.n)) * (1 << 30))
        drawn = self.rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < share).select("q").collect() or self.rows.select("q").limit(1).collect()
        x = np.stack([np.frombuffer(r["q"], "<i4") for r in drawn]) if drawn else np.zeros((1, 1), "<i4")
        half = x.shape[1] // 2
        self.books = codebook(x[:, :half], entries, 1), codebook(x[:, half:], entries, 2)
        cells = materialise(self.rows.select("rid", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), "q").mapInArrow(_assigned(self.books), "rid long, id long, label long, q binary, cell long, far1 double, far2 double"), "cells")
        totals = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect()  # entries squared at most
        a, b = (len(x) for x in self.books)
        self.count, self.radii = np.zeros((a, b), np.int64), (np.zeros(a), np.zeros(b))
        for r in totals:
            i, j = divmod(r["cell"], b)
            self.count[i, j] = r["n"]
            self.radii[0][i] = max(self.radii[0][i], r["far1"])
            self.radii[1][j] = max(self.radii[1][j], r["far2"])
        parts = F.array(*[F.lit(int(n)) for n in -(-self.count // BLOCK_ROWS).ravel()])
        dealt = cells.withColumn("block", F.pmod(F.xxhash64("rid"), F.greatest(F.lit(1), F.element_at(parts, (F.col("cell") + 1).cast("int")))))
        self.blocks = materialise(dealt.groupBy("cell", "block").applyInArrow(_block, _BLOCK), "blocks")
        discard(cells)

    def order(self, q: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """Cells with rows, from the highest upper bound of their rows' scores with ``q`` down: (cell, upper, lower)."""
        half, tops, lows = len(q) // 2, [], []
        for part, book, radius in zip((q[:half], q[half:]), self.books, self.radii, strict=True):
            score, reach = book @ part, np.sqrt(float(part @ part)) * radius
            slack = 1e-9 * (np.abs(score) + reach) + 1e-6
            tops.append(score + reach + slack)
            lows.append(score - reach - slack)
        one, two = (np.argsort(-t, kind="stable") for t in tops)
        sums = lambda i, j: tops[0][one[i]] + tops[1][two[j]]
        heap, width = [(-sums(0, 0), 0, 0)], len(two)
        while heap:
            upper, i, j = heapq.heappop(heap)
            a, b = int(one[i]), int(two[j])
            if self.count[a, b]:
                yield a * width + b, -upper, float(lows[0][a] + lows[1][b])
            if j + 1 < width:
                heapq.heappush(heap, (-sums(i, j + 1), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-sums(i + 1, 0), i + 1, 0))

    def drop(self) -> None:
        discard(self.rows, self.blocks)


# Searches -----------------------------------------------------------------------------------------

_VISIT = "aid long, label long, q binary, needs array<long>, tops array<long>, cell long, blocks long"


def _visits(index: MultiIndex, since: int, upto: int):
    count, order = index.count.ravel(), index.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for n, (q, needs, tops) in enumerate(zip(batch.column("q").to_pylist(), batch.column("needs").to_pylist(), batch.column("tops").to_pylist(), strict=True)):
                open_ = [(a, b) for a, b in zip(needs, tops, strict=True) if a <= b]
                least, before = min((a for a, _ in open_), default=None), 0
                for cell, upper, lower in order(np.frombuffer(q, "<i4").astype(np.float64)) if open_ else ():
                    if upper < least or before >= upto:
                        break
                    if before >= since and any(a <= upper and lower <= b for a, b in open_):
                        at.append(n)
                        cells.append(cell)
                    before += int(count[cell])
            part = batch.take(pa.array(at, pa.int64())).append_column("cell", pa.array(cells, pa.int64()))
            yield part.append_column("blocks", pa.array([-(-int(count[c]) // BLOCK_ROWS) for c in cells], pa.int64()))

    # what a task needs of the index, without its tables
    slim = object.__new__(MultiIndex)
    slim.books, slim.count, slim.radii = index.books, index.count, index.radii
    order = slim.order
    return run


_FOUND = "aid long, score long, id long, rid long"


def _scanned(k: int, same: bool):
    def run(visits: pa.Table, blocks: pa.Table) -> pa.Table:
        """The first k rows of each window of each anchor that visits a block."""
        out = {"aid": [], "score": [], "id": [], "rid": []}
        for n, rids, ids, labels, data in zip(*(blocks.column(c).to_pylist() for c in ("n", "rids", "ids", "labels", "data")), strict=True):
            x = np.frombuffer(data, "<i4").reshape(n, -1)
            rids, ids, labels = (np.frombuffer(c, "<i8") for c in (rids, ids, labels))
            for start in range(0, visits.num_rows, 256):
                some = visits.slice(start, 256)
                own, aid = some.column("label").to_numpy(), some.column("aid").to_numpy()
                score = products(unpacked_rows(some.column("q").combine_chunks()), x)
                fit = (own[:, None] == labels) if same else (own[:, None] != labels)
                fit &= aid[:, None] != rids
                needs, tops = some.column("needs").to_pylist(), some.column("tops").to_pylist()
                for i in range(len(aid)):
                    mine, s, keep = np.flatnonzero(fit[i]), score[i], []
                    s = s[mine]
                    for low, high in zip(needs[i], tops[i], strict=True):
                        inside = mine[(s >= low) & (s <= high)]
                        # rows stand in the order of ties
                        keep.append(inside if len(inside) <= k else inside[np.argsort(-score[i][inside], kind="stable")[:k]])
                    keep = np.unique(np.concatenate(keep)) if keep else mine[:0]
                    for name, values in (("aid", np.full(len(keep), aid[i])), ("score", score[i][keep]), ("id", ids[keep]), ("rid", rids[keep])):
                        out[name].append(values)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    return run


def search(index: MultiIndex, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(aid, w, rank, score, id, rid): of each anchor's windows the k rows of highest score, ties by id and row, of its label or
    of all others. anchors: (aid, label, q, lows, tops), a window for each place of the two arrays. Exact; a written table."""
    spark = anchors.sparkSession
    windows = anchors.select("aid", F.posexplode(F.arrays_zip("lows", "tops")).alias("w", "r")).select("aid", "w", "r.lows", "r.tops")
    zero = F.lit(0).cast("long")
    best = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id", "rid")
    chunks = max(1, -(-anchors.count() // CHUNK))
    found, since, upto = spark.createDataFrame([], f"aid long, w int, rank long, {_FOUND.split(', ', 1)[1]}"), 0, FIRST
    while since < index.n:
        kth = found.where(F.col("rank") == k).select("aid", "w", F.col("score").alias("kth"))
        state = windows.join(kth, ["aid", "w"], "left").groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("kth", "lows").alias("need"), "tops"))).alias("s"))
        state = anchors.select("aid", "label", "q").join(state, "aid").select("aid", "label", "q", F.col("s.need").alias("needs"), F.col("s.tops").alias("tops"))
        visits = materialise(state.mapInArrow(_visits(index, since, upto), _VISIT), "visits")
        if not visits.isEmpty():
            asked = visits.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("chunk", F.pmod(F.xxhash64("aid"), F.lit(chunks)))
            held = index.blocks.withColumn("chunk", F.explode(F.sequence(zero, F.lit(chunks - 1).cast("long"))))
            keys = ("cell", "block", "chunk")
            new = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_scanned(k, same), _FOUND)
            rows = found.select("aid", "score", "id", "rid").distinct().unionByName(new).join(windows, "aid").where("score BETWEEN lows AND tops")
            now = rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
            now = materialise(now.select("aid", "w", "rank", "score", "id", "rid"), "found")
            if since:
                discard(found)
            found = now
        elif not since:
            found = materialise(found, "found")
        discard(visits)
        since, upto = upto, upto * GROWTH
    return found if index.n else materialise(found, "found")


def div_floor(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, entries: int = ENTRIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, vector).

    Of each row where ``anchor`` holds, the first ``positives`` other rows of its label are its positives; for each of them
    the first ``negatives`` rows of another label whose score is ``least`` to ``most`` hundredths of the positive's. Scores are
    inner products of floor(256 x), cut at 2^22 in size; equal ones (ties) go by id. Rows with a null label, a null, empty or
    non-finite vector, or one of another length than most have take no part. A row is told from others by its place, so
    repeated rows and ids are rows of their own, and each repeated anchor is answered; a null id comes last among ties (as
    does the largest long, which stands for it) and is no anchor unless ``anchor`` says so; other columns, whatever their names,
    are not looked at; an empty table gives no rows."""
    marked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    index = MultiIndex(one_length(marked.where("label IS NOT NULL"), "vector"), entries)
    asking = index.rows.where("asks").select(F.col("rid").alias("aid"), "vec_id", "label", "q")
    bounds = lambda x: F.array(F.lit(x).cast("long"))
    near = search(index, asking.select("aid", "label", "q", bounds(-FAR).alias("lows"), bounds(FAR).alias("tops")), positives, True)
    p = F.col("score")
    low, high = -div_floor(-p * least, 100), div_floor(p * most, 100)
    windows = near.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("top")))).alias("s"))
    wanted = asking.join(windows, "aid").select("aid", "label", "q", F.col("s.low").alias("lows"), F.col("s.top").alias("tops"))
    far = search(index, wanted, negatives, False)
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    pairs = near.select("aid", (F.col("rank") - 1).cast("int").alias("w"), named("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("aid", "w", F.col("rank").cast("int").alias("rank"), named("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(pairs, ["aid", "w"]).join(asking.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    result = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(near, far)
    index.drop()
    return result


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by 100; where it is divisible by 7, the label moves on by one, mod 10."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(x * {SCALE})) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS a, o.vec_id AS o, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score FROM r a JOIN r o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, o AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) <= {POSITIVES}),
n AS (SELECT a, positive_id, positive_score, o AS negative_id, score AS negative_score, (row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, o))::INT AS rank
  FROM p JOIN s USING (a) WHERE NOT same AND 100 * score BETWEEN {LEAST} * positive_score AND {MOST} * positive_score)
SELECT a AS anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
