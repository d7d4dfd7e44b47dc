"""Retrieval over frames: units (unit_id, text), queries (query_id, text), ranked lists (query_id, unit_id, score, rank)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import text as tx
from lodestone.functions.vectors import hashes_of
from lodestone.sources.staging import settled, staged

K1, B, RRF_K = 1.5, 0.75, 60
DIGITS = 6
#: Floats of query vectors, or places of their lists, that one pass over the vectors carries; products that a task holds at once.
QUERY_FLOATS, PRODUCTS = 1 << 20, 1 << 20
#: Terms of queries that a scan of units carries as a literal.
VOCABULARY = 20_000
#: Rows of queries' terms that are broadcast at most.
TERM_ROWS = 200_000
#: Weights of terms for queries that a task holds at most.
WEIGHTS = 1 << 22


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows of each query; Spark limits each partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(1e-6))


def term_stats(units: DataFrame) -> DataFrame:
    """(term, df, idf) of all terms."""
    n = units.agg(F.count("*").alias("n"))  # reads no column
    df = units.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), DIGITS).alias("idf"))


def lexical_index(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(unit_id, len, hits) of each unit, a written table: its length in terms, and the occurrences of terms that some query has.

    One scan of the units, and as large as the queries' terms are frequent: their vocabulary is a literal up to ``VOCABULARY``
    terms; with more, all terms of the units are kept. :func:`bm25` and :func:`rerank` read it as often as they need."""
    terms = [r["term"] for r in query_terms(queries).select("term").distinct().limit(VOCABULARY + 1).collect()]
    if len(terms) <= VOCABULARY:
        out = staged(units.select("unit_id", F.lower("text").alias("text")).mapInArrow(_hits(terms), f"unit_id {dict(units.dtypes)['unit_id']}, len int, hits array<string>"), "hits")
    else:
        cut = units.select("unit_id", tx.tokens(F.col("text")).alias("hits"))
        out = staged(cut.select("unit_id", F.size("hits").alias("len"), "hits"), "hits")
    out.few_terms = len(terms) <= VOCABULARY
    return out


def _hits(terms: list[str]):
    """:func:`tx.tokens` of texts in lower case: how many, and those among ``terms``; null for a null text."""
    known, stop, cut = frozenset(terms), frozenset(tx.STOP_WORDS), re.compile("[a-z0-9]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _pieces(batch)):
            tokens = [None if t is None else cut(t) for t in part.column(1).to_pylist()]
            length = [None if ts is None else len(ts) - sum(map(stop.__contains__, ts)) for ts in tokens]
            hits = [None if ts is None else list(filter(known.__contains__, ts)) for ts in tokens]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int32()), pa.array(hits, pa.list_(pa.string()))], ["unit_id", "len", "hits"])

    return run


def bm25(units: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """BM25 top-k of units (or of a :func:`lexical_index` of them); a term that a query repeats counts each time. Units of equal score come by id.

    Where the queries have few terms (``VOCABULARY``, and not above ``WEIGHTS`` with the queries), each task has the weight of every term for every query
    and multiplies its units' by them, a piece at a time: only its k best of a query move. Beyond that, and where units share an id, joins."""
    if "hits" not in units.columns:
        index = lexical_index(units, queries)
        return settled(bm25(index, queries, k), "ranked", index)
    terms, few = query_terms(queries), getattr(units, "few_terms", False)
    if few and (found := few_weights(terms)) is not None:
        whole = units.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.count_distinct("unit_id").alias("ids")).first()
        if whole.n == whole.ids:
            df = {r["term"]: r["df"] for r in units.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
            return multiplied(units, terms, df, found[1], whole, k)
    # per-corpus totals: one row
    totals = units.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg"))
    hits = units.repartition("unit_id").select("unit_id", "len", F.explode("hits").alias("term"))
    df = units.select("unit_id", F.explode(F.array_distinct("hits")).alias("term"))
    if not few:
        wanted = terms.select("term").distinct()
        hits, df = hits.join(wanted, "term", "left_semi"), df.join(wanted, "term", "left_semi")
    postings = hits.groupBy("unit_id", "len", "term").agg(F.count("*").alias("tf"))
    return score_postings(postings, df.groupBy("term").agg(F.count("*").alias("df")), totals, terms, k, few)


def few_weights(terms: DataFrame) -> tuple[list[str], int] | None:
    """The distinct terms of queries and how many queries have one, if there are few of both (VOCABULARY, WEIGHTS)."""
    found = [r["term"] for r in terms.select("term").distinct().limit(VOCABULARY + 1).collect()]
    if len(found) > VOCABULARY:
        return None
    asked = terms.select("query_id").distinct().count()
    return (found, asked) if len(found) * asked <= WEIGHTS else None


def multiplied(units: DataFrame, terms: DataFrame, df: dict[str, int], asked: int, totals: Row, k: int, codes: dict[str, int] | None = None) -> DataFrame:
    """BM25 top-k of ``units`` (unit_id, len, hits) with ids of their own, by products of weights. Hits are terms, or their ``codes``. ``df``: how many units have a term; ``asked``: queries with a
    term; ``totals``: units ``n`` and their average length ``avg``."""
    vocabulary = sorted(df)
    place, ids, weights = {t: i for i, t in enumerate(vocabulary)}, {}, np.zeros((len(vocabulary), asked))
    for q, term, n in terms.collect():  # WEIGHTS at most
        if d := df.get(term):
            weights[place[term], ids.setdefault(q, len(ids))] = n * max(math.log((totals.n - d + 0.5) / (d + 0.5) + 1), 1e-6)
    shape = T.StructType([T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField("unit_id", units.schema["unit_id"].dataType), T.StructField("score", T.DoubleType())])
    found = units.select("unit_id", "len", "hits").mapInArrow(_weighed(pa.array(list(ids), to_arrow_type(shape["query_id"].dataType)), pa.array([codes[t] for t in vocabulary], pa.int32()) if codes else pa.array(vocabulary, pa.string()), weights[:, : len(ids)], totals.avg or 1.0, k), shape)
    return top(found, k, F.desc("score"), F.col("unit_id"))


def _weighed(ids: pa.Array, known: pa.Array, weights: np.ndarray, avg: float, k: int):
    """The k best units of a task for each query; ``weights`` has a row for each ``known`` term and a column for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, every = Best(len(ids), k, 0.0), np.arange(len(ids))
        step = max(1, PRODUCTS // max(1, *weights.shape))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                term = pc.fill_null(pc.index_in(pc.list_flatten(part.column("hits")), value_set=known), -1).to_numpy().astype(np.int64)
                row = pc.list_parent_indices(part.column("hits")).to_numpy().astype(np.int64)
                pairs, tf = np.unique((row * len(known) + term)[term >= 0], return_counts=True)
                if not len(pairs) or not len(ids):
                    continue
                row, term = np.divmod(pairs, len(known))
                length = part.column("len").to_numpy(zero_copy_only=False)[row]
                used, term = np.unique(term, return_inverse=True)
                share = np.zeros((len(used), part.num_rows))
                share[term, row] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))
                best.add(every, weights[used].T @ share, part.column("unit_id"))
        yield from best.rows(ids, "score")

    return run


def score_postings(postings: DataFrame, df: DataFrame, totals: DataFrame, terms: DataFrame, k: int, few: bool = False) -> DataFrame:
    """BM25 top-k from postings (unit_id, len, term, tf), df (term, df), totals (n, avg; one row) and the queries' terms (query_id, term, qtf).
    ``few``: there are at most VOCABULARY terms, so df is broadcast, and terms by query are if they are at most TERM_ROWS."""
    df = df.crossJoin(F.broadcast(totals))
    if few:
        df = F.broadcast(df)
        terms = F.broadcast(terms) if terms.count() <= TERM_ROWS else terms
    # a posting's weight doesn't depend on the query: it is worked out once, before queries multiply the rows
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    weighted = postings.join(df, "term").select("unit_id", "term", part.alias("w"))
    scored = weighted.join(terms, "term").groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), DIGITS).alias("score"))
    return top(scored.where("score > 0"), k, F.desc("score"), F.col("unit_id"))


def array_of(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _pieces(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch (key, text, ...) in pieces of at most 4,096 rows and about ``most`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
        end = max(at + 1, min(end, at + 4096))
        yield batch.slice(at, end - at)
        at = end


def _counted(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _pieces(batch)):
            words = [(t or "").split() for t in part.column(1).to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            some = np.flatnonzero(sizes)
            row = np.repeat(np.arange(len(some)), sizes[some])
            bucket = (hashes_of([w for ws in words for w in ws]) % np.uint64(dim)).astype(np.int64)
            counts = np.bincount(row * dim + bucket, minlength=len(some) * dim).reshape(-1, dim).astype(np.float64)
            if len(some):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), array_of(counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True)))], [part.schema.names[0], "vector"])

    return run


def vectors_of(rows: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """(key, vector) of rows with a word: how many of its words fall in each of ``dim`` buckets of md5, at length one.

    A worker counts a piece of bounded size at once, and hashes each of its words once."""
    if dim & (dim - 1) or dim > 1 << 28:
        raise ValueError("the dimension is a power of two: buckets are the last bits of the digest")
    return rows.select(key, F.lower("text").alias("text")).mapInArrow(_counted(dim), f"{key} {dict(rows.dtypes)[key]}, vector array<double>")


def hash_vectors(rows: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """(key, bucket, weight): the cells of :func:`vectors_of` that aren't zero."""
    cells = vectors_of(rows, key, dim).select(key, F.posexplode("vector").alias("bucket", "weight"))
    return cells.where("weight > 0").select(key, F.col("bucket").cast("long").alias("bucket"), "weight")


#: From (key, text) rows and the key's name to (key, vector); rows without a vector are left out.
Embedder = Callable[[DataFrame, str], DataFrame]
#: From columns of a question's and a unit's text to a column of scores, higher is better.
Scorer = Callable[[Column, Column], Column]


def sparse_top(units: DataFrame, queries: DataFrame, k: int = 5, embedder: Embedder = vectors_of) -> DataFrame:
    """Cosine top-k of what ``embedder`` makes of texts (by default hash embeddings, worked out row by row), by :func:`dense_top`."""
    return dense_top(embedder(units.select("unit_id", "text"), "unit_id"), embedder(queries.select("query_id", "text"), "query_id"), k)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The k best units of each of ``n`` queries, of all that a task has seen: by score, rounded, then by id, as in the final ranking.
    Only scores above ``over`` count. Holds k units a query, and at most about as many again before they are weighed, with PRODUCTS more."""

    def __init__(self, n: int, k: int, over: float = -np.inf):
        self.k, self.over, self.found, self.held, self.most = k, over, [], 0, n * k + PRODUCTS
        self.floor = np.full(n, -np.inf)  # the score of a query's k-th unit so far

    def add(self, which: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of the queries numbered ``which`` (rows) for units ``ids`` (columns)."""
        floor = self.floor[which]
        mask = scores > np.maximum(floor - 2 * 10.0**-DIGITS, self.over)[:, None]  # a score may rise by half a unit of its last digit
        many = np.flatnonzero(np.count_nonzero(mask, axis=1) > self.k)
        if len(many):
            some = np.where(mask[many], np.round(scores[many], DIGITS), -np.inf)
            mask[many] = some >= np.partition(some, -self.k, axis=1)[:, -self.k, None]
        row, unit = np.nonzero(mask)
        score = np.round(scores[row, unit], DIGITS) + 0.0
        keep = np.flatnonzero((score >= floor[row]) & (score > self.over))
        if len(keep):
            self.found.append((which[row[keep]], score[keep], ids.take(pa.array(unit[keep]))))
            self.held += len(keep)
        if self.held > self.most:
            self.weigh()

    def weigh(self) -> None:
        q, score, ids = (np.concatenate([f[i] for f in self.found]) if i < 2 else pa.chunked_array([f[2] for f in self.found]).combine_chunks() for i in range(3))
        table = pa.table({"q": q, "score": score, "id": ids})
        order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        q, score = q[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last, keep = place == self.k - 1, np.flatnonzero(place < self.k)
        self.floor[q[last]] = score[last]
        self.found, self.held = [(q[keep], score[keep], ids.take(pa.array(order[keep])))], len(keep)

    def rows(self, ids: pa.Array, name: str = "sim") -> Iterator[pa.RecordBatch]:
        """(query_id, unit_id, the score by ``name``), the queries by their ``ids``."""
        if self.found:
            self.weigh()
            q, score, units = self.found[0]
            for at in range(0, len(q), 1 << 16):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[at : at + (1 << 16)])), units.slice(at, 1 << 16), pa.array(score[at : at + (1 << 16)])], ["query_id", "unit_id", name])


def blocks(queries: DataFrame, k: int, *more: str) -> Iterator[list[tuple]]:
    """Queries (query_id, vector as an array, ``more``) in blocks of bounded size."""
    block, size = [], 0
    for q, v, *rest in queries.select("query_id", "vector", *more).toLocalIterator():
        block.append((q, np.array(v, np.float64), *rest))
        size += max(len(v), k)
        if size >= QUERY_FLOATS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _nearest(ids: list[int], queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit_rows(_matrix(part.column("vector"))).T
                for first in range(0, len(ids), PRODUCTS // 1024):
                    which = np.arange(first, min(first + PRODUCTS // 1024, len(ids)))
                    best.add(which, queries[which] @ x, part.column("unit_id"))
        yield from best.rows(pa.array(ids, pa.int64()))

    return run


def dense_top(units: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine top-k; ids of units are integers or strings. Queries are a stated set: they are read in blocks of bounded size, each block makes
    one pass over the vectors, and each task hands on its own k best, so the shuffle holds k rows a query and task. A task holds the products of
    1,024 queries and 1,024 vectors at a time, and what is best so far."""
    kind = "string" if dict(units.dtypes)["unit_id"] == "string" else "long"
    out, shape, rows = None, f"query_id long, unit_id {kind}, sim double", units.select(F.col("unit_id").cast(kind).alias("unit_id"), "vector")
    for block in blocks(queries, k):
        found = rows.mapInArrow(_nearest([q for q, _ in block], _unit_rows(np.array([v for _, v in block], np.float64)), k), shape)
        out = found if out is None else out.union(found)
    if out is None:
        return units.sparkSession.createDataFrame([], f"{shape}, rank long")
    return top(out, k, F.desc("sim"), F.col("unit_id"))


def fuse(vector: DataFrame, lexical: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; the similarity is carried from the vector list alone."""
    both = vector.select("query_id", "unit_id", "rank", F.col("sim").alias("semantic_score")).unionByName(lexical.select("query_id", "unit_id", "rank", F.lit(None).cast("double").alias("semantic_score")))
    fused = both.groupBy("query_id", "unit_id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 12).alias("fused"), F.max("semantic_score").alias("semantic_score"))
    return top(fused, k, F.desc("fused"), F.col("unit_id"))


def rerank(ranked: DataFrame, units: DataFrame, queries: DataFrame, k: int = 5, scorer: Scorer | None = None) -> DataFrame:
    """(query_id, unit_id, before, rerank_score, rank): ``ranked`` ordered anew, ties by the earlier rank.

    Without a ``scorer`` the score is the share of the query's distinct terms that the unit has; ``units`` may then be a
    :func:`lexical_index` for these queries. A scorer sees the texts of each pair that was ranked; a null score comes last."""
    wanted = units.join(ranked.select("unit_id").distinct(), "unit_id", "left_semi")  # ranked units alone
    rows = ranked.withColumnRenamed("rank", "before")
    if scorer:
        rows = rows.join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("asked_")), "query_id").join(wanted.select("unit_id", F.coalesce("text", F.lit("")).alias("shown_")), "unit_id")
        score = scorer(F.col("asked_"), F.col("shown_"))
    else:
        rows = rows.join(queries.select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("qt")), "query_id")
        rows = rows.join(wanted.select("unit_id", F.array_distinct(F.col("hits") if "hits" in units.columns else tx.tokens(F.col("text"))).alias("ut")), "unit_id")
        score = F.coalesce(F.try_divide(F.size(F.array_intersect("qt", "ut")).cast("double"), F.size("qt")), F.lit(0.0))
    return top(rows.select("query_id", "unit_id", "before", F.round(score, DIGITS).alias("rerank_score")), k, F.desc_nulls_last("rerank_score"), F.col("before"))


def gate(ranked: DataFrame, min_score: float = 0.60, min_top: float = 0.66, keep_at_least: int = 0, enabled: bool = True) -> DataFrame:
    """``ranked`` (query_id, unit_id, rank, semantic_score) with best, abstain, below, keep, passed and place.

    Without any similarity, or not ``enabled``, the gate abstains and passes all; with the best below ``min_top`` (``below``) it drops
    the whole query; else it drops units below ``min_score`` (a null similarity counts as 0), and where fewer than
    ``keep_at_least`` are left, keeps that many by similarity instead. ``passed``: something of the query is left.
    ``place`` orders what is kept: by rank, or by similarity where units were filled up."""
    w = Window.partitionBy("query_id")
    sim = F.coalesce("semantic_score", F.lit(0.0))
    rows = ranked.withColumn("best", F.max("semantic_score").over(w))
    abstain = F.col("best").isNull() if enabled else F.lit(True)
    rows = rows.withColumn("over_", sim >= min_score).withColumn("n_over_", F.count_if("over_").over(w))
    rows = rows.withColumn("by_sim_", F.row_number().over(w.orderBy(F.desc(sim), "rank")))
    below, few = ~abstain & (F.col("best") < min_top), F.col("n_over_") < keep_at_least
    rows = rows.withColumns({"abstain": abstain, "below": below, "keep": abstain | (~below & F.when(few, F.col("by_sim_") <= keep_at_least).otherwise(F.col("over_")))})
    place = F.when(~F.col("abstain") & few, F.col("by_sim_")).otherwise(F.col("rank"))
    return rows.withColumn("passed", F.max("keep").over(w)).withColumn("place", place).drop("over_", "n_over_", "by_sim_")


def gate_report(gated: DataFrame, min_score: float = 0.60, min_top: float = 0.66, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, kept, dropped, best, threshold, passed); a query whose best is below ``min_top`` reports that, all others ``min_score``.
    With ``queries`` (query_id), those without results have a row as well: nothing kept, none passed."""
    rows = gated.groupBy("query_id").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.max("best").alias("best"), F.bool_or("below").alias("below"))
    if queries is not None:
        rows = queries.select("query_id").distinct().join(rows, "query_id", "left").na.fill(0, ["kept", "dropped"])
    threshold = F.when(F.coalesce("below", F.lit(False)), min_top).otherwise(min_score)
    return rows.select("query_id", "kept", "dropped", F.round("best", 4).alias("best"), threshold.alias("threshold"), (F.col("kept") > 0).alias("passed"))


def gate_passages(gated: DataFrame) -> DataFrame:
    """Units that stay, ranks from 1 without gaps."""
    return top(gated.where("keep").withColumnRenamed("rank", "before"), 2**31 - 1, F.col("place"), F.col("before")).select("query_id", "unit_id", "rank")


RETRIEVERS = ("bm25", "vector", "hybrid")


def retrieve(units: DataFrame, queries: DataFrame, retriever: str = "hybrid", k: int = 5, reranked: bool = False, embedder: Embedder = vectors_of, scorer: Scorer | None = None) -> DataFrame:
    """(query_id, unit_id, rank, semantic_score) by name; a reranker (``reranked``, or a ``scorer``) gets 20 candidates, hybrid three times as many of each list."""
    reranked = reranked or scorer is not None
    fetch = 20 if reranked else k
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}")
    if retriever == "hybrid":
        found = fuse(sparse_top(units, queries, 3 * fetch, embedder), bm25(units, queries, 3 * fetch), fetch)
    else:
        found = bm25(units, queries, fetch) if retriever == "bm25" else sparse_top(units, queries, fetch, embedder)
        found = found.withColumn("semantic_score", F.lit(None).cast("double"))
    found = found.select("query_id", "unit_id", "rank", "semantic_score")
    return rerank(found, units, queries, k, scorer).select("query_id", "unit_id", "rank", F.lit(None).cast("double").alias("semantic_score")) if reranked else found
