"""Chunkers: documents (doc_id, text) to rows (chunk_id, doc_id, char_start, char_end, content, token_count, strategy)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import word_hashes

SHAPE = "doc_id long, char_start int, char_end int, content string"
#: Where texts are cut, in turn (line starts before a heading, blank lines, ends of sentences), and what parts sentences.
_BREAKS = (re.compile(r"^(?=#{1,6}\s)", re.M), re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+"))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def _finish(rows: DataFrame, strategy: str) -> DataFrame:
    rows = rows.where(F.col("content").rlike(r"(?U)\S"))
    return rows.select(tx.chunk_id(F.col("doc_id"), F.col("char_start"), F.col("char_end"), strategy).alias("chunk_id"), "doc_id", "char_start", "char_end", "content", tx.count_tokens(F.col("content")).alias("token_count"), F.lit(strategy).alias("strategy"))


def fixed(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the last, until one reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    step, n = size - overlap, F.char_length("text")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int"))).alias("k")
    rows = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text", n.alias("n"), at).withColumn("char_start", F.col("k") * step)
    rows = rows.withColumn("char_end", F.least(F.col("char_start") + size, F.col("n")))
    return _finish(rows.withColumn("content", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))), "fixed")


def _per_text(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]], strategy: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, a, b, t[a:b]) for d, t in zip(batch.doc_id, batch.text, strict=True) if t for a, b in spans(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "char_start", "char_end", "content"])

    return _finish(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SHAPE), strategy)


def split_ranges(text: str, ranges: np.ndarray, boundary: re.Pattern, size: int) -> np.ndarray:
    """``ranges`` (start, end) with those longer than ``size`` cut after each place that ``boundary`` matches in them."""
    long = ranges[:, 1] - ranges[:, 0] > size
    cuts = [m.end() for a, b in ranges[long].tolist() for m in boundary.finditer(text, a, b)]
    edges = np.unique(np.concatenate([ranges.ravel(), np.array(cuts, np.int64)]))
    return np.stack([edges[:-1], edges[1:]], axis=1)


def hard_cut(ranges: np.ndarray, size: int, step: int) -> np.ndarray:
    """``ranges`` with those longer than ``size`` as windows of ``size``, each ``step`` after the last."""
    length = ranges[:, 1] - ranges[:, 0]
    times = np.where(length > size, -(-length // step), 1)
    of = np.repeat(np.arange(len(ranges)), times)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    start = ranges[of, 0] + nth * step
    return np.stack([start, np.where(times[of] > 1, np.minimum(start + size, ranges[of, 1]), ranges[of, 1])], axis=1)


def join_ranges(ranges: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Neighbours joined from the left while they fit in ``size``. A range may end before its predecessor, a window's tail."""
    starts, ends, out, at = ranges[:, 0].tolist(), ranges[:, 1], [], 0
    reach = np.maximum.accumulate(ends)
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(reach, starts[at] + size, side="right")))
        out.append((starts[at], int(ends[at:upto].max())))
        at = upto
    return out


def recursive_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` characters: passes over all ranges cut those too long at headings, then at blank lines,
    then at sentences, then anywhere; what fits together is joined again. Separators stay on the left."""
    ranges = np.array([[0, len(text)]], np.int64)
    for boundary in _BREAKS:
        ranges = split_ranges(text, ranges, boundary, size)
    return join_ranges(hard_cut(ranges, size, size - overlap), size) if text else []


def recursive(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    return _per_text(docs, lambda t: recursive_spans(t, size, overlap), "recursive")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Ranges of sentences, what stands between them left out; blank ones dropped."""
    gaps = [m.span() for m in _SENTENCE.finditer(text)]
    ranges = zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)], strict=True)
    return [(a, b) for a, b in ranges if text[a:b].strip()]


def semantic_spans(text: str, embed: Callable[[list[str]], list[list[float]]], threshold: float, size: int, least: int) -> list[tuple[int, int]]:
    """Runs of sentences; a new one starts when the next sentence is unlike the run's mean vector and the run is long
    enough, or when the run would grow too long. Means come from sums up to each sentence, so that all places where a
    run might end are weighed at once."""
    spans = np.array(sentence_spans(text), np.int64).reshape(-1, 2)
    if len(spans) < 2:
        return [(0, len(text))]
    vectors = np.asarray(embed([text[a:b] for a, b in spans.tolist()]), np.float64)
    upto = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    norms, first, out = np.linalg.norm(vectors, axis=1), 0, []
    while first < len(spans):
        start = spans[first, 0]
        # the run is over at the latest where it would be too long
        stop = max(first + 1, int(np.searchsorted(spans[:, 1], start + size, side="right")))
        mean = upto[first + 1 : stop] - upto[first]
        scale = np.sqrt(np.einsum("ij,ij->i", mean, mean)) * norms[first + 1 : stop]
        like = np.divide(np.einsum("ij,ij->i", mean, vectors[first + 1 : stop]), scale, out=np.zeros(len(scale)), where=scale > 0)
        over = np.flatnonzero((np.round(like, 9) < threshold) & (spans[first : stop - 1, 1] - start >= least))
        last = first + int(over[0]) if len(over) else stop - 1
        out.append((int(start), int(spans[last, 1])))
        first = last + 1
    return out


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """A row of bucket counts for each text, at length one (zero without words): lower-case words by the last bits of their md5."""
    words = [t.lower().split() for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    bucket = (word_hashes([w for ws in words for w in ws]) % np.uint64(dim)).astype(np.int64)
    counts = np.bincount(row * dim + bucket, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300)


def semantic(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hash_embed, threshold: float = 0.62, size: int = 1200, least: int = 200) -> DataFrame:
    return _per_text(docs, lambda t: semantic_spans(t, embed, threshold, size, least), "semantic")


CHUNKERS = {"fixed": fixed, "recursive": recursive, "semantic": semantic}


def chunk(docs: DataFrame, name: str, **how) -> DataFrame:
    """Chunk by name; the semantic chunker takes no size or overlap from a configuration."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}")
    return semantic(docs, **{k: v for k, v in how.items() if k == "embed"}) if name == "semantic" else CHUNKERS[name](docs, **how)
