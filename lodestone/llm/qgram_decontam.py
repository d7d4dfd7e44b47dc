"""Benchmark decontamination by q-gram lemma filtering.

A region of a text within e edits of an item of m characters shares at least m - q + 1 - q*e of
its q-grams, and they lie on diagonals (text place minus item place) at most e apart. Shared
q-grams are counted in overlapping bands of diagonals; in bands that reach the bound the item is
aligned, over the band's diagonals and e to either side alone. Texts are gone through in stretches
and pairs of places in runs, so that memory doesn't grow with how often a q-gram repeats.

Items are the stated query set: they are read in blocks of bounded size, and each block's q-grams
(size proportional to the block) go with one narrow pass over all texts. No document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, slices, table

Q, EDIT_RATE = 8, 0.1
#: Characters of items that one pass over the texts carries.
BLOCK_CHARS = 4 << 20
#: Characters of a text looked at together, pairs of places met at once, diagonals aligned at once (a band may be wider).
STRETCH, PAIRS, WIDEST = 1 << 16, 1 << 19, 4096
_SIEVE_BITS, _FAR = 22, 1 << 33


def normalise(text: str | None) -> str:
    """Lower case, each run of white space one blank."""
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray) -> np.ndarray:
    """One 64-bit value for each window of Q characters: a byte of each, so equal windows have equal values."""
    low = ((points ^ (points >> 8) ^ (points >> 13)) & 0xFF).astype(np.uint64)
    n = max(0, len(points) - Q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out |= low[i : i + n] << np.uint64(8 * i)
    return out


def _spread(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)


def budget(m: int) -> int:
    """Most edits for an item of m characters; lower for short items so that the bound stays above zero."""
    return max(0, min(int(m * EDIT_RATE), (m - Q) // Q if m >= Q else 0))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits (start, end, edits) of the whole item against a part of ``text``, if at most ``most``, over the
    diagonals (text place minus item place) low to high alone: a row of their costs for each character of the item."""
    low, high = max(low, -len(item)), min(high, len(text))
    diagonal = np.arange(low, high + 1)
    wide, far = len(diagonal), most + 1
    if not wide:
        return None
    none = np.full(max(0, -low), 0xFFFFFFFF, text.dtype)
    a = max(0, low)
    held = np.concatenate([none, text[a : high + len(item)], np.full(max(0, high + len(item) - len(text)), 0xFFFFFFFF, text.dtype)])
    ramp = np.arange(wide)
    row, origin = np.where(diagonal < 0, far, 0), diagonal.copy()
    for i, c in enumerate(item, 1):
        change = row + (held[i - 1 : i - 1 + wide] != c)
        drop = np.append(row[1:] + 1, far)
        better = change <= drop
        cost, begun = np.where(better, change, drop), np.where(better, origin, np.append(origin[1:], 0))
        # a run of added characters: the least cost - place so far, carried on
        at = np.minimum.accumulate((cost - ramp) * (wide + 1) + ramp) % (wide + 1)
        row, origin = np.minimum(cost[at] - at + ramp, far), begun[at]
        row[: max(0, -low - i)] = far
        row[max(0, len(text) - i - low + 1) :] = far
        if row.min() > most:
            return None
    end = int(np.argmin(row))
    return int(origin[end]), int(diagonal[end]) + len(item), int(row[end])


class Items:
    """A block of items and its q-gram index."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(k, t) for k, x in rows if (t := normalise(x))]
        self.ids = [k for k, _ in kept]
        self.points = [codes(t) for _, t in kept]
        self.texts = [t for _, t in kept]
        self.sizes = np.array([len(p) for p in self.points], np.int64)
        self.budgets = np.array([budget(n) for n in self.sizes], np.int64)
        self.need = np.maximum(1, self.sizes - Q + 1 - Q * self.budgets)
        self.short = [(k, t) for k, t in kept if len(t) < Q]
        by = [grams(p) for p in self.points]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *by])
        self.item = np.repeat(np.arange(len(by)), [len(g) for g in by])
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in by)])
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.values, self.first, self.times = np.unique(self.gram, return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[_spread(self.values)] = True

    def bands(self, at: np.ndarray, k: np.ndarray, open_: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of bands whose shared q-grams reach the bound. at, k: places of a stretch
        of text and the q-gram at each; open_: items still looked for.

        Diagonals are counted in cells of budget + 1, a band is two neighbouring cells: any span within the budget lies
        in one. Pairs of places are met PAIRS at a time; what is held are counts by cell."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.times[k])
        a = 0
        while a < len(k):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            times = self.times[k[a:b]]
            many = np.repeat(np.arange(a, b), times)
            entry = self.first[k[many]] + np.arange(len(many)) - np.repeat(np.cumsum(times) - times, times)
            mine = open_[self.item[entry]]
            entry, many = entry[mine], many[mine]
            item = self.item[entry]
            cell = (at[many] - self.place[entry] + _FAR) // (self.budgets[item] + 1)
            found, seen = np.unique(item << 34 | cell, return_counts=True)
            merged, which = np.unique(np.concatenate([keys, found]), return_inverse=True)
            keys, counts = merged, np.bincount(which, np.concatenate([counts, seen]), len(merged)).astype(np.int64)
            a = b
        next_ = np.append(np.where(np.diff(keys) == 1, counts[1:], 0), 0)[: len(keys)]
        item, cell = keys >> 34, keys & ((1 << 34) - 1)
        reach = np.flatnonzero(counts + next_ >= self.need[item])
        step = self.budgets[item[reach]] + 1
        low = cell[reach] * step - _FAR
        return list(zip(item[reach].tolist(), low.tolist(), (low + 2 * step - 1).tolist(), strict=True))

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, start, end, edits, item characters) in the normalised text: the best place of each item.

        The text is gone through in stretches that overlap by the longest match, so each match lies in one."""
        clean = normalise(text)
        points = codes(clean)
        best: dict[int, tuple] = {}
        g = grams(points)
        if len(self.values) and len(g):
            at = np.flatnonzero(self.sieve[_spread(g)])
            k = np.minimum(np.searchsorted(self.values, g[at]), len(self.values) - 1)
            hit = self.values[k] == g[at]
            at, k, least = at[hit], k[hit], self.need.min()
            open_ = np.ones(len(self.need), bool)
            overlap = int((self.sizes + self.budgets).max())
            wide = max(STRETCH, 2 * overlap)
            for begin in range(0, len(points), wide - overlap):
                x, y = np.searchsorted(at, [begin, begin + wide])
                if y - x >= least and open_.any():
                    self._verify(clean, points, self.bands(at[x:y], k[x:y], open_), best, open_)
        for k, t in self.short:
            if clean and f" {t} " in f" {clean} ":
                p = f" {clean} ".index(f" {t} ")
                best[-1 - k] = (k, p, p + len(t), 0, len(t))
        return list(best.values())

    def _verify(self, clean: str, points: np.ndarray, bands: list[tuple[int, int, int]], best: dict[int, tuple], open_: np.ndarray) -> None:
        """Align the items of ``bands``, overlapping ones of an item at once while they are narrow; exact items are done."""
        joined: list[list[int]] = []
        for i, low, high in bands:
            if joined and joined[-1][0] == i and low <= joined[-1][2] and high - joined[-1][1] < WIDEST:
                joined[-1][2] = high
            else:
                joined.append([i, low, high])
        for i, low, high in joined:
            m, e = len(self.points[i]), int(self.budgets[i])
            if not open_[i]:
                continue
            if (whole := clean.find(self.texts[i], max(0, low - e), max(0, high + e + m))) >= 0:
                best[i], open_[i] = (self.ids[i], whole, whole + m, 0, m), False
                continue
            got = align(self.points[i], points, low - e, high + e, e)
            if got and (i not in best or got[2] < best[i][3]):
                best[i] = (self.ids[i], *got, m)


def _matched(blocks: list[tuple[int, str]]):
    held: list[Items] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Items(blocks))
        for batch in batches:
            for part in slices(batch):
                keep = [c for c in part.schema.names if c != "text"]
                found = [(r, *m) for r, t in enumerate(part.column("text").to_pylist()) for m in held[0].matches(t)]
                rows = pa.array([f[0] for f in found], pa.int64())
                more = [pa.array([f[j] for f in found], pa.int64()) for j in range(1, 6)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in keep), *more], [*keep, "item_id", "start", "end", "edits", "item_chars"])

    return run


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.where("text is not null").select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = "item_id long, start long, end long, edits long, item_chars long"


def contaminated(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, k1, k2, item_id, start, end, edits, item_chars): each item's best place in each text that holds it.

    An item occurs where a part of the normalised text is within a tenth of its characters in edits.
    Null and empty texts and items match nothing; repeated rows are all reported; items shorter than
    a q-gram match as whole words; empty tables give no rows. start and end count code points of the
    normalised text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs["doc_id"], docs["text"]), "text")
    shape = "doc_id long, k1 long, k2 long, " + MATCHES
    out = docs.sparkSession.createDataFrame([], shape)
    for n, block in enumerate(_blocks(items, block_chars)):
        found = rows.mapInArrow(_matched(block), shape)
        out = found if not n else out.union(found)
    return out


def _clean(block: list[tuple[int, str]]):
    held: list[Items] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Items(block))
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([not held[0].matches(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged; a pass for each block of items."""
    for block in _blocks(items, block_chars):
        docs = docs.mapInArrow(_clean(block), docs.schema)
    return docs


def op7_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(c.split()[0] for c in MATCHES.split(", ")))
