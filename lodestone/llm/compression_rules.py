"""Quality rules: word and line counts, then compression bands.

A narrow pass: every document is judged alone, so nothing is shuffled. zstandard ratios of the
whole text and of fixed chunks are held against limits that depend on the length measured: short
texts compress little whatever they say, long ones share much with themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW, CHUNK, LEVEL = 8, 4096, 3
#: (bytes up to, least ratio, most ratio): below is repetitive, above incompressible. The last holds for all longer texts.
#: Measured on texts labelled good (sf0.1) and on cuts of them. Least ratios are about 15 % below the least of these,
#: above 2,048 bytes more than a third, as prose of few stems (0.27 at 6 KB) is to stay. Most ratios are between their
#: greatest and the least of random printable ASCII. Up to 80 bytes zstandard stores prose and noise alike as they are,
#: so there only repetition can be told.
BANDS = (
    (96, 0.6, 1.06), (128, 0.56, 1.0), (192, 0.53, 0.96), (256, 0.5, 0.9), (384, 0.48, 0.85), (512, 0.46, 0.8), (1024, 0.42, 0.74),
    (2048, 0.39, 0.66), (4096, 0.28, 0.6), (16384, 0.26, 0.58), (65536, 0.24, 0.58), (float("inf"), 0.2, 0.58),
)
STORED = 80
#: Share of chunks that may fall outside the band before the text is rejected.
BAD_CHUNKS = 0.25
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long"


def in_band(n: int, ratio: float) -> bool:
    low, high = next((low, high) for upto, low, high in BANDS if n <= upto)
    return low <= ratio and (ratio <= high or n <= STORED)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    count, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def judge(text: str | None) -> tuple:
    """The columns of COLUMNS for one text; null and empty texts have no words and fail the base rule."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line.encode().split():
            dup_lines += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
    ratio = len(squeeze(raw)) / len(raw) if raw else 0.0
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
    bad = sum(not in_band(len(c), len(squeeze(c)) / len(c)) for c in chunks)
    fine = bool(raw) and in_band(len(raw), ratio) and bad <= BAD_CHUNKS * len(chunks)
    spaces = sum(text.count(c) for c in SPACES)
    return n, len(text) - spaces, sum(text.count(c) for c in SYMBOLS), dup_lines, repeats, failed, fine and not failed, len(raw), ratio, len(chunks), bad


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        for part in slices(batch):
            columns = zip(*(judge(t) for t in part.column("text").to_pylist()), strict=True)
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, *names])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and the verdict columns, a row for each row of ``docs``, repeated rows too. No rows give none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judged, "doc_id long, " + COLUMNS)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield part.filter(pa.array([judge(t)[6] for t in part.column("text").to_pylist()], pa.bool_()))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    return docs.mapInArrow(_kept, docs.schema)


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
