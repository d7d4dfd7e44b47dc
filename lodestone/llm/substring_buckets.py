"""Removal of repeated 200-byte strings by bucket-pointer refinement.

Suffixes are put in buckets by their first bytes, and a bucket is refined by the bucket identifiers
at later offsets: an identifier of 2L bytes is made from those of L bytes at i and i + L, and each
level reuses the one below (1, 2, 4 .. 128, then 200 from two of 128). Identifiers are 64-bit
values of the content, so tasks agree on them without an exchange; what has to be exchanged is
which buckets hold more than one place. Levels up to 64 bytes are worked out for all places where they
are; from there on buckets with one place leave at each step (and no suffix is sorted: only equality is
asked). What is removed agreed in two 64-bit identifiers at least; bytes aren't compared again:

1. Every 200-byte string belongs to one place inside it, the least 64-byte bucket among its 137
   (about one place in 69). Equal strings have equal places. Buckets met once in the corpus are done.
2. A shared bucket is split by the whole stretch its strings cover. Places with an equal stretch
   repeat each other: all their strings are repeated. If all places of a bucket fall in one such
   class, nothing else can match and it is done.
3. Where a bucket holds several classes (the edges of copied passages), one member for each class is
   taken apart into runs of 16 starts. A run's bucket is the 185 bytes all its strings share, its
   class their whole stretch; it is refined as in 2.
4. What is left is taken apart into single strings, whose bucket is all their 200 bytes.

Copies, however many, cost a row for each place and never a pair; the counts combine before they
are shuffled, and the joins are plain equi-joins that Spark can split where a key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, discard, materialise, row_key, slices, table

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Bytes looked at at once; places take 20 bits.
STRETCH = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(8).integers(0, 1 << 64, 256, np.uint64)


def join_ids(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifier of the concatenation of what x and y identify."""
    z = x * _A
    z += y
    z ^= z >> np.uint64(32)
    z *= _B
    z ^= z >> np.uint64(29)
    return z


def levels(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of all runs of 64 and of 128 bytes (for 200 bytes at least)."""
    ids, at, short = _BYTES[raw], 1, None
    while at < 128:
        ids = join_ids(ids[:-at], ids[at:])
        at *= 2
        if at == GRAM:
            short = ids
    return short, ids


def places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, place, bucket, stretch id) of each place; ``raw`` holds
    documents on end, ``ends`` where each stops. Starts of a place are consecutive."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    short, long = levels(raw)
    low = np.uint64((1 << 20) - 1)
    least = (short & ~low) | np.arange(len(short), dtype=np.uint64)
    wide = 1
    while wide * 2 <= WINDOW:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: len(raw) - LENGTH + 1], least[WINDOW - wide :])
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), np.maximum(0, ends - begins - LENGTH + 1))
    sizes = np.maximum(0, ends - begins - LENGTH + 1)
    s = np.arange(len(doc)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    if not len(s):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = (least[s] & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero((np.diff(p) != 0) | (np.diff(doc) != 0)) + 1])
    last = np.concatenate([first[1:], [len(s)]]) - 1
    a, b, p, doc = s[first], s[last], p[first], doc[first]
    stretch = join_ids(join_ids(long[a], long[a + 72]), join_ids(long[b], long[b + 72]))
    stretch = join_ids(stretch, ((p - a) << 8 | (p - b)).astype(np.uint64))
    return doc, a, b, p, short[p], stretch


def _runs(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Stretches of about STRETCH bytes: documents in them, the offset of each piece, bytes, ends. A long
    document comes in pieces that overlap by LENGTH - 1, so each of its strings lies in one piece."""
    docs, offsets, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), STRETCH - LENGTH + 1):
            piece = t[at : at + STRETCH]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > STRETCH and held:
                yield docs, offsets, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])
                docs, offsets, held, size = [], [], [], 0
            docs.append(i)
            offsets.append(at)
            held.append(piece)
            size += len(piece)
    if held:
        yield docs, offsets, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])


PLACES = "k1 long, k2 long, a int, b int, p int, bucket long, stretch long"
PARTS = "k1 long, k2 long, a int, b int, p int, core1 long, core2 long, whole long"
RUN = 16


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
            for docs, offsets, raw, ends in _runs(byte_texts(part.column("text"))):
                doc, a, b, p, bucket, stretch = places(raw, ends)
                row = np.array(docs)[doc]
                shift = (np.array(offsets) - np.concatenate([[0], ends[:-1]]))[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32)), pa.array((p + shift).astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(stretch.view(np.int64))],
                    ["k1", "k2", "a", "b", "p", "bucket", "stretch"],
                )


def parts(short: np.ndarray, long: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """Starts a..b of places p in runs of at most ``run`` by their distance to the place: first and last start,
    which range, two independent identifiers of the bytes a full run shares, one of the run's stretch."""
    low, high = (p - b) // run, (p - a) // run
    of = np.repeat(np.arange(len(a)), high - low + 1)
    block = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    first, last, core = np.maximum(a[of], p[of] - run * block - run + 1), np.minimum(b[of], p[of] - run * block), p[of] - run * block
    size = LENGTH - run + 1
    one = join_ids(long[core], long[core + size - 128])
    two = join_ids(join_ids(short[core], short[core + 64]), join_ids(short[core + size - 128], short[core + size - 64]))
    whole = join_ids(join_ids(long[first], long[first + 72]), join_ids(long[last + 72], ((core - first) << 8 | (core - last)).astype(np.uint64)))
    return first, last, of, one, two, whole


def _parts(run: int):
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
                for i, (t, ranges) in enumerate(zip(byte_texts(part.column("text")), part.column("ranges").to_pylist(), strict=True)):
                    a, b, p = np.unique(np.array([(r["a"], r["b"], r["p"]) for r in ranges], np.int64), axis=0).T
                    raw = np.frombuffer(t, np.uint8)
                    for at in range(0, len(raw) - LENGTH + 1, STRETCH - 2 * LENGTH):
                        some = (a >= at) & (a < at + STRETCH - 2 * LENGTH)
                        if not some.any():
                            continue
                        first, last, of, one, two, whole = parts(*levels(raw[at : at + STRETCH]), a[some] - at, b[some] - at, p[some] - at, run)
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(pa.array(np.full(len(first), k[i])) for k in (k1, k2)),
                                *(pa.array((x + at).astype(np.int32)) for x in (first, last, (p[some] - at)[of])),
                                *(pa.array(x.view(np.int64)) for x in (one, two, whole)),
                            ],
                            [c.split()[0] for c in PARTS.split(", ")],
                        )

    return apart


def keep_mask(n: int, spans: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Which of n bytes stay, and how many runs of them go."""
    step = np.zeros(n + 1, np.int32)
    if spans:
        ab = np.array(spans, np.int64)
        np.add.at(step, ab[:, 0], 1)
        np.add.at(step, ab[:, 1], -1)
    gone = np.cumsum(step[:-1]) > 0
    return ~gone, int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows, kept = [], []
            for t, spans in zip(byte_texts(part.column("text")), part.column("spans").to_pylist(), strict=True):
                stay, runs = keep_mask(len(t), [(x["a"], x["b"]) for x in spans or []])
                left = np.frombuffer(t, np.uint8)[stay].tobytes() if runs else t
                rows.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
                kept.append(left)
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def refine(held: DataFrame, core: list[str], whole: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """(ranges of starts that are repeated as a whole, one member of each class of cores that have several classes)."""
    member = F.struct("k1", "k2", "a", "b", "p")
    classes = materialise(held.groupBy(*core, *whole).agg(F.count("*").alias("n"), F.min(member).alias("one")), tag)
    copied = held.join(classes.where("n > 1").select(*core, *whole), [*core, *whole], "left_semi").select("k1", "k2", "a", (F.col("b") + LENGTH).alias("b"))
    several = classes.groupBy(*core).count().where("count > 1").select(*core)
    return copied, classes.join(several, core, "left_semi").select("one.*")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans): byte ranges covered by strings of LENGTH bytes that start at two places or more."""
    rows = docs.select(*row_key(docs["doc_id"], docs["text"]), "text").where(F.octet_length("text") >= LENGTH)
    found = materialise(rows.mapInArrow(_places, PLACES), "places")
    again = materialise(found.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    held = materialise(found.join(again, "bucket", "left_semi"), "shared")
    discard(found, again)
    copied, edge = refine(held, ["bucket"], ["stretch"], "classes")
    spans = materialise(copied, "spans")
    for run in (RUN, 1):
        ranges = edge.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "p")).alias("ranges"))
        apart = materialise(rows.join(ranges, ["k1", "k2"]).mapInArrow(_parts(run), PARTS), "parts")
        copied, edge = refine(apart, ["core1", "core2"], ["whole"], "classes")
        spans = spans.union(materialise(copied, "spans"))
    # equal rows found the same spans: each once, so that a text's list is bounded by the text
    return materialise(spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: its text as UTF-8 bytes without
    those covered by a string of 200 bytes that also starts anywhere else in the table.

    Null counts as empty; shorter texts stay whole; a repeated row repeats all its strings, so both
    lose them; an empty table gives no rows. kept may end inside a character."""
    spans = repeated_spans(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs["doc_id"], docs["text"]), "text")
    both = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
