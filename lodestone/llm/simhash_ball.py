"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some value lies within r bits of
both. So each distinct fingerprint emits all values within half the radius, the values are
brought together, and fingerprints that meet in a value are linked.

A row for each of the 2,081 values (radius 4) would move about 16 times the input. The shuffle
therefore keys on the leading ``p`` bits of a value: a fingerprint is sent once to each prefix
within two bits of its own (37 for p = 8), and the rest of the value is filled in where it
arrives. Each value is still formed and compared; only its low bits don't travel. p grows with
the number of distinct fingerprints, so a bucket stays at about ``bucket_values`` values.

All fingerprints that meet in one value are within the radius of each other, so a chain through
them, not all pairs, keeps every link; chains are joined within the bucket before they leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, materialise, row_key, slices, table

SHINGLE_WORDS, SEED, BITS = 4, 42, 64
RUN = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of a UTF-8 text: 4-word shingles, repeats included, XXH64 with seed 42; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))  # of each word, after a first at -1
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    width = min(SHINGLE_WORDS, len(words))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, RUN):
        stop = min(n, at + RUN)
        hashes = np.array([digest(joined[a + 1 : b], SEED) for a, b in zip(ends[at:stop], ends[at + width : stop + width], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = np.array([fingerprint(t) for t in byte_texts(part.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(found)], ["doc_id", "k1", "k2", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fp) of each row; null text counts as empty, whose fingerprint is 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(docs["doc_id"], docs["text"]), F.col("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, k1 long, k2 long, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For j = 0..most: all masks of ``bits`` low bits with at most j ones."""
    by = [np.array([sum(1 << b for b in c) for c in combinations(range(bits), j)], dtype=np.uint64) for j in range(most + 1)]
    return [np.concatenate(by[: j + 1]) for j in range(most + 1)]


def prefix_bits(n: int, half: int, bucket_values: int) -> int:
    """Smallest p from 8 on at which 2^p buckets hold ``bucket_values`` values each at most."""
    ball = sum(len(list(combinations(range(BITS), j))) for j in range(half + 1))
    p = 8
    while p < 30 and n * ball > bucket_values << p:
        p += 1
    return p


def _to_buckets(p: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flips(p, half)[half]
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            for at in range(0, len(fp), max(1, (1 << 21) // len(masks))):
                some = fp[at : at + max(1, (1 << 21) // len(masks))]
                bucket = ((some >> np.uint64(BITS - p))[None, :] ^ masks[:, None]).ravel()
                order = np.argsort(bucket, kind="stable")
                bucket, held = bucket[order], np.tile(some, len(masks))[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate([[0], cuts])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array([x.tobytes() for x in np.split(held, cuts)], pa.binary())], ["bucket", "fps"])

    return run


def chain_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n indices by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links_in_bucket(bucket: int, fps: np.ndarray, p: int, half: int, at_once: int = 1 << 22) -> np.ndarray:
    """Links (fingerprint, smallest linked one) from values of this bucket that several fingerprints share."""
    low = BITS - p
    masks = flips(low, half)
    far = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(bucket))
    tails, key = fps & np.uint64((1 << low) - 1), []
    total = sum(int((far == j).sum()) * len(masks[half - j]) for j in range(half + 1))
    rounds = 1 << max(0, (total // at_once)).bit_length()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for turn in range(rounds):
        values, owners = [], []
        for j in range(half + 1):
            own = np.flatnonzero(far == j)
            for at in range(0, len(own), 2048):
                some = own[at : at + 2048]
                v = (tails[some][:, None] ^ masks[half - j][None, :]).ravel()
                o = np.repeat(some, len(masks[half - j]))
                if rounds > 1:
                    keep = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(rounds) == np.uint64(turn)
                    v, o = v[keep], o[keep]
                values.append(v)
                owners.append(o)
        if not values:
            continue
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        met = np.flatnonzero(v[1:] == v[:-1])
        if len(met):
            key = np.unique(o[met] * len(fps) + o[met + 1])
            a.append(key // len(fps))
            b.append(key % len(fps))
    a, b = np.concatenate(a), np.concatenate(b)
    label = chain_labels(len(fps), a, b)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[moved], fps[label[moved]]]) if len(moved) else np.zeros((2, 0), np.uint64)


def _bucket_links(p: int, half: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fps = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("fps").to_pylist()]))
        a, b = links_in_bucket(key[0].as_py(), fps, p, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def ball_links(fps: DataFrame, radius: int = 4, bucket_values: int = 2_000_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (one long column ``fp``) whose closure is that of all pairs within ``radius`` bits."""
    spark, half = fps.sparkSession, (radius + 1) // 2
    p = prefix_bits(fps.count(), half, bucket_values)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = fps.mapInArrow(_to_buckets(p, half), "bucket long, fps binary").repartition(parts, "bucket")
    return met.groupBy("bucket").applyInArrow(_bucket_links(p, half), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable from each vertex of ``links``, by rounds of
    least neighbouring label and pointer jumping; each round is a written table."""
    both = materialise(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    while True:
        by = labels.select(F.col("v").alias("u"), F.col("label").alias("near"))
        near = both.join(by, "u").groupBy("v").agg(F.min("near").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = materialise(lower.join(jump, "label", "left").select("v", "was", F.coalesce("far", "label").alias("label")), "labels")
        if new.where("was <> label").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, k1, k2, fp, component_id): the smallest doc_id linked to each row, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null
    doc_id take part; a component of such rows alone has a null id. An empty table gives no rows."""
    if radius % 2:
        raise ValueError("the radius is even: values within half of it are met")
    fps = materialise(fingerprints(docs), "fingerprints")
    by = materialise(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    labels = components(ball_links(by.select("fp"), radius))
    rooted = materialise(by.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp")).drop("label"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    placed = join_hot(rooted.drop("least"), least, "root", "m")
    return join_hot(fps, placed, "fp", "n").select("doc_id", "k1", "k2", "fp", "component_id", "root")


#: A key with more than one in HOT of all rows is hot: there are fewer than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, by: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined to ``by``, which has each ``key`` once with ``n``, how many rows have it. The rows of hot keys, fewer
    than HOT keys, meet theirs where they are; only the others are dealt by key."""
    limit = max(HOT, (by.agg(F.sum(n)).first()[0] or 0) // HOT)
    hot, rest = F.broadcast(by.where(F.col(n) > limit)), by.where(F.col(n) <= limit)
    return rows.join(hot, key).drop(n).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key).drop(n))


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id (nulls last, then by text key)."""
    found = near_duplicates(docs, radius)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("k1"), F.col("k2"))
    stay = found.groupBy("root").agg(F.min(order).alias("s")).select(F.col("s.k1").alias("k1"), F.col("s.k2").alias("k2"))
    k1, k2 = row_key(docs["doc_id"], docs["text"])
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("r"), k1, k2)
    once = keyed.join(stay, ["k1", "k2"], "left_semi")
    return once.groupBy("k1", "k2").agg(F.first("r").alias("r")).select("r.*")  # of equal rows one, picked before they are dealt


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
