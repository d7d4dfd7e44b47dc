"""Removal of repeated strings against counting them all."""

import hashlib
import random
from collections import Counter

from lodestone.llm import substring_buckets as sb


def brute(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 long").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:5] for r in sb.remove_repeats(docs).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i
    return got


def test_planted(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common = [text(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 300, "x" * 5000, text(3000)]
    for _ in range(40):
        parts = [text(rng.randrange(0, 400))]
        for _ in range(rng.randrange(4)):
            c = rng.choice(common)
            k = rng.randrange(len(c)) if rng.random() < 0.4 else 0
            parts += [c[k:], text(rng.randrange(0, 100))]
        texts.append("".join(parts))
    texts += [texts[9], texts[10], texts[10], texts[12][:350] + "!" + texts[12][350:], texts[8][100:900] * 2]
    got = check(spark, texts)
    assert sum(v[2] for v in got.values()) > 20


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a = text(1500)
    monkeypatch.setattr(sb, "STRETCH", 700)
    run = list(sb._runs([(a + text(900) + a).encode(), b"x" * 300]))
    assert len(run) > 5 and all(len(r[2]) <= 700 for r in run)
    seen = Counter()
    for docs, offsets, raw, ends in run:
        doc, first, last, *_ = sb.places(raw, ends)
        begins = [0, *ends[:-1]]
        for k, x, y in zip(doc, first, last, strict=True):
            seen.update((docs[k], int(i - begins[k] + offsets[k])) for i in range(x, y + 1))
    assert set(seen.values()) == {1}
    assert len(seen) == 3900 - 199 + 300 - 199


def test_driver_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in sb.op8_bucket_pointer(spark, sf).collect()}
    assert [got[r["doc_id"]] for r in docs] == brute([r["text"] for r in docs])


def test_empty_and_repeated_rows(spark):
    assert sb.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "word " * 20 + "q" * 90 + "w" * 30), (1, "word " * 20 + "q" * 90 + "w" * 30), (None, None), (None, "z" * 150)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["n_bytes"]) for r in sb.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 0, 150), (1, 220, 220), (1, 220, 220)]


def test_many_repeated_rows(spark):
    """Rows equal in id and text: each loses all, a text's spans are listed once, a text that shares a part loses that part."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(500)) + text[700:1300]
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.union(spark.createDataFrame([(7, other)], "doc_id long, text string"))
    assert sb.repeated_spans(docs).select(F.max(F.size("spans"))).first()[0] < 600
    got = {tuple(r)[:4]: r["n"] for r in sb.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 3000, 3000, 1): 2000, (7, 1100, 600, 1): 1}
