"""Wavelet shards against the library's ids, and q-gram filtering against plain edit distance."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lodestone.llm import qgram_decontam as qd
from lodestone.llm import wavelet_tokens as wt

ODD = ["", None, " ", "\n", "a", " a", "a ", "a\n", "a \nb", "a\n b", "a \n b", "a  b", "a\n\nb", "a\n \nb", "\n\n\n", "x\ty", "it's they'll", "<|endoftext|> x", "é ü", "日本 語", "a b", "Ġ Ġx", " \n", "end  ", "a\r\nb", "1234 5.6%", "\x1c x", "😀 \n😀"]


def library(texts):
    tok = Tokenizer.from_file(wt.tokenizer_path())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_library(spark, sf):
    rng = random.Random(1)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    texts += ["".join(rng.choice("ab é1.,'\n  \tĠ<|>") for _ in range(rng.randrange(40))) for _ in range(3000)]
    own = wt.Encoder(wt.tokenizer_path())
    for got, want in zip(own.encode(texts), library(texts), strict=True):
        assert got.tolist() == want
    monkey = wt.REMEMBER
    wt.REMEMBER = 50
    try:
        for at in range(0, len(texts), 100):
            assert [x.tolist() for x in own.encode(texts[at : at + 100])] == library(texts[at : at + 100])
    finally:
        wt.REMEMBER = monkey


def test_marks_are_remembered_apart():
    """Marks after a letter or digit are pieces of their own, so words with and without them share what is remembered."""
    rng = random.Random(3)
    texts = ["word, word. word! (word) word's, word'll. it.s 2.0. 2,5! a_b_ x'. é, ê) ß- ٣. 日. <|endoftext| a\nword,\nword.\n.\n,a"]
    texts += ["".join(rng.choice("aé9٣日ʼ'.,!<_-|>$ \n\0") for _ in range(rng.randrange(60))) for _ in range(4000)]
    own = wt.Encoder(wt.tokenizer_path())
    for got, want, text in zip(own.encode(texts), library(texts), texts, strict=True):
        assert got.tolist() == want, text
    assert "word" in own.known and not {"word,", "word.", "word!", "2.0."} & set(own.known)


def test_pieces_in_use_stay(monkeypatch):
    """Pieces that batch after batch uses are encoded once, however many others pass by; what is remembered stays bounded."""
    monkeypatch.setattr(wt, "REMEMBER", 200)
    own, learned = wt.Encoder(wt.tokenizer_path()), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    often = [f"often{i}" for i in range(40)]
    for n in range(60):
        texts = [" ".join(["x", *often]), " ".join(f"rare{n}x{i}" for i in range(50))]
        assert [x.tolist() for x in own.encode(texts)] == library(texts)
        assert len(own.known) <= 200 + 52 + 40
    assert all(learned.count(p) == 1 for p in often)


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n, high in ((0, 5), (1, 1), (7, 2), (5000, 300), (200_000, 50_000)):
        ids = np.minimum(rng.integers(0, high, n), rng.integers(0, high, n))
        m = wt.WaveletMatrix(wt.pack([1], np.array([n]), ids))
        assert m.ids().tolist() == ids.tolist()
        for i in rng.integers(0, n, 30 if n else 0).tolist():
            assert m.access(i) == ids[i]
            a, b = sorted((i, int(rng.integers(0, n + 1))))
            assert m.count(int(ids[i]), a, b) == int((ids[a:b] == ids[i]).sum())
            j = int((ids[:i] == ids[i]).sum())
            assert m.occurrence(int(ids[i]), j) == i
        assert m.count(high + 9) == 0


def test_shards(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["the", "xylo", "of."]) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i * 3, t, i) for i, t in enumerate(texts)] + [(3, "again", 0), (None, "no id", 0), (None, None, 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    folder, manifest = wt.write_shards(docs, wt.tokenizer_path(), shard_tokens=500)
    assert manifest.count() > 4
    got = sorted(wt.read_shards(folder, manifest).collect(), key=lambda r: r["start"])
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (doc, text, _), ids in zip(got, rows, library([x[1] for x in rows]), strict=True):
        raw = b"".join(i.to_bytes(4, "little") for i in [*ids, 0])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids) + 1, zlib.crc32(raw)), text
        at += len(ids) + 1


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wt.read_shards(*wt.write_shards(none, wt.tokenizer_path())).count() == 0
    assert qd.contaminated(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def fewest(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_qgram_matches_brute_force():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on", "é"]) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(4, 25)))) for i in range(25)] + [(90, "abc"), (91, None), (92, "")]
    block = qd.Items(items)
    for _ in range(120):
        words = [word() for _ in range(rng.randrange(0, 60))]
        k, t = rng.choice(items[:25])
        if rng.random() < 0.7:
            t = list(t)
            for _ in range(rng.randrange(0, 8)):
                p = rng.randrange(len(t))
                t[p : p + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            words.insert(rng.randrange(len(words) + 1), "".join(t).upper())
        text = "  ".join(words)
        clean = qd.normalise(text)
        got = {m[0]: m[3] for m in block.matches(text)}
        want = {k: d for k, x in items[:25] if (d := fewest(qd.normalise(x), clean)) <= qd.budget(len(qd.normalise(x)))}
        assert got == want


def test_qgram_stretches(monkeypatch):
    """Short stretches and runs of pairs find what whole texts find, and every place reported is one."""
    rng = random.Random(9)
    monkeypatch.setattr(qd, "STRETCH", 128)
    monkeypatch.setattr(qd, "PAIRS", 40)
    item = "".join(rng.choice("abcd ") for _ in range(90)).strip()
    block = qd.Items([(1, item), (2, "ab" * 40)])
    for _ in range(60):
        noisy = list(block.texts[0])
        for _ in range(rng.randrange(0, 12)):
            p = rng.randrange(len(noisy))
            noisy[p : p + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        text = "".join(rng.choice("efg ") for _ in range(rng.randrange(400))) + "".join(noisy) + "ab" * rng.randrange(60) + "".join(rng.choice("efg ") for _ in range(rng.randrange(200)))
        clean = qd.normalise(text)
        got = {m[0]: m for m in block.matches(text)}
        want = {k: d for k, x in zip((1, 2), block.texts, strict=True) if (d := fewest(x, clean)) <= qd.budget(len(x))}
        assert {k: m[3] for k, m in got.items()} == want
        for k, a, b, edits, _ in got.values():
            assert fewest(block.texts[k - 1], clean[a:b]) == edits


def test_qgram_repetitive_and_long_texts():
    """Periodic texts of megabytes against periodic and long items, in bounded memory."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rng = random.Random(3)
    block = qd.Items([(1, "ab" * 500)])
    assert block.matches("ab" * 2_500_000) == [(1, 0, 1000, 0, 1000)]
    (_, a, b, edits, _) = block.matches("".join("ab" * 20 + rng.choice("xyz") for _ in range(400)))[0]
    assert 20 <= edits <= 25 and 970 <= b - a <= 1030
    long = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    noisy = list(long)
    for _ in range(400):
        noisy[rng.randrange(len(noisy))] = "z"
    assert qd.Items([(1, long)]).matches("q " * 999 + "".join(noisy) + " q" * 999)[0][3] <= 400
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB


def test_decontaminate(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in qd.op7_qgram_lemma(spark, sf).collect()}
    texts, wanted = docs.select("doc_id", "text").collect(), items.collect()
    assert {(d, i) for d, t in texts for i, x in wanted if x in t} <= found and found
    clean = qd.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in texts} - {d for d, _ in found}
    split = qd.contaminated(docs, items, block_chars=500)
    assert {(r["doc_id"], r["item_id"]) for r in split.collect()} == found


def test_decontaminate_odd(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "abc def abc"), (3, "the Abc"), (3, "the Abc"), (4, "abcd " * 4000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "abc"), (2, None), (3, "abcd " * 12), (None, "zzz")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in qd.contaminated(docs, items).collect())
    assert got == [(0, 1), (3, 1), (3, 1), (4, 3)]
