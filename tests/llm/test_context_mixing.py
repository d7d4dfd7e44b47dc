"""Scores against plain counts and a plain scalar model; better than the base on training and held-out text."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import context_mixing as cm
from lodestone.llm.common import slices


def words(text):
    return [w.decode() for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()] + [""]


def out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def test_tokens():
    rng = random.Random(1)
    texts = ["", None, " a", "B\x0bc\x1cd\x85 e\xa0f  ", "Ñ É x.", "\n"] + ["".join(rng.choice("aB é.,\n\t") for _ in range(rng.randrange(20))) for _ in range(200)]
    got, which, rows = cm.tokens(pa.array(texts))
    by = [[] for _ in texts]
    for w, r in zip(which, rows, strict=True):
        by[r].append(got[w].as_py())
    assert by == [words(t) for t in texts]


def test_tokens_of_later_slices():
    texts = [f"Número {i} É la{'à' * (i % 7)} x." for i in range(500)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = []
    for part in slices(batch, most=1000):
        found, which, _ = cm.tokens(part.column("text"))
        found.validate(full=True)
        got += found.take(pa.array(which)).to_pylist()
    assert got == [w for t in texts for w in words(t)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_counts_base_and_gain(docs):
    """Counts and base exactly; the model is above the base on training and on held-out text,"""
    texts = dict(docs.select("doc_id", "text").collect())
    train = Counter(w for d, t in texts.items() if not out(d) for w in words(t))
    n, v = sum(train.values()), len(train)
    rows = cm.score_documents(docs).collect()
    assert len(rows) == len(texts)
    won = {False: [0.0, 0.0], True: [0.0, 0.0]}
    places = Counter(x for d, t in texts.items() if not out(d) for x in zip([None, None, *words(t)], [None, *words(t)], words(t), strict=False))
    strays = []
    for r in rows:
        own = words(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(own), sum(train[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
        for i, x in enumerate((r["score"], r["base_score"])):
            won[r["held_out"]][i] += x
        triples = list(zip([None, None, *own], [None, *own], own, strict=False))
        strays.append(round(r["followed"] * len(own)) - sum(places[x] > (not r["held_out"]) for x in triples))
    # a follower may share its 24 bits with another of a frequent context
    assert max(map(abs, strays)) <= 1 and sum(map(abs, strays)) <= 10
    for score, base in won.values():
        assert score > base


def test_same_scores_whatever_the_partitions(spark, docs):
    some = docs.where("doc_id < 400")
    got = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(by_id(cm.score_documents(some.repartition(n), slice_bytes=200_000).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]


def test_levels_of_lists(spark, docs):
    """Lists merged level by level give what one level gives."""
    some = docs.where("doc_id < 200")
    one, many = (by_id(cm.score_documents(some, slice_bytes=60_000, fan=fan).collect()) for fan in (128, 2))
    for d, r in one.items():
        assert (r["n_known"], r["base_score"]) == (many[d]["n_known"], many[d]["base_score"])
        assert math.isclose(r["score"], many[d]["score"], rel_tol=1e-9)


def test_long_words_and_odd_rows(spark):
    texts = ["x" * 64, "y" * 63, "z" * 5000 + " z", None, "", " ", "a a a. a", "a a a. a"]
    rows = [(i, t, 0.0, 1) for i, t in enumerate(texts)] + [(None, "a b", 1.0, 1)] * 50 + [(None, None, None, 2), (12, "a " * 40_000, None, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, score double, id long")
    got = cm.score_documents(data).collect()
    assert len(got) == 60
    by = by_id(got)
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[3]["bits_per_byte"] is None
    assert by[12]["n_tokens"] == 40_001
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert cm.score_documents(data.where("false")).count() == 0


# A scalar model: the same definitions, one token and one bit at a time, counts from plain dictionaries.


def scalar_state(seen, took, own):
    """(logit, class) of a bit, as a predictor knows it."""
    if seen <= cm.SMALL:
        seen, took = max(seen - own, 0), max(took - own, 0)
        logit = math.log((took + cm.PRIOR) / (seen - took + cm.PRIOR))
        kind = 0 if seen == 0 else 1 if seen == 1 else (2 if seen < 4 else 4) + (0 < took < seen)
        return logit, kind
    if took in (0, seen):
        return (6.0 if took else -6.0), 6
    if took == 1:
        return (-6.0, 6) if own else (-4.0, 7)
    if took == seen - 1:
        return 4.0, 7
    return (min(97, max(0, math.floor(math.log((took + cm.PRIOR) / (seen - took + cm.PRIOR)) * 5) + 49)) - 48.5) / 5, 7


def scalar_share(seen, took, own):
    if took >= 255:
        share = 2.0 ** (-math.ceil(-cm.OCTAVE * math.log2(took / seen)) / cm.OCTAVE)
        return share * (254 / 255 if own else 1), True
    if seen <= cm.SURELY:
        return max(took - own, 0) / max(seen - own, 1), seen > own
    return max(took - own, 0) / (cm.SURELY * 2.0 ** (math.ceil(cm.OCTAVE * math.log2(seen / cm.SURELY)) / cm.OCTAVE)), True


def cut(n, *cuts):
    return sum(n >= c for c in cuts)


class Scalar:
    def __init__(self, texts):
        import xxhash

        self.h = lambda w: xxhash.xxh64_intdigest(w.encode(), 7)
        mix = lambda x: int(cm.spread(np.array([x % 2**64], np.uint64))[0])
        self.one = lambda p: mix(p + 11) >> 64 - cm.BITS
        self.two = lambda p, q: mix(p * int(cm._B) + mix(q + 23)) >> 64 - cm.BITS
        self.root, self.cell, self.count, self.letters = Counter(), Counter(), Counter(), Counter()
        types = set()
        for t in texts:
            for h, w, c1, c2 in self.walk(words(t)):
                self.count[w] += 1
                types.add(w)
                for j in range(cm.DEPTH + 1):
                    self.root[j, h >> 64 - j] += 1
                    for o, c in ((1, c1), (2, c2)):
                        self.cell[o, c, j, h >> 64 - j] += 1
                for o, c in ((1, c1), (2, c2)):
                    self.cell[o, c, "w", h >> 64 - cm.CODE] += 1
        self.sharers = Counter(self.h(w) >> 64 - cm.CODE for w in types)
        for w in types:
            for contexts, byte in self.spell(w):
                for c in contexts:
                    for j in range(9):
                        self.letters[c, j, byte >> 8 - j] += 1

    def walk(self, own):
        hs = [self.h(w) for w in own]
        for i, (h, w) in enumerate(zip(hs, own, strict=True)):
            p, q = hs[i - 1] if i else 1, hs[i - 2] if i > 1 else 2
            yield h, w, self.one(p), self.two(p, q)

    @staticmethod
    def spell(w):
        raw = b" " * 6 + w.encode() + b" "
        for i in range(6, len(raw)):
            yield [raw[i - k : i] for k in cm.LETTERS], raw[i]

    @staticmethod
    def mixed(mixer, rate, x, gate):
        logit = min(12, max(-12, sum(float(np.float32(w)) * v for w, v in zip(mixer.weights[:, gate], x, strict=True))))
        step = int((logit + 12) * (cm.STEPS - 1) / 24 + 0.5)
        return math.log(min(1 - 1e-6, max(1e-6, 0.5 / (1 + math.exp(-logit)) + 0.5 * float(rate[gate * cm.STEPS + step]))))

    def score(self, model, text, own):
        """Natural log of the text's probability; own: its occurrences are left out."""
        total, fresh_so_far, run, seen_words = 0.0, 0, 0, Counter()
        for i, (h, w, c1, c2) in enumerate(self.walk(words(text))):
            cell = lambda o, j: self.cell[o, (c1, c2)[o - 1], j, h >> 64 - j]  # noqa: E731, B023
            kinds = [scalar_state(cell(o, 0), cell(o, 1), own)[1] for o in (1, 2)]
            r, place = cut(run, 1, 3, 16), cut(i, 8, 64, 512)
            new = self.count[w] - own <= 0
            g1, g2 = kinds[0], 8 + kinds[1] * 4 + r
            odds = lambda g: math.log(model.rates[g, 1] / model.rates[g, 0])
            sign = 1 if new else -1
            got = self.mixed(model.new, model.refined[2], [sign * odds(g1), sign * odds(g2), sign * math.log((fresh_so_far + 0.3) / (i - fresh_so_far + 1.5))], place)
            if new:
                for contexts, byte in self.spell(w):
                    for j in range(8):
                        s = [scalar_state(self.letters[c, j, byte >> 8 - j], self.letters[c, j + 1, byte >> 7 - j], 0) for c in contexts]
                        got += self.mixed(model.letter, model.refined[1], [x for x, _ in s], (s[2][1] * 8 + s[1][1]) * 4 + min(3, s[0][1] >> 1))
            else:
                for j in range(cm.DEPTH):
                    s = [scalar_state(cell(o, j), cell(o, j + 1), own) for o in (1, 2)]
                    took = self.root[j + 1, h >> 63 - j]
                    root = math.log((max(took - own, 0) + cm.PRIOR) / (self.root[j, h >> 64 - j] - took + cm.PRIOR))
                    gate = (s[1][1] * 8 + s[0][1]) * 4 + r
                    got += self.mixed(model.word, model.refined[0], [root, s[0][0], s[1][0]], gate)
                shares = [(min(1, (self.count[w] - own) / max(1, self.root[cm.DEPTH, h >> 64 - cm.DEPTH] - own)), True)]
                for o in (1, 2):
                    share, there = scalar_share(cell(o, cm.DEPTH), self.cell[o, (c1, c2)[o - 1], "w", h >> 64 - cm.CODE], own)
                    shares.append((share / self.sharers[h >> 64 - cm.CODE], there))
                weight = [m * ok for m, (_, ok) in zip(model.among[gate], shares, strict=True)]
                got += math.log(max(1e-300, sum(m * x for m, (x, _) in zip(weight, shares, strict=True)) / sum(weight)))
            gate = ((kinds[1] * 8 + kinds[0]) * 4 + r) * 4 + place
            a = model.own[gate, 0] / model.own[gate].sum() if i else 0.0
            total += math.log(a * seen_words[w] / max(i, 1) + (1 - a) * math.exp(got))
            fresh_so_far += new
            seen_words[w] += 1
            run = run + 1 if self.cell[2, c2, "w", h >> 64 - cm.CODE] > own else 0
        return total


class Frozen(cm.Mixer):
    def chances(self, x, gate, learn, rate=None):
        return super().chances(x, gate, False, rate)


def learned(texts, held_out):
    """A slice of these texts by their ids, what it is told, its model, and the tree of buckets."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values()), "held_out": [held_out(d) for d in texts], "id": [0] * len(texts)})
    parts = pa.Table.from_batches(list(cm._dealt([batch])))
    lists = cm._listed(3)((pa.scalar(0),), parts)
    told = []
    for o in range(3 + len(cm.LETTERS)):
        for r in range(3):
            some = lists.filter((pa.compute.equal(lists["ord"], o)).to_numpy() & pa.compute.equal(lists["rng"], r).to_numpy())
            told += [cm._known((pa.scalar(o), pa.scalar(r)), some)] if some.num_rows else []
    totals = pa.concat_tables(told)
    buckets = np.zeros(1 << cm.DEPTH)
    for b in cm._by_bucket(totals.filter(pa.compute.less(totals["id"], 0)).to_batches()):
        buckets[b["bucket"].to_numpy()] += b["n"].to_numpy()
    own, model, bottom = cm.Slice(parts), cm.Model(), cm.bottoms(buckets)
    held = cm.Told(own, totals.filter(pa.compute.greater_equal(totals["id"], 0)))
    held.chances(model, bottom, own.train, np.flatnonzero(own.train), True)
    model.letter = Frozen(len(cm.LETTERS), cm.GATES)
    model.settle()
    return own, held, model, bottom


@pytest.mark.parametrize("code", [24, 5])
def test_scalar_model(spark, sf, monkeypatch, code):
    """The vectors' scores against the scalar model with the same learned weights, own occurrences counted and left out; also where many words share a code."""
    monkeypatch.setattr(cm, "CODE", max(code, cm.DEPTH))
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect())
    own, held, model, bottom = learned(texts, out)
    assert np.abs(model.word.weights - 0.4).max() > 0.1
    plain = Scalar([t for d, t in texts.items() if not out(d)])
    every = np.arange(len(own.word))
    for less in (False, True):
        if less:  # words of training texts are never spelled out
            held.spelled, plain.spell = lambda model, words: np.zeros(len(words)), lambda w: []
        got = np.bincount(own.row, held.chances(model, bottom, own.train & less, every, False), own.n)
        for d, t, h, x in zip(own.rows["doc_id"].to_pylist(), own.rows["text"].to_pylist(), own.rows["held_out"].to_pylist(), got, strict=True):
            if len(words(t)) < 900:
                assert math.isclose(x, plain.score(model, t, int(less and not h)), rel_tol=1e-4), d


@pytest.mark.parametrize("code", [24, 8])
def test_known_words_of_a_context_sum_to_one_at_most(monkeypatch, code):
    """With codes so short that most words share theirs, too."""
    monkeypatch.setattr(cm, "CODE", code)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {i: " ".join(rng.choice(vocabulary[: rng.choice((20, 3000))]) for _ in range(400)) for i in range(40)} | {40: " ".join(f"alpha w{i % 7}" for i in range(300))}
    train = len(texts)
    known = sorted({w for t in texts.values() for w in words(t)} - {""})
    texts |= {1000 + i: f"alpha {w}" for i, w in enumerate(known)}
    own, held, model, bottom = learned(texts, lambda d: d >= train)
    got = held.chances(model, bottom, np.zeros(len(own.word), bool), np.arange(len(own.word)), False)
    second = (own.at == 1) & ~own.train
    assert second.sum() == len(known)
    total = np.exp(got[second]).sum()
    assert 0.3 < total <= 1 + 1e-6
    if code == 24:  # none of these words share one: what never followed is worth no more for what else did
        by = {words(t)[1]: x for t, x in zip([own.rows["text"][int(r)].as_py() for r in own.row[second]], got[second], strict=True)}
        assert min(by[f"w{i}"] for i in range(7)) > max(x for w, x in by.items() if w not in {f"w{i}" for i in range(7)})


def test_known_words_of_documents_apart(docs):
    """Held-out documents that share no passage with training text: on their known words the model is above the base, in sum and for most (three in
    four at this size; the others, short ones, are close to it)."""
    texts = dict(docs.select("doc_id", "text").collect())
    own, held, model, bottom = learned(texts, out)
    held.spelled = lambda model, words: np.zeros(len(words))
    got = held.chances(model, bottom, np.zeros(len(own.word), bool), np.arange(len(own.word)), False) / np.log(10)
    train = own.trained.sum()
    base = np.log10(held.count + 0.5) - np.log10(train + 0.5 * ((own.trained > 0).sum() + 1))
    followed = np.bincount(own.row, held.words[1][0][cm.DEPTH].take(held.words[1][1]) > 0) / np.bincount(own.row)
    some = ~own.train & (held.count > 0)
    score, plain = (np.bincount(own.row[some], x[some], own.n) for x in (got, base))
    apart = own.rows["held_out"].to_numpy(zero_copy_only=False) & (followed < 0.05) & (np.bincount(own.row[some], minlength=own.n) > 20)
    assert apart.sum() > 30 and score[apart].sum() > 0.95 * plain[apart].sum() and (score > plain)[apart].mean() > 0.7
    assert (score > 1.05 * plain)[apart].all()  # none is behind by more than a twentieth


def test_bits_of_a_context_sum_to_one():
    """Both ways a bit can go mirror each other, for every state, and shares of a bucket sum to one at most, own occurrences left out or not."""
    for seen in (0, 1, 2, 5, 16, 17, 40, 1000, 10**6):
        took = np.unique(np.minimum(seen, np.array([0, 1, 2, 3, seen // 3, seen // 2, seen - 1, seen]).clip(0)))
        one, other = (cm.state(np.full(len(took), seen), x) for x in (took, seen - took))
        flat = (seen > cm.SMALL) & (np.abs((cm._LOGIT[one] + cm._LOGIT[other])) > 1e-5)
        assert (np.abs(cm._LOGIT[one] + cm._LOGIT[other])[flat] <= 0.2001).all()
        assert (cm._KIND[one] == cm._KIND[other]).all()
    rng = np.random.default_rng(1)
    for _ in range(300):
        took = rng.integers(1, rng.choice([2, 10, 1000, 10**6]), rng.integers(1, 30))
        planes = cm.share_planes(np.full(len(took), took.sum()), took)
        whole, less = (cm.shares(np.full(len(took), own), *planes) for own in (0, 1))
        assert whole.sum() <= 1 + 1e-9 and (less <= whole).all()
        assert (less[took == 1] == 0).all() and (whole >= 0.85 * took / took.sum()).all()
        if took.sum() <= cm.SURELY:
            assert np.allclose(whole, took / took.sum()) and np.allclose(less, (took - 1) / max(1, took.sum() - 1))


def test_equal_rows_are_dealt_by_their_number(spark, docs):
    """Copies of one row, with an id or without, fill several slices, and scores don't depend on how the input is cut."""
    rows = docs.where("doc_id < 60").select("doc_id", "text").unionByName(spark.range(300).selectExpr("cast(null as long) doc_id", "repeat('some words that repeat, in all. ', 20) text"))
    rows = rows.unionByName(spark.range(300).selectExpr("5L doc_id", "repeat('other words, again and again. ', 20) text"))
    marked = rows.withColumn("held_out", cm.held_out(rows.doc_id))
    dealt = cm.dealt_rows(marked, 12, 40_000)
    assert dealt.count() == rows.count()
    for where in ("doc_id IS NULL", "doc_id = 5"):
        assert dealt.where(where).groupBy("id").count().agg({"count": "max"}).first()[0] < 150
    got = [sorted((r.doc_id or -1, r.n_tokens, r.score) for r in cm.score_documents(rows.repartition(n), slice_bytes=40_000).collect()) for n in (2, 7)]
    assert got[0] == got[1] and len(got[0]) == rows.count()


def test_keys_are_exchanged_by_passes(spark, docs, monkeypatch):
    """No exchange holds the keys of all orders, each order is in just one, and scores are those of a single exchange."""
    held, write = [], cm.materialise

    def spy(df, tag):
        out = write(df, tag)
        if tag == "totals":
            held.append({r[0] for r in out.select("ord").distinct().collect()})
        return out

    monkeypatch.setattr(cm, "materialise", spy)
    got = sorted(cm.score_documents(docs, slice_bytes=50_000).collect())
    assert len(held) > 1 and sorted(o for x in held for o in x) == list(range(6))
    monkeypatch.setattr(cm, "PASSES", (tuple(range(6)),))
    monkeypatch.setattr(cm, "HALVES", 1)
    assert sorted(cm.score_documents(docs, slice_bytes=50_000).collect()) == got


def test_slices_are_cut_once(spark, docs, monkeypatch):
    """Texts are cut into words once, not by each pass and part: what is kept of a slice gives the same keys, and a part of the slices is told what is in a column of its own."""
    texts = ["A b  ñ", None, "", "x" * 70_000 + " a b", "é A a\n b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [3, None, 2, 1, 1], "text": texts, "held_out": [False, True, False, True, False], "id": [4] * 5})
    parts = pa.Table.from_batches(list(cm._dealt([batch])))
    own, kept = cm.Slice(parts), cm.Slice(cm._kept((pa.scalar(4),), parts))
    assert kept.rows["doc_id"].to_pylist() == own.rows["doc_id"].to_pylist() == [1, 1, 2, 3, None]
    for k in ("size", "word", "row", "train", "at", "trained", "hash"):
        assert np.array_equal(getattr(own, k), getattr(kept, k)), k
    for one, other in zip(own.lists(tuple(range(6))), kept.lists(tuple(range(6))), strict=True):
        assert one[0] == other[0] and all(np.array_equal(x, y) for x, y in zip(one[1:], other[1:], strict=True))
    written, write = [], cm.materialise

    def spy(df, tag):
        out = write(df, tag)
        written.append(tag)
        if tag == "totals":
            data = [c for c in out.columns if c.startswith("data")]
            assert len(data) == cm.HALVES
            for r in out.collect():
                assert [r[c] is not None for c in data] == [r["id"] % cm.HALVES == h for h in range(cm.HALVES)]
        return out

    monkeypatch.setattr(cm, "materialise", spy)
    cm.score_documents(docs.where("doc_id < 200"), slice_bytes=60_000)
    assert written == ["slices"] + ["totals"] * len(cm.PASSES) + ["scored"] * cm.HALVES


def test_counts_of_stretches():
    """States and shares against counts of every stretch of keys by itself, also where most contexts hold one key."""
    rng = np.random.default_rng(3)
    for contexts in (3, 5000):
        keys = np.unique(rng.integers(0, contexts, 3000).astype(np.uint64) << np.uint64(24) | rng.integers(0, 2**24, 3000).astype(np.uint64) & np.uint64(0xFF0007))
        total = rng.choice([0, 1, 2, 300], len(keys))
        levels = [np.array([total[keys >> np.uint64(24 - j) == k >> np.uint64(24 - j)].sum() for k in keys]) for j in range(9)]
        want = [cm.state(a, b) for a, b in zip(levels, levels[1:], strict=False)] + list(cm.share_planes(levels[8], total))
        assert np.array_equal(cm.told(keys, total, 24, 8, True), np.stack(want))


def test_lists_joined_and_rows_weighed_in_one_scan(spark):
    """Sums and what each list asks for, against plain counts; equal rows and bytes from one grouping."""
    rng = np.random.default_rng(4)
    lists = [(i, {int(k): int(rng.integers(0, 9)) for k in rng.integers(0, 60, 40)}) for i in (2, 0, 1)]
    asks = {i: {k: rng.random() < 0.5 for k in x} for i, x in lists}
    row = lambda i, x: cm.list_row(1, 0, i, np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]), np.array([asks[i][k] for k in sorted(x)]))
    rows, found, total, asked, some = cm._joined(pa.Table.from_pylist([row(i, x) for i, x in lists], cm._LIST))
    plain = sum((Counter(x) for _, x in lists), Counter({k: 0 for _, x in lists for k in x}))
    keys = sorted({k for _, x in lists for k in x})
    assert rows["id"].to_pylist() == [0, 1, 2] and found.tolist() == keys and total.tolist() == [plain[k] for k in keys]
    for i, mine in enumerate(asked):
        assert found[mine].tolist() == sorted(k for k, a in asks[i].items() if a)
    assert found[some].tolist() == sorted({k for x in asks.values() for k, a in x.items() if a})
    data = spark.createDataFrame([(1, "ab")] * 4 + [(1, None), (None, None), (None, None), (2, "é" * 9)], "doc_id long, text string")
    got = cm.equal_rows(data).agg({"bytes": "sum"}).first()[0], cm.equal_rows(data).where(cm.many_rows(80)).select("n", "bytes").collect()
    assert got == (4 * 3 + 3 + 19, [(4, 12)])
