"""Language identification by hierarchical discrimination.

A text's language family is predicted first; inside a family of several languages, one-versus-one
linear support vector machines vote. Features are relative frequencies of hashed byte 1- to 3-grams
of the whole text. Training reads a bounded sample of labelled rows (``per_language`` each, drawn by
a hash of doc_id): a written table, from which each machine is fitted in a group of its own. The others
that a family's machine learns from are thinned to what REST languages have, so a group is bounded
however many languages there are. Only weights reach the driver, 32 KB for each machine; prediction is
one narrow pass with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, discard, materialise, slices, table

DIM_BITS, PER_LANGUAGE, EPOCHS, COST = 13, 800, 12, 1.0
DIM = 1 << DIM_BITS
#: As many languages' rows, at most, stand against a family in its machine's sample.
REST = 24
#: Languages of which the counts are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 100_000
#: The family of each language code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "celtic": "ga cy br gd",
    "malayic": "id ms jv tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: A-Z to lower case, other ASCII that is no letter to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def gram_slots(text: bytes) -> np.ndarray:
    """A slot for each 1-, 2- and 3-gram of bytes, runs of blanks taken as one."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    return np.concatenate([b, (two * np.uint32(0x9E3779B1) + np.uint32(1)) >> np.uint32(32 - DIM_BITS), (three * np.uint32(0x85EBCA6B) + np.uint32(7)) >> np.uint32(32 - DIM_BITS)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear SVM (squared hinge loss) and its bias, the last, by coordinate descent on the dual. x: slots that
    aren't zero and their values; y is -1 or 1."""
    rng, w = np.random.default_rng(0), np.zeros(DIM + 1, np.float32)
    alpha, norm = np.zeros(len(x)), np.array([float(v @ v) for _, v in x]) + 1 + 0.5 / cost
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            slots, values = x[i]
            step = max(0.0, alpha[i] - (y[i] * float(values @ w[slots] + w[-1]) - 1 + alpha[i] * 0.5 / cost) / norm[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[slots] += np.float32(step * y[i]) * values
                w[-1] += np.float32(step * y[i])
    return w


class Tree:
    """Family classifiers (one against the rest) and, in each family, a classifier for each pair of languages. Machines are
    numbered: families first, if there are several, then pairs."""

    def __init__(self, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(k) for k in self.langs})
        at = {f: i for i, f in enumerate(self.families)}
        self.kin = {k: at[family(k)] for k in self.langs}
        self.members: list[list[int]] = [[] for _ in self.families]
        for i, k in enumerate(self.langs):
            self.members[self.kin[k]].append(i)
        self.n = len(self.families) if len(self.families) > 1 else 0
        self.pairs = [(f, a, b) for f, own in enumerate(self.members) for a, b in combinations(own, 2)]

    def lessons(self) -> dict[str, list[tuple[int, int]]]:
        """For each language its pairs' machines and the side, 1 or -1, on which it stands in them."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in self.langs}
        for i, (_, a, b) in enumerate(self.pairs, self.n):
            out[self.langs[a]].append((i, 1))
            out[self.langs[b]].append((i, -1))
        return out

    def learned(self, planes: list[np.ndarray], scale: np.ndarray) -> Tree:
        w = np.array(planes, np.float32).reshape(len(planes), DIM + 1)
        self.bias = w[:, -1].copy()
        self.weights = np.ascontiguousarray((w[:, :-1] * scale).T)  # slot by plane
        return self

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            slots = gram_slots(t)
            sums = np.zeros(len(self.bias))
            for at in range(0, len(slots), 1 << 20):
                sums += np.bincount(slots[at : at + (1 << 20)], minlength=DIM) @ self.weights
            margin = sums / len(slots) + self.bias
            n = self.n
            f = int(np.argmax(margin[:n])) if n else 0
            sure = 1 / (1 + np.exp(-2.0 * np.clip(margin[f] - np.max(np.delete(margin[:n], f)), -30, 30))) if n else 1.0
            own = self.members[f]
            votes, edge = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
            for (g, a, b), m in zip(self.pairs, margin[n:], strict=True):
                if g == f:
                    votes[a if m > 0 else b] += 1
                    edge[a] += m
                    edge[b] -= m
            best = max(own, key=lambda k: (votes[k], edge[k]))
            if len(own) > 1:
                sure *= 1 / (1 + np.exp(-2.0 * np.clip(edge[best] / (len(own) - 1), -30, 30)))
            out.append((self.langs[best], float(sure)))
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            slot, times = [], []
            for t in byte_texts(part.column("text")):
                s, n = np.unique(gram_slots(t), return_counts=True)
                slot.append(s.astype("<u2").tobytes())
                times.append((n / n.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(slot, pa.binary()), pa.array(times, pa.binary())], ["lang", "slots", "shares"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


_ONE = 1 << 40


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slot the sum of shares and of their squares in 1/_ONE, as integers, so that they add up alike in any order."""
    sums, n = np.zeros((2, DIM), np.int64), 0
    for batch in batches:
        for slots, shares in zip(batch.column("slots").to_pylist(), batch.column("shares").to_pylist(), strict=True):
            at, v = np.frombuffer(slots, "<u2"), np.frombuffer(shares, "<f4").astype(np.float64)
            sums[0, at] += np.rint(v * _ONE).astype(np.int64)
            sums[1, at] += np.rint(v * v * _ONE).astype(np.int64)
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])


def scale_of(n: int, sums: np.ndarray) -> np.ndarray:
    """Weight of each slot: one over the spread of its share among the n rows of the sample."""
    mean, square = sums / _ONE / n
    return (4 / np.sqrt(DIM) / (np.sqrt(np.maximum(0, square - mean**2)) + 1e-4)).astype(np.float32)


def _lessons(tree: Tree):
    of, rest = tree.lessons(), min(1.0, REST / max(1, len(tree.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shares"):
                row, plane, side = [], [], []
                for i, (k, slots, shares) in enumerate(zip(*(part.column(c).to_pylist() for c in ("lang", "slots", "shares")), strict=True)):
                    own = list(of[k])
                    if tree.n:
                        others = np.flatnonzero(np.random.default_rng(zlib.crc32(k.encode() + slots + shares)).random(tree.n) < rest)
                        own += [(tree.kin[k], 1), *((int(f), -1) for f in others if f != tree.kin[k])]
                    row += [i] * len(own)
                    plane += [m for m, _ in own]
                    side += [s for _, s in own]
                for at in range(0, len(row), 512):  # in small batches, as rows are repeated
                    some = pa.array(row[at : at + 512], pa.int32())
                    cols = [part.column(c).take(some) for c in ("slots", "shares")]
                    yield pa.RecordBatch.from_arrays([pa.array(plane[at : at + 512], pa.int32()), pa.array(side[at : at + 512], pa.int32()), *cols], ["plane", "side", "slots", "shares"])

    return run


def _fitted(scale: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [(c, "ascending") for c in ("side", "slots", "shares")])
        x = []
        for i in order.to_pylist():
            slots = np.frombuffer(rows.column("slots")[i].as_py(), "<u2")
            x.append((slots, np.frombuffer(rows.column("shares")[i].as_py(), "<f4") * scale[slots]))
        w = svm(x, rows.column("side").to_numpy()[order.to_numpy()].astype(float))
        return pa.table({"plane": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Tree | None:
    """A tree from at most about ``per_language`` rows of each language (by a hash of doc_id, so the
    sample is the same however rows are partitioned); None without labelled text."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    names = [r["lang"] for r in counts.select("lang").collect()]
    if not names:
        return None
    by = counts.select("lang", F.least(F.lit(1.0), per_language / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(4), F.coalesce("doc_id", F.lit(0)), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(by) if len(names) <= SMALL_ROWS else by, "lang").where(draw < F.col("share")).select("lang", "text")
    sample = materialise(drawn.mapInArrow(_features, "lang string, slots binary, shares binary"), "sample")
    parts = sample.select("slots", "shares").mapInArrow(_moments, "n long, sums binary").collect()
    tree, n = Tree([r["lang"] for r in sample.select("lang").distinct().collect()]), sum(r["n"] for r in parts)
    if not n:
        return None
    scale = scale_of(n, sum(np.frombuffer(r["sums"], np.int64).reshape(2, DIM) for r in parts))
    fits = sample.mapInArrow(_lessons(tree), "plane int, side int, slots binary, shares binary").groupBy("plane").applyInArrow(_fitted(scale), "plane int, w binary")
    planes = [np.frombuffer(r["w"], np.float32) for r in sorted(fits.collect(), key=lambda r: r["plane"])]
    discard(counts, sample)
    return tree.learned(planes, scale)


def _predicted(tree: Tree | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                lettered = [i for i, t in enumerate(texts) if has_letter(t)] if tree else []
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                for i, (k, s) in zip(lettered, tree.predict([texts[i].encode() for i in lettered]) if tree else [], strict=True):
                    lang[i], score[i] = k, s
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang).

    Learns from rows that aren't held out. Null texts and texts without a letter are ``und`` with
    score 0, and so is all text if no row is labelled; a null doc_id is never held out; repeated
    rows are all answered; an empty table gives no rows. Ties go to the language first by code point. Other
    columns, whatever their names, are not read; texts are read whole, in pieces of bounded size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    tree = train(rows.where(~F.col("held_out")), per_language)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(tree), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
