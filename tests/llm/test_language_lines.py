"""Held-out accuracy of the language tree, and line spread against exact counts."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import language_tree as lt
from lodestone.llm import line_spread as ls


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r[0]: r[1] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in lt.identify(docs).collect() if r["held_out"]]
    right = sum(lang[r["doc_id"]] == r["lang_pred"] for r in got)
    assert len(got) > 200 and right / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "123 %&", "en"), (5, "", None), (None, "le chien", "fr"), (7, "the dog " * 9000, None), (7, "the dog", None), (8, "", "xx")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = lt.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[3] == by[4] == by[5] == "und" and {by[7], by[None]} <= {"en", "fr"}
    assert lt.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in lt.identify(docs.withColumn("lang", docs["lang"].substr(0, 0).try_cast("int"))).collect()} == {"und"}


def test_three_languages_in_a_family(spark):
    texts = {"en": "the cat sat with this thing", "de": "der hund und die katze nicht", "nl": "het een van de kat niet", "fr": "le chat est dans la maison"}
    rows = [(i, " ".join(t.split()[i % 3 :]), k) for k, t in texts.items() for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tree = lt.train(docs)
    assert len(tree.pairs) == 3 and tree.n == 2
    assert [k for k, _ in tree.predict([t.encode() for t in texts.values()])] == list(texts)
    again = lt.train(docs.repartition(5, "text"))  # the same machines, however rows are dealt
    assert (tree.weights == again.weights).all() and (tree.bias == again.bias).all()


def test_machine_against_plain_descent():
    """The primal objective that coordinate descent reaches is the least, which plain gradient descent finds."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) > 0, 1.0, -1.0)
    one = np.hstack([x, np.ones((60, 1))])
    objective = lambda w: 0.5 * w @ w + lt.COST * np.sum(np.maximum(0, 1 - y * (one @ w)) ** 2)
    plain = np.zeros(7)
    for _ in range(20000):
        plain -= 1e-3 * (plain - 2 * lt.COST * (y * np.maximum(0, 1 - y * (one @ plain))) @ one)
    for epochs, most in ((lt.EPOCHS, 1.1), (300, 1.000001)):  # the default stops early
        w = lt.svm([(np.arange(6), v) for v in x], y, epochs)
        assert objective(np.append(w[:6], w[-1]).astype(float)) <= most * objective(plain)


def brute_slots(text):
    """A count for each slot, gram by gram."""
    folded = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()]
    b = [32]
    for c in [*folded, 32]:
        if c != 32 or b[-1] != 32:
            b.append(c)
    found = Counter(b)
    found.update(((b[i] << 8 | b[i + 1]) * 0x9E3779B1 + 1) % 2**32 >> 32 - lt.DIM_BITS for i in range(len(b) - 1))
    found.update(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x85EBCA6B + 7) % 2**32 >> 32 - lt.DIM_BITS for i in range(len(b) - 2))
    return found


def test_prediction_against_plain_votes(spark, sf):
    """Family by greatest margin, then votes of the family's pairs, worked out gram by gram."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tree = lt.train(docs.where(~lt.held_out(docs["doc_id"])))
    lang = {r["doc_id"]: r["lang_pred"] for r in lt.identify(docs.withColumn("share", docs["doc_id"]).withColumn("n", docs["text"])).collect()}
    for r in docs.select("doc_id", "text").collect():
        if not lt.has_letter(r["text"]):
            assert lang[r["doc_id"]] == "und"
            continue
        counts = brute_slots(r["text"])
        total = sum(counts.values())
        margin = [sum(n * float(tree.weights[s, m]) for s, n in counts.items()) / total + float(tree.bias[m]) for m in range(len(tree.bias))]
        f = max(range(tree.n), key=lambda m: margin[m]) if tree.n else 0
        votes = {k: [0, 0.0] for k in tree.members[f]}
        for m, (g, a, b) in enumerate(tree.pairs, tree.n):
            if g == f:
                votes[a if margin[m] > 0 else b][0] += 1
                votes[a][1] += margin[m]
                votes[b][1] -= margin[m]
        assert lang[r["doc_id"]] == tree.langs[max(votes, key=lambda k: votes[k])]


def test_many_languages_stay_bounded(spark, monkeypatch):
    """Against a family stand at most about REST languages' rows, whatever their number."""
    monkeypatch.setattr(lt, "REST", 4)
    rows = [(i, "word " + str(i).translate(str.maketrans("0123456789", "abcdefghij")), f"q{i % 40}") for i in range(400)]
    tree = lt.Tree([k for *_, k in rows])
    feed = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text").mapInArrow(lt._features, "lang string, slots binary, shares binary")
    sizes = [r["count"] for r in feed.mapInArrow(lt._lessons(tree), "plane int, side int, slots binary, shares binary").groupBy("plane").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 10 + 80 and sum(sizes) < 40 * 60


@pytest.mark.parametrize("sites", [2, 10])
def test_lines_equal_sql(spark, sf, sites):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ls.ORACLE_SQL.replace(f">= {ls.MIN_SITES}", f">= {sites}")).fetchall()
    left = ls.drop_boilerplate(docs, min_sites=sites)
    got = left.selectExpr("r.doc_id", "n_lines", "n_removed", "char_length(text)", "sha2(text, 256)").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r[2] for r in got) > 0


def test_lines_odd(spark):
    rows = [(i, f"s{i}", f"own {i}\n  Shared line \t\n\nrare" if i < 3 else "Shared line\r\n", i) for i in range(12)]
    rows += [(20, None, "Shared line\nx", 0), (21, "s1", None, 0), (22, "s1", "", 0), (None, "s2", "Shared line", 0), (None, "s2", "Shared line", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n long")
    got = {r["r"]["doc_id"]: r for r in ls.drop_boilerplate(docs).collect()}
    assert got[0]["text"] == "own 0\n\nrare" and got[0]["n_removed"] == 1
    assert got[5]["text"] == "" and got[20]["text"] == "x" and got[21]["text"] == got[22]["text"] == "" == got[None]["text"]
    assert ls.drop_boilerplate(docs).count() == len(rows)
    assert ls.drop_boilerplate(docs.where("false")).count() == 0
    assert ls.boilerplate(docs, min_sites=13).count() == 0
