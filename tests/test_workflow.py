"""Hand values and edge cases of label resolution, answers, verdicts, distributions, index and sweep helpers."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import answering, evaluation, judging, retrieval
from lodestone.plans import workflow
from lodestone.sources import corpus


def test_evidence(spark):
    docs = spark.createDataFrame([("a", "One two.\n\n three \\E four [x]. One two."), ("b", None), ("c", "😀 left  right")], "doc_id string, text string")
    made = [
        (1, "a", "One two. || three \\E four"),
        (2, "a", "two. three"),
        (3, "a", " || "),
        (4, "none", "x"),
        (5, "b", "x"),
        (6, "a", "four  [x]."),
        (7, "c", "left right"),
        (8, "a", None),
        (9, None, "x"),
        (10, "a", "four xx"),
    ]
    got = evaluation.resolve_evidence(spark.createDataFrame(made, "item_id long, doc_id string, evidence string"), docs)
    rows = {(r.item_id, r.part): (r.char_start, r.char_end, r.problem) for r in got.collect()}
    assert rows == {
        (1, 0): (0, 8, None),
        (1, 1): (11, 24, None),
        (2, 0): (4, 14, None),
        (4, 0): (None, None, "no document"),
        (5, 0): (None, None, "not found"),
        (6, 0): (20, 29, None),
        (7, 0): (2, 12, None),
        (9, 0): (None, None, "no document"),
        (10, 0): (None, None, "not found"),
    }
    with pytest.raises(ValueError, match="10 in a: not found"):
        evaluation.require_resolved(got)
    fine = got.where("problem IS NULL")
    assert evaluation.require_resolved(fine) is fine


def test_answers(spark):
    units = spark.createDataFrame([(1, "doc-a", "red fox runs\n\nrest"), (2, "doc-b", "blue whale"), (3, "doc-c", None)], "unit_id long, source string, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "zebra"), (3, None)], "query_id long, text string")
    got = {r.query_id: r for r in answering.answer(units, asked, "bm25", gate={}).collect()}
    assert got[1].answer == "(source: doc-a)\nred fox runs" and not got[1].refused
    assert got[2].answer == answering.REFUSAL and got[2].refused and got[2].n_passages == 0 and got[3].refused
    told = {r.query_id: r for r in answering.answer(units, asked, "bm25", generator=lambda c: F.upper(c)).collect()}
    assert not told[2].refused and told[2].answer == "CONTEXT PASSAGES:\n\n(NO PASSAGES RETRIEVED)\n\nQUESTION: ZEBRA"
    strict = answering.answer(units, asked, "hybrid", gate={"min_score": 0.99, "min_top": 0.999}).collect()
    assert all(r.refused for r in strict if r.query_id != 1)


@pytest.mark.parametrize("name", ["bm25", "vector", "hybrid"])
def test_retrieve(spark, name):
    units = spark.createDataFrame([(str(i), t) for i, t in enumerate(["red fox", "red dog", "blue whale", "", None])], "unit_id string, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "whale")], "query_id long, text string")
    for reranked in (False, True):
        got = retrieval.retrieve(units, asked, name, 2, reranked).collect()
        first = {r.query_id: r.unit_id for r in got if r["rank"] == 1}
        assert first == {1: "0", 2: "2"} and max(r["rank"] for r in got) <= 2
        assert all(r.semantic_score is None for r in got) or (name == "hybrid" and not reranked)
    with pytest.raises(ValueError):
        retrieval.retrieve(units, asked, "none")


def test_write_back(spark):
    shape = "key string, measured boolean, correctness string, faithfulness string, explanation string, n long"
    rows = [("a", True, "correct", "faithful", "", 1), ("b", False, "incorrect", "unfaithful", "Judge ERROR: 429", 2), ("c", None, None, None, None, 3), ("d", None, "correct", None, "fine", 4), ("b", None, None, None, "", 5), (None, None, None, None, None, 6)]
    old = spark.createDataFrame(rows, shape)
    new = spark.createDataFrame([("a", "incorrect", "unfaithful", "late"), ("b", "partially-correct", "faithful", "ok")], "key string, correctness string, faithfulness string, explanation string")
    got = {r.n: tuple(r)[:5] for r in judging.write_back(old, new).collect()}
    assert got == {
        1: ("a", True, "correct", "faithful", ""),
        2: ("b", True, "partially-correct", "faithful", "ok"),
        3: ("c", False, None, None, "not judged"),
        4: ("d", True, "correct", None, "fine"),
        5: ("b", True, "partially-correct", "faithful", "ok"),
        6: (None, False, None, None, "not judged"),
    }
    tokens = judging.write_back(old, new).withColumns({"prompt_tokens": F.lit(2), "completion_tokens": F.col("n"), "slug": F.lit("s")})
    row = judging.rebuilt_summary(tokens, "slug").first()
    assert (row.total, row.judged, row.correct_count, row.faithful_count, row.correctness, row.faithfulness, row.gap) == (6, 4, 2, 3, 0.75, 1.0, -0.25)
    assert judging.rebuilt_summary(tokens.withColumn("measured", F.lit(False)), "slug").first().correctness is None
    assert judging.write_back(old.limit(0), new).count() == 0


@pytest.mark.parametrize("n", [1, 5, 10, 11, 57])
def test_distribution(spark, n):
    values = sorted((i * 7) % 13 / 4 for i in range(n))
    rows = spark.createDataFrame([("x", v) for v in values] + [("x", None)], "kind string, v double")
    got = evaluation.distribution(rows, "kind", "v").first()
    assert tuple(got)[1:] == (n, values[0], values[max(0, n // 10 - 1)], values[n // 2], values[min(n - 1, n * 9 // 10)], values[-1])


def test_overlapping(spark):
    rows = spark.createDataFrame([(1, 0.5, True), (2, 0.7, True), (3, 0.5, False), (4, 0.4, False), (5, None, False)], "query_id long, best double, in_scope boolean")
    assert [r.query_id for r in evaluation.overlapping(rows).collect()] == [3]
    assert evaluation.overlapping(rows.where("NOT in_scope")).count() == 0


def test_rolling_mean(spark):
    rows = [(i, "hot" if i % 3 else None, i // 40 * 1800, None if i % 17 == 0 else i * 0.37) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, kind string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: r.mean for r in evaluation.rolling_mean(frame, "kind", "t", "id", "v", 7, 20).collect()}
    assert len(got) == 400
    for kind in ("hot", None):
        mine = [r for r in rows if r[1] == kind]
        for at, r in enumerate(mine):
            seen = [x[3] for x in mine[max(0, at - 6) : at + 1] if x[3] is not None]
            assert (got[r[0]] is None) == (not seen) and (not seen or got[r[0]] == pytest.approx(sum(seen) / len(seen)))
    with pytest.raises(ValueError):
        evaluation.rolling_mean(frame, "kind", "t", "id", "v", 21, 20)


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    chunk = lambda name, n: spark.range(n).select(F.col("id").cast("string").alias("chunk_id"), F.lit(name).alias("strategy"))
    corpus.index_write(chunk("fixed", 3), path)
    corpus.index_write(chunk("semantic", 2), path)
    assert corpus.index_count(spark, path) == 5 and corpus.index_count(spark, path, "fixed") == 3
    corpus.index_reset(spark, path, "fixed")
    assert corpus.index_count(spark, path, "fixed") == 0 and corpus.index_count(spark, path, "semantic") == 2
    assert {r.chunk_id for r in corpus.index_dump(spark, path).collect()} == {"0", "1"}


def test_runs_and_cache(spark, tmp_path):
    def work(slug):
        if slug == "bad":
            raise RuntimeError("no luck")

    errors = str(tmp_path / "errors")
    assert corpus.run_each(spark, ["a", "bad", "b", "c"], work, errors, only=["a", "bad", "b"]) == ["a", "b"]
    (row,) = spark.read.json(errors).collect()
    assert row.slug == "bad" and "no luck" in row.error
    assert corpus.fingerprint({"k": 1, "a": 2}) == corpus.fingerprint({"a": 2, "k": 1}) != corpus.fingerprint({"a": 2, "k": 2})
    used = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), ("d", None)], "key string, at long")
    assert [r.key for r in corpus.evict(used, "key", "at", 2).collect()] == ["b", "c"]
    rows = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), (None, 3, "null")], "key string, n long, v string")
    assert {r.key: r.v for r in corpus.first_of(rows, "key", "n").collect()} == {"x": "early", None: "null"}


def test_folder_and_labels(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "skip.bin").write_text("x")
    with pytest.raises(FileNotFoundError):
        corpus.scan_folder(spark, str(folder))
    (folder / "A.MD").write_text("Alpha, beta\ngamma")
    docs = corpus.scan_folder(spark, str(folder))
    shape = "id string, document_id string, query string, expected_answer string, evidence_text string"
    rows = spark.createDataFrame([("q1", "A.MD", 'say "x", y', "b", "Alpha, beta\ngamma || gamma")], shape)
    path = str(tmp_path / "labels")
    corpus.write_labels(rows, docs, path)
    assert corpus.scan_labels(spark, path).select(*rows.columns).collect() == rows.collect()
    for wrong in ("Alpha  beta", "alpha"):
        with pytest.raises(ValueError, match="q1"):
            corpus.write_labels(rows.withColumn("evidence_text", F.lit(wrong)), docs, path)
    with pytest.raises(ValueError, match="q1"):
        corpus.write_labels(rows.withColumn("document_id", F.lit("B")), docs, path)


def test_needs_judging_and_object(spark):
    rows = spark.createDataFrame([(1, True, None, "judge error"), (2, None, "correct", "Judge unavailable"), (3, None, "correct", "a rounding error"), (4, False, None, None)], "id long, m boolean, c string, e string")
    assert {r.id for r in rows.where(evaluation.needs_judging(F.col("m"), F.col("c"), F.col("e"))).collect()} == {2, 4}
    text = spark.createDataFrame([('```json\n{"k": 1,}\n```',), ('x {"k": "a,}"} y',), ("none",), (None,)], "t string")
    assert [r[0] for r in text.select(tx.json_object(F.col("t"))["k"]).collect()] == ["1", "a,}", None, None]


def test_sweep(spark, sf):
    got = {r.slug: r for r in workflow.QUERIES["sweep_summary"](spark, sf).collect()}
    assert len(got) == 18
    for r in workflow.QUERIES["sweep_fixed_summary"](spark, sf).collect():
        assert got[r.slug] == r
    for slug, r in got.items():
        assert 0 <= r.ndcg_mean <= 1 and r.hit_mean >= r.precision_mean and (not slug.startswith("semantic") or r.questions > 0)
