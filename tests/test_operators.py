"""Hand values and invariants of chunkers, metrics, gate, judging, sources and streaming."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors
from lodestone.operators import chunking, evaluation, retrieval
from lodestone.sources import corpus
from lodestone.streaming import incremental

HEADED = "# One\n\nalpha beta. Gamma delta!\n\n## Two\n\n" + "Long sentence here. " * 30 + "\n\n# Three\n\n" + "x" * 500


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_window(spark):
    text = "A sentence, a second one. " * 40
    got = chunking.fixed(docs(spark, text, "", None, "  \n ", "é😀" * 150), 200, 40).orderBy("doc_id", "char_start").collect()
    first = [r for r in got if r["doc_id"] == 0]
    assert first[1]["char_start"] == 160
    assert {r["doc_id"] for r in got} == {0, 4}
    for r in first:
        assert r["content"] == text[r["char_start"] : r["char_end"]] and len(r["content"]) <= 200
    assert all(a["char_end"] > b["char_start"] for a, b in zip(first, first[1:], strict=False)) and first[-1]["char_end"] == len(text)
    with pytest.raises(ValueError):
        chunking.fixed(docs(spark, text), 100, 100)


def test_recursive_and_semantic(spark):
    for name in ("recursive", "semantic"):
        got = chunking.chunk(docs(spark, HEADED), name).collect()
        assert all(r["content"] == HEADED[r["char_start"] : r["char_end"]] for r in got)
        assert len({r["chunk_id"] for r in got}) == len(got) > 1
    spans = chunking.recursive_spans(HEADED, 200, 40)
    assert spans[0][0] == 0 and spans[-1][1] == len(HEADED)
    assert all(b >= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert all(b - a <= 200 for a, b in spans)
    assert any(HEADED[a:].startswith("## Two") for a, _ in spans) or any("## Two" in HEADED[a:b] for a, b in spans)
    with pytest.raises(ValueError):
        chunking.chunk(docs(spark, HEADED), "none")


def plain_recursive(text, size, overlap):
    """By recursion, one boundary at a time."""

    def cut(part, at, depth):
        if len(part) <= size:
            return [(at, at + len(part))]
        if depth == 3:
            return [(at + i, at + min(i + size, len(part))) for i in range(0, len(part), size - overlap)]
        pattern = (r"(?m)^(?=#{1,6}\s)", r"\n\s*\n", r"(?<=[.!?])\s+")[depth]
        cuts = sorted({0, *(m.end() for m in re.finditer(pattern, part)), len(part)})
        return [x for a, b in zip(cuts, cuts[1:], strict=False) for x in cut(part[a:b], at + a, depth + 1)]

    out = []
    for a, b in cut(text, 0, 0):
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def plain_semantic(text, threshold, size, least):
    """By a running mean, one sentence at a time."""
    parts, at = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+|\n{2,}", text):
        parts.append((at, m.start()))
        at = m.end()
    parts = [(a, b) for a, b in [*parts, (at, len(text))] if text[a:b].strip()]
    if len(parts) < 2:
        return [(0, len(text))]
    groups = [[parts[0]]]
    for a, b in parts[1:]:
        run = [chunking.hash_embed([text[x:y]])[0] for x, y in groups[-1]]
        mean, own = sum(run) / len(run), chunking.hash_embed([text[a:b]])[0]
        scale = float((mean @ mean) ** 0.5 * (own @ own) ** 0.5)
        like, start, end = (float(mean @ own) / scale if scale else 0.0), groups[-1][0][0], groups[-1][-1][1]
        if (round(like, 9) < threshold and end - start >= least) or b - start > size:
            groups.append([])
        groups[-1].append((a, b))
    return [(g[0][0], g[-1][1]) for g in groups]


def test_chunkers_equal_plain_forms():
    rng = random.Random(5)
    bits = ["# Head\n", "\n\n", "\n \n\n", "word ", "Ends. ", "Why?\n", "x" * 70, "one two three! ", "\n## Sub\n", "  ", "é ü. "]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        for size, overlap in ((60, 10), (200, 40), (30, 0)):
            assert chunking.recursive_spans(text, size, overlap) == plain_recursive(text, size, overlap)
        assert chunking.semantic_spans(text, chunking.hash_embed, 0.5, 120, 30) == plain_semantic(text, 0.5, 120, 30)


def test_metrics(spark):
    ranked = spark.createDataFrame([(q, u, r) for q, us in ((1, "abcde"), (2, "xay"), (3, "b"), (4, "zzz"[:1])) for r, u in enumerate(us, 1)], "query_id long, unit_id string, rank long")
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "q"), (3, "b"), (5, "m")], "query_id long, unit_id string")
    asked = spark.createDataFrame([(q,) for q in range(1, 7)], "query_id long")
    got = {r["query_id"]: r for r in evaluation.ranking_metrics(ranked, labels, asked).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["rr"], got[1]["ndcg"]) == (0.4, 1.0, 1.0, 1.0)
    assert (got[2]["recall"], got[2]["rr"], got[2]["hit"]) == (0.5, 0.5, 1.0)
    assert got[3]["precision"] == 0.2
    for q in (4, 5, 6):
        assert got[q]["precision"] == got[q]["recall"] == got[q]["rr"] == got[q]["ndcg"] == got[q]["hit"] == 0
    one = evaluation.ranking_metrics(ranked.where("query_id = 2"), labels.where("query_id = 2 and unit_id = 'a'"), asked.where("query_id = 2")).first()
    assert math.isclose(one["ndcg"], 1 / math.log2(3), abs_tol=1e-6)


def test_percentile(spark):
    v = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert tuple(v.agg(*[evaluation.nearest_rank(p, "v") for p in (50, 95, 100)]).first()) == (50, 95, 100)
    assert v.where("v < 0").agg(evaluation.nearest_rank(50, "v"), evaluation.mean(F.col("v"))).first() == (0, 0)


def ranked_list(spark, *sims):
    return spark.createDataFrame([(1, f"c{i}", i, s) for i, s in enumerate(sims, 1)], "query_id long, unit_id string, rank long, semantic_score double")


def test_gate(spark):
    how = {"min_score": 0.45, "min_top": 0.5}
    go = lambda *s, **k: retrieval.gate(ranked_list(spark, *s), **(how | k))
    assert retrieval.gate_passages(go(0.31, 0.28)).count() == 0
    report = retrieval.gate_report(go(0.31, 0.28), **how).first()
    assert (report["kept"], report["dropped"], report["threshold"], report["passed"]) == (0, 2, 0.5, False)
    assert [(r["unit_id"], r["rank"]) for r in retrieval.gate_passages(go(0.8, 0.1, 0.6)).orderBy("rank").collect()] == [("c1", 1), ("c3", 2)]
    assert retrieval.gate_passages(go(None, None)).count() == 2
    assert retrieval.gate_passages(go(0.1, enabled=False)).count() == 1
    assert retrieval.gate_passages(go(0.8, None, 0.2, keep_at_least=2)).count() == 2


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(tx.tokens(F.lit("The Cat-9 and it"))) == ["cat", "9"]
    assert value(tx.count_tokens(F.lit("café 東京 x_1"))) == 3
    assert value(tx.strip(F.lit("\n a \t"))) == "a"
    assert value(tx.model_tag(F.lit("org/bge-small-en-v1.5"))) == "bge-small-en-v1-5"
    assert value(tx.evidence_parts(F.lit(" a || b ||  "))) == ["a", "b"]
    good = value(tx.json_verdict(F.lit('```json\n{"correctness": "correct", "faithfulness": "odd", "explanation": "fine",}\n```')))
    assert tuple(good) == ("correct", "unfaithful", "fine")
    assert value(tx.json_verdict(F.lit("no object here"))) is None
    for said, want in (('{"correctness": " Correct", "faithfulness": "FAITHFUL\\n", "explanation": "a,}"}', ("correct", "faithful", "a,}")), ("{}", ("incorrect", "unfaithful", "")), ('{"correctness": 1, "x": [1, 2,],}', ("incorrect", "unfaithful", ""))):
        assert tuple(value(tx.json_verdict(F.lit(said)))) == want
    assert value(tx.json_verdict(F.lit("{broken"))) is None and value(tx.json_verdict(F.lit("{not: json}"))) is None
    assert value(tx.retry_after(F.lit("429: try again in 1m2.5s"))) == 62.5 and value(tx.retry_after(F.lit("try again in 3s"))) == 3.5
    assert value(tx.retry_after(F.lit("took 3s"))) is None
    assert value(vectors.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0
    assert value(evaluation.echo(F.lit("x [1] (source: 3)\nhello\n\n[2] more"))) == "(source: 3)\nhello"


def test_hash_vectors_equal_the_python_form(spark):
    texts = ["Refund the refund", "ein Wort", "a b c d e"]
    cells = retrieval.vectors_of(docs(spark, *texts, "", None).withColumnRenamed("doc_id", "unit_id"), "unit_id", 64)
    assert cells.count() == len(texts)
    got = {r["unit_id"]: r["vector"] for r in cells.collect()}
    for i, v in enumerate(chunking.hash_embed(texts)):
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[i], v, strict=True))


def test_unmeasured_is_not_zero(spark):
    rows = spark.createDataFrame([("a", "correct"), ("a", None)], "s string, c string").withColumn("x", evaluation.ordinal(F.col("c")))
    got = evaluation.coverage(rows, "s", F.col("c").isNotNull(), F.col("x"), 0.5).first()
    assert (got["total"], got["measured"], got["coverage"], got["score"]) == (2, 1, 0.5, 1.0)
    assert evaluation.coverage(rows, "s", F.col("c").isNotNull(), F.col("x")).first()["score"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "c/sub").mkdir(parents=True)
    (tmp_path / "c/a.md").write_text("one\ntwo")
    (tmp_path / "c/sub/b.TXT").write_text("x")
    (tmp_path / "c/no.csv").write_text("x")
    got = {r["id"]: r["content"] for r in corpus.scan_folder(spark, str(tmp_path / "c")).collect()}
    assert got == {"a.md": "one\ntwo", "b.TXT": "x"}
    (tmp_path / "g.csv").write_text('id,document_id,query,expected_answer,evidence_text\n q1 ,d," what, now? ",yes,"said ""so"" || and"\n,,,,\n')
    row = corpus.scan_labels(spark, str(tmp_path / "g.csv")).collect()
    assert [tuple(r) for r in row] == [("q1", "d", "what, now?", "yes", 'said "so" || and', "factual")]
    (tmp_path / "bad.csv").write_text("id,query\n1,2\n")
    with pytest.raises(ValueError, match="document_id"):
        corpus.scan_labels(spark, str(tmp_path / "bad.csv"))
    table = str(tmp_path / "t")
    new = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, v long")
    assert corpus.upsert(new, table, "key", 0) == 3 and corpus.upsert(new, table, "key", 1) == 3
    assert corpus.upserted(spark, table, "key", "key string, v long").count() == 2
    assert corpus.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert corpus.grid(spark, ["f", "r", "s"], ["v", "b", "h"], ["x", None]).count() == 18
