"""Words of texts on workers: hashes, terms, anchors; BM25 by products of weights."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import hashes_of, word_hashes
from lodestone.operators import evaluation, retrieval
from lodestone.operators.collection import Collection
from lodestone.plans import workflow


def test_hashes_of_words():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé漢😀") for _ in range(rng.randrange(0, 70))) for _ in range(3000)] + ["a" * n for n in range(50, 130)] * 2
    want = [int.from_bytes(hashlib.md5(w.encode()).digest()[-8:]) for w in words]
    assert hashes_of(words).tolist() == want == word_hashes(words).tolist() and len(hashes_of([])) == 0


def test_an_index_has_the_terms_of_spark(spark):
    texts = ["The Cat sat on the mat; the CAT's 3 mats", "", None, "naïve Kelvin K and İstanbul a1b2", "x" * 9000 + " cat"] * 3
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string")
    asked = spark.createDataFrame([(1, "cat mat k"), (2, "stanbul a1b2 the")], "query_id long, text string")
    got = {r.unit_id: (r.len, r.hits) for r in retrieval.lexical_index(units, asked).collect()}
    for r in units.select("unit_id", F.size(tx.tokens(F.col("text"))).alias("len"), tx.tokens(F.col("text")).alias("ts")).collect():
        assert got[r.unit_id] == (r.len, None if r.ts is None else [t for t in r.ts if t in {"cat", "mat", "k", "stanbul", "a1b2"}])


def test_bm25_by_products_equals_joins(spark, monkeypatch):
    rng = random.Random(2)
    units = spark.createDataFrame([(f"u{i:04d}", " ".join(rng.choices("abcdefghijkl xy", k=rng.randrange(0, 30)))) for i in range(600)], "unit_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices("bcdeyz", k=4))) for i in range(9)] + [(99, "zz"), (100, None)], "query_id int, text string")
    rows = lambda found: sorted(map(tuple, found.select("query_id", "unit_id", "score", "rank").collect()))
    found = retrieval.bm25(retrieval.lexical_index(units, asked), asked, 7)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = rows(found)
    monkeypatch.setattr(retrieval, "WEIGHTS", 0)
    assert got == rows(retrieval.bm25(units, asked, 7)) and len(got) > 50
    monkeypatch.undo()
    twice = units.union(units.limit(300))  # ids that occur twice: their scores are summed
    both = rows(retrieval.bm25(twice, asked, 7))
    monkeypatch.setattr(retrieval, "WEIGHTS", 0)
    assert both == rows(retrieval.bm25(twice, asked, 7))


def test_anchors_of_a_text():
    anchors, rng = ["b c", "c", "d d", "q"], random.Random(3)
    texts = ["".join(rng.choices("bcd \n\t ", k=40)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])
    got = {(r["doc_id"], r["anchor"]) for part in evaluation._met(anchors)(iter([batch])) for r in part.to_pylist()}
    want = set()
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        want |= {(i, a) for a in anchors if a in words or a in [f"{x} {y}" for x, y in zip(words, words[1:])]}
    assert got == want


def test_a_sweep_has_one_chunkers_texts_at_a_time(spark, sf, monkeypatch):
    """Texts are written without columns that nobody reads, and gone when the next chunker's are written."""
    kept, gone = [], []
    stage, drop = workflow.staged, workflow.dropped
    monkeypatch.setattr(workflow, "staged", lambda rows, tag: (kept.append((tag, rows.columns, len(gone))), stage(rows, tag))[1])
    monkeypatch.setattr(workflow, "dropped", lambda *tables: (gone.append(len(tables)), drop(*tables))[1])
    workflow.sweep_metrics(spark, sf, ("fixed", "recursive"))
    chunks = [(columns, n) for tag, columns, n in kept if tag.startswith("chunks")]
    assert [n for _, n in chunks] == [0, 1] and all("token_count" not in columns for columns, _ in chunks)


def test_a_collections_postings_hold_no_ids_and_score_alike(spark, tmp_path, monkeypatch):
    """Ids of chunks are worked out on reading, by the chunker of their batch; replaced documents are left out by products and by joins."""
    rng = random.Random(5)
    texts = lambda n: spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 900)))) for i in range(n)], "doc_id long, text string")
    made = Collection(spark, str(tmp_path / "c"))
    made.ingest(texts(40), 0)
    Collection(spark, str(tmp_path / "c"), chunker="recursive").ingest(texts(15), 1)
    assert "unit_id" not in made.ledger.read("postings").columns
    assert all(f.endswith(".zstd.parquet") for f in made.ledger.read("postings").inputFiles() + made.ledger.read("chunks").inputFiles())
    asked = spark.createDataFrame([(1, "b c c"), (2, "h zz"), (3, "zz")], "query_id long, text string")
    rows = lambda found: sorted(map(tuple, found.select("query_id", "unit_id", "score", "rank").collect()))
    got, ids = rows(made.bm25(asked, 6)), {r.chunk_id for r in made.chunks().collect()}
    assert len(got) == 12 and {g[1] for g in got} <= ids
    monkeypatch.setattr(retrieval, "WEIGHTS", 0)
    assert got == rows(made.bm25(asked, 6)) == rows(retrieval.bm25(made.chunks().select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("text")), asked, 6))
