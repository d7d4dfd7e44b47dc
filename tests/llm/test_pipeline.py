"""The pipeline against the stages' brute-force forms, stage by stage on what each was given."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import apportionment, compression_rules, wavelet_tokens
from lodestone.llm import qgram_decontam as qd

from .test_simple_ops import brute_components, brute_fingerprint, split
from .test_tokens_decontam import fewest


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    rows = [r for r in rows if compression_rules.judge(r["text"])[6]]
    roots = brute_components([brute_fingerprint(r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [qd.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for r in rows:
        text = qd.normalise(r["text"])
        near = [x for x in items if len({x[i : i + 8] for i in range(len(x) - 7)} & {text[i : i + 8] for i in range(len(text) - 7)}) > 8]
        if not any(x in text or (len(text) < 3000 and fewest(x, text) <= qd.budget(len(x))) for x in near):
            clean.append(r)
    kept = spark.createDataFrame(clean, docs.schema)
    taken = {r["doc_id"]: r["taken"] for r in apportionment.mix(kept).collect() if r["taken"]}
    mixed = corpus_pipeline.mix(spark, kept, sf).collect()
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(split(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter(taken)
    tok = Tokenizer.from_file(wavelet_tokens.tokenizer_path())
    want = sorted((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names
        assert stage(spark, docs.where("false"), sf).count() == 0
