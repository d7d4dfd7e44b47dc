"""Order statistics, list index, ledger and collection, streams with state, keyed cache, models, quarantine."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.functions import text as tx
from lodestone.operators import ann, answering, chunking, evaluation, judging, retrieval, selection
from lodestone.operators.collection import Collection
from lodestone.plans import catalogue, workflow
from lodestone.sources import corpus
from lodestone.sources.keyed_cache import KeyedCache
from lodestone.sources.ledger import Ledger
from lodestone.streaming import incremental, stateful

# Order statistics ---------------------------------------------------------------------------------


@pytest.mark.parametrize("limit, bins", [(1 << 16, 4096), (10, 16)])
def test_order_statistics(spark, monkeypatch, limit, bins):
    monkeypatch.setattr(selection, "LIMIT", limit)
    monkeypatch.setattr(selection, "BINS", bins)
    rng = random.Random(limit)
    odd = [math.inf, -math.inf, math.nan, 1e308, -1e308, 5e-324, 0.0, -0.0]
    groups = {"even": [i / 7 for i in range(500)], "skewed": [2.0**i for i in range(-60, 60, 4)], "odd": odd * 3 + [1.5] * 40, None: [rng.choice([1.0, 2.0, 3.0]) for _ in range(90)], "one": [4.0], "far": [1e300] + [1 + i / 1e9 for i in range(60)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("even", None)]
    frame = spark.createDataFrame(rows, "kind string, v double").repartition(5)
    places = {f"p{p}": selection.nearest(p) for p in (0, 1, 50, 95, 100)} | {"third": lambda n: F.expr("least(2, n - 1)")}
    got = {r.kind: r for r in selection.order_statistics(frame, ["kind"], "v", places, mean=F.avg("v")).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = sorted(vs, key=lambda v: (math.isnan(v), v))
        at = {f"p{p}": want[max(0, math.ceil(p * len(want) / 100) - 1)] for p in (0, 1, 50, 95, 100)} | {"third": want[min(2, len(want) - 1)], "low": want[0], "high": want[-1]}
        assert got[k].n == len(vs)
        for name, v in at.items():
            assert got[k][name] == v or math.isnan(got[k][name]) and math.isnan(v), (k, name)


def test_order_statistics_of_integers_and_days(spark, monkeypatch):
    monkeypatch.setattr(selection, "LIMIT", 8)
    monkeypatch.setattr(selection, "BINS", 6)
    big = 1 << 60
    frame = spark.createDataFrame([(i % 2, big + i) for i in range(40)], "g int, v long")
    got = {r.g: r for r in selection.order_statistics(frame, ["g"], "v", {"mid": lambda n: F.expr("n div 2")}).collect()}
    assert got[0].mid == big + 20 and got[1].mid == big + 21 and got[0].low == big
    assert selection.order_statistics(frame.limit(0), ["g"], "v", {"mid": selection.nearest(50)}).count() == 0
    stats = evaluation.latency_stats(frame, "g", "v").orderBy("g").first()
    assert (stats.n, stats.p50, stats.p99) == (20, big + 18, big + 38)


def test_a_hot_group_is_spread(spark, monkeypatch):
    """No stage that reads a group's values does so in one task: the histogram's shuffle holds bins."""
    monkeypatch.setattr(selection, "LIMIT", 100)
    frame = spark.range(50_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    (row,) = selection.order_statistics(frame, ["g"], "v", {"p50": selection.nearest(50)}).collect()
    assert row.p50 == 24_999


# List index ---------------------------------------------------------------------------------------


def test_recall_and_whole_lists(spark, sf):
    index, asked = workflow.list_index(spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert index.rows.count() == index.rows.select("unit_id").distinct().count() == n
    exact = catalogue.vector_topk(spark, sf).withColumnsRenamed({"q_id": "query_id", "vec_id": "unit_id"})
    few = ann.search(index, asked, 10, ann.calibrate(index, 10))
    row = ann.recall(few, exact).first()
    assert row.recall >= 0.9 and row.wanted == exact.count()
    assert sorted(map(tuple, ann.search(index, asked, 10, 10**6).collect())) == sorted((r.query_id, r.unit_id, r.sim, r["rank"]) for r in exact.collect())


def test_lists_prune_and_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 16)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 3)
    rng = np.random.default_rng(2)
    middles = np.eye(8)
    rows = [(i, (middles[i % 8] + 0.01 * rng.standard_normal(8)).tolist()) for i in range(400)] + [(1000 + i, middles[0].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [math.nan] * 8), (2003, [0.0] * 8)]
    units = spark.createDataFrame(rows, "unit_id long, vector array<double>")
    index = ann.build(units, lists=8)
    assert index.rows.count() == 601 and index.parts.max() > 10
    queries = units.where("unit_id < 20").withColumnRenamed("unit_id", "query_id")
    need = ann.calibrate(index, 5)
    assert need <= 2
    got = ann.search(index, queries, 5, need)
    exact = retrieval.dense_top(index.rows, queries, 5)
    assert ann.recall(got, exact).first().recall >= 0.9
    one = ann.search(index, queries.where("query_id = 1"), 5, 1)
    assert re.search(r"PartitionFilters: \[[^]]*list#", one._jdf.queryExecution().executedPlan().toString())
    assert ann.search(ann.build(units.limit(0)), queries, 5, 2).count() == 0
    words = ann.build(units.where("unit_id < 400").withColumn("unit_id", F.concat(F.lit("u"), "unit_id")), lists=8)
    assert {r.unit_id[0] for r in ann.search(words, queries, 2, ann.calibrate(words, 2)).collect()} == {"u"}


# Ledger and collection ----------------------------------------------------------------------------


def test_half_written_and_repeated_batches(spark, tmp_path):
    made = Ledger(spark, str(tmp_path / "l"), {"a": "k long", "b": "k long, p int"}, {"b": "p"})
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long").withColumn("p", F.lit(1))
    made.write("a", 0, rows(1, 2))
    assert made.read("a").count() == 0 and not made.done(0)
    made.write("a", 0, rows(3))
    made.write("b", 0, rows(4))
    assert made.commit(0, {"x": 1}) and not made.commit(0, {"x": 2})
    assert [tuple(r) for r in made.read("a").collect()] == [(3, 0)] and [(r.k, r.p, r.batch) for r in made.read("b").collect()] == [(4, 1, 0)]
    made.write("a", 7, rows(9))
    assert made.read("a").count() == 1
    made.write("b", 7, rows(9))
    made.commit(7, {})
    assert sorted(r.k for r in made.read("a").collect()) == [3, 9] and made.notes().count() == 2
    for t, k in (("a", 5), ("b", 6)):
        made.write(t, -8, rows(k))
    made.commit(-8, {})
    made.sweep()
    assert [r.k for r in made.read("a").collect()] == [5] and made.done(7) and made.done(3) and not made.done(8)


def plain_bm25(made, queries, k=5):
    units = made.chunks().select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("text"))
    return sorted(map(tuple, retrieval.bm25(units, queries, k).select("query_id", "unit_id", "score", "rank").collect()))


def same(made, queries):
    got = sorted(map(tuple, made.bm25(queries).select("query_id", "unit_id", "score", "rank").collect()))
    assert got == plain_bm25(made, queries)
    df = Counter()
    for r in made.chunks().select(F.array_distinct(tx.tokens(F.col("content"))).alias("t")).collect():
        df.update(r.t)
    kept = {r.term: r.df for r in made.ledger.read("counters").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    assert kept == dict(df)
    return got


def test_collection_stays_equal_to_a_rebuilt_one(spark, tmp_path):
    made = Collection(spark, str(tmp_path / "c"), size=60, overlap=10)
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red fox fox"), (2, "blue whale"), (3, "nothing known"), (4, "")], "query_id long, text string")
    assert made.bm25(queries).count() == 0 and made.chunks().count() == 0
    long = "the red fox runs over the hill and far away. " * 6
    report = made.ingest(docs((1, long), (2, "a blue whale"), (3, "a red whale"), (None, "lost"), (3, "a zebra")), 0)
    assert report["documents"] == report["new"] == 3 and report["replaced"] == 0 and report["chunks"] == report["vectors"] == made.chunks().count()
    assert same(made, queries)
    # again, the same batch and the same documents
    assert made.ingest(docs((9, "never")), 0) is None
    assert made.ingest(docs((2, "a blue whale")), 1)["new"] == 0
    # one changes, one goes, one comes
    report = made.ingest(docs((1, "a red car"), (2, None), (4, "blue blue fox")), 2)
    assert (report["new"], report["replaced"]) == (3, 2)
    before = same(made, queries)
    assert {r.doc_id for r in made.chunks().collect()} == {1, 3, 4}
    near = made.nearest(queries, 1).collect()
    assert {r.query_id for r in near} == {1, 2, 3}
    # a batch that fails half-way leaves nothing
    broken = Collection(spark, str(tmp_path / "c"), size=60, overlap=10, embedder=lambda rows, key: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.ingest(docs((5, "red red red")), 3)
    assert same(made, queries) == before
    assert made.ingest(docs((5, "red red red")), 3)["new"] == 1
    after = same(made, queries)
    made.compact()
    assert same(made, queries) == after and len(made.ledger.batches()) == 1
    assert made.ingest(docs((5, "late")), 2) is None
    made.ingest(docs((5, "grey")), 4)
    assert same(made, queries) != after
    health = made.health().first()
    assert (health.documents, health.chunks, health.batches, health.chunker) == (5, 4, 2, "fixed")
    made.reset()
    assert made.chunks().count() == 0 and made.bm25(queries).count() == 0
    made.ingest(docs((6, "red fox")), 5)
    assert [r[0] for r in same(made, queries)] == [1]


def test_only_folders_of_wanted_terms_are_read(spark, tmp_path):
    made = Collection(spark, str(tmp_path / "c"))
    made.ingest(spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text")), 0)
    plan = made.bm25(spark.createDataFrame([(1, "word7")], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^]]*bucket#", plan)) >= 2


def test_streamed_ingest(spark, sf, tmp_path):
    made = Collection(spark, str(tmp_path / "c"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    folder = str(tmp_path / "in")
    for _ in range(2):  # the second time all is there
        docs.write.mode("append").parquet(folder)
        incremental.ingest(incremental.stream(spark, folder, "doc_id long, text string"), made, str(tmp_path / "state")).awaitTermination()
    want = chunking.fixed(docs.groupBy("doc_id").agg(F.min("text").alias("text")))
    assert made.chunks().select("chunk_id").exceptAll(want.select("chunk_id")).isEmpty() and made.chunks().count() == want.count()
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    assert sorted(map(tuple, made.bm25(asked).select("query_id", "unit_id", "score", "rank").collect())) == plain_bm25(made, asked)


# Streams with state -------------------------------------------------------------------------------


@pytest.mark.parametrize("items", [False, True])
def test_newest_equals_batch_in_any_order(spark, tmp_path, items):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "cold", None]), i, rng.randrange(60), None if i % 9 == 0 else i / 3) for i in range(400)]
    rows += [("hot", 3, 59, 7.0), (None, None, 5, 1.0), ("cold", 1000, None, 2.0)]
    shape = "kind string, id long, s long, v double"
    folder = tmp_path / "in"
    for part in range(3):  # later files hold older rows, too
        spark.createDataFrame(rows[part::3], shape).coalesce(1).write.mode("append").parquet(str(folder))
    source = stateful.with_state(spark).readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("t", F.timestamp_seconds("s"))
    got = {}

    def keep(part, n):
        for r in part.collect():
            got.setdefault(r.key, {}).setdefault(n, []).append(r)

    stateful.newest(source, "kind", "t", "id", "v", 20, items).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {len(v) for v in got.values()} == {3}
    for kind in ("hot", "cold", None):
        best = {}
        for k, i, s, v in rows:
            if k == kind and i is not None and s is not None and (str(i) not in best or best[str(i)][0] < s):
                best[str(i)] = (s, v)
        want = sorted(((s, i, v) for i, (s, v) in best.items()), reverse=True)[:20]
        last = got[kind][max(got[kind])]
        if items:
            assert [(r.at // 10**6, r.id) for r in last] == [(s, i) for s, i, _ in want]
        else:
            some = [v for _, _, v in want if v is not None]
            assert (last[0].n, last[0].mean) == (len(want), pytest.approx(sum(some) / len(some)))


# Keyed cache --------------------------------------------------------------------------------------


def test_probe_leaves_the_cache_where_it_is(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = KeyedCache(spark, buckets=8)
        put = lambda n, *ks: cache.put_many(spark.createDataFrame([(k, [float(n)]) for k in ks], "key string, vector array<double>"), n)
        put(1, "a", "b", "b")
        put(2, "b", "c", None)
        assert {r.key: r.vector for r in cache.rows().collect()} == {"a": [1.0], "b": [2.0], "c": [2.0]}
        wanted = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("x", 4), (None, 5)], "key string, n long")
        got = cache.probe(wanted)
        assert {(r.n, r.found, tuple(r.vector or ())) for r in got.collect()} == {(1, True, (1.0,)), (2, True, (2.0,)), (3, True, (2.0,)), (4, False, ()), (5, False, ())}
        plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "put" in line)
        depth = len(plan[scan]) - len(plan[scan].lstrip(" :+-"))
        # what stands above the cache's scan up to the join with the wanted keys
        above = []
        for line in reversed(plan[:scan]):
            own = len(line) - len(line.lstrip(" :+-"))
            if own < depth:
                above.append(line)
                depth = own
            if "Join" in line and own <= depth:
                break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above)
        seen = []

        def embed(rows):
            seen.append(sorted(r.text for r in rows.collect()))
            return rows.select("key", F.array(F.length("text").cast("double")).alias("vector"))

        asked = spark.createDataFrame([("a", "aa"), ("n", "nnn"), ("n", "nnn")], "key string, text string")
        assert sorted((r.key, r.vector[0], r.found) for r in cache.filled(asked, embed, 3).collect()) == [("a", 1.0, True), ("n", 3.0, False), ("n", 3.0, False)]
        assert seen == [["nnn"]] and cache.probe(asked).where("found").count() == 3
        cache.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Models -------------------------------------------------------------------------------------------


def length_scores():
    return lambda asked, shown: np.array([float(len(s)) for s in shown])


def counting_vectors():
    return lambda texts: np.array([[float(t.count("a")), float(t.count("b"))] for t in texts])


def test_models_as_arguments(spark):
    units = spark.createDataFrame([("u1", "fox a"), ("u2", "fox bbbb"), ("u3", "fox aaa bb")], "unit_id string, text string")
    asked = spark.createDataFrame([(1, "fox b"), (2, "fox aaaa")], "query_id long, text string")
    best = retrieval.retrieve(units, asked, "bm25", 2, scorer=models.scores(length_scores, 2)).where("rank = 1").collect()
    assert {r.unit_id for r in best} == {"u3"}
    embed = lambda rows, key: rows.select(key, models.vectors(counting_vectors, 2)("text").alias("vector"))
    first = {r.query_id: r.unit_id for r in retrieval.retrieve(units, asked, "vector", 1, embedder=embed).collect()}
    assert first == {1: "u2", 2: "u1"}
    say = models.answers(lambda: lambda texts: [t[-5:] for t in texts], 2)
    got = {r.query_id: r.answer for r in answering.answer(units, asked, "bm25", generator=say).collect()}
    assert got == {1: "fox b", 2: " aaaa"}


def test_judge_asks_each_triple_once(spark):
    def make():
        def run(texts):
            return [None if "silent" in t else "no" if "odd" in t else '{"correctness": "correct", "faithfulness": "faithful", "explanation": "' + str(len(texts)) + '"}' for t in texts]

        return run

    rows = spark.createDataFrame([(i, "e", g, "c") for i, g in enumerate(["same"] * 50 + ["odd", "silent", None])], "n long, expected string, generated string, context string").coalesce(1)
    got = {r.n: r for r in judging.judge(rows, models.answers(make, 64)).collect()}
    assert len(got) == 53 and {got[i].key for i in range(50)} == {got[0].key}
    assert all(got[i].measured and got[i].correctness == "correct" and int(got[i].explanation) <= 4 for i in range(50))
    assert (got[50].measured, got[50].explanation) == (False, "judge error: no verdict") and got[51].explanation == "judge error: no answer"
    back = spark.createDataFrame(list(got.values()))
    assert {r.n for r in back.where(evaluation.needs_judging(F.col("measured"), F.col("correctness"), F.col("explanation"))).collect()} == {50, 51}


# Gate, evidence, overlap, sources -----------------------------------------------------------------


def test_gate_passed_means_something_is_left(spark):
    shape = "query_id long, unit_id string, rank long, semantic_score double"
    rows = [(1, "a", 1, 0.7), (2, "b", 1, 0.5), (3, "c", 1, None), (4, "d", 1, 0.9), (4, "e", 2, 0.1), (4, "f", 3, 0.3)]
    ranked, asked = spark.createDataFrame(rows, shape), spark.createDataFrame([(q,) for q in range(1, 6)], "query_id long")
    how = {"min_score": 0.8, "min_top": 0.66}
    got = {r.query_id: tuple(r)[1:] for r in retrieval.gate_report(retrieval.gate(ranked, **how), queries=asked, **how).collect()}
    assert got == {1: (0, 1, 0.7, 0.8, False), 2: (0, 1, 0.5, 0.66, False), 3: (1, 0, None, 0.8, True), 4: (1, 2, 0.9, 0.8, True), 5: (0, 0, None, 0.8, False)}
    filled = retrieval.gate(ranked.where("query_id = 4"), keep_at_least=3, **how)
    assert [r.unit_id for r in retrieval.gate_passages(filled).orderBy("rank").collect()] == ["d", "f", "e"]


@pytest.mark.parametrize("anchors, short", [(20_000, 256), (1, 2)])
def test_evidence_is_found_whatever_its_words(spark, monkeypatch, anchors, short):
    monkeypatch.setattr(evaluation, "ANCHORS", anchors)
    monkeypatch.setattr(evaluation, "SHORT", short)
    texts = ["alpha beta gamma delta", "xalpha beta  gamma deltay", "beta\ngamma", "a", "été à la mer bleue", "", None, "alpha beta gamma delta alpha beta gamma delta", "tail word of itself word of itself more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = ["alpha beta gamma delta", "lpha beta  gamma delt", "a", "beta gamma", "beta", "té à la mer", " beta ", "", None, "\ngam", "word of itself more", "a", "b c d e f"]
    examples = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((i, d, t.index(x), t.index(x) + len(x)) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t)
    assert sorted(map(tuple, evaluation.evidence_spans(examples, docs).collect())) == want


def test_overlap_in_one_long_document(spark):
    rng = random.Random(8)
    ranges = lambda n, size: [(f"{i}", rng.choice([1, 1, 2, None]), a := rng.randrange(3000), a + rng.randrange(size)) for i in range(n)]
    spans, chunks = ranges(60, 900), ranges(300, 50)
    s = spark.createDataFrame(spans, "item_id string, doc_id long, char_start int, char_end int")
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id long, char_start int, char_end int")
    want = sorted({(i, k) for i, d, a, b in spans for k, e, x, y in chunks if d is not None and d == e and a < y and b > x})
    for width in (1, 7, 4096):
        assert sorted(map(tuple, evaluation.overlap_labels(s, c, width).collect())) == want


def test_records_that_cannot_be_read_are_set_aside(spark, tmp_path):
    (tmp_path / "g.csv").write_text("id,document_id,query,expected_answer,evidence_text\nq1,d,a,b,c\nq2,d,a\nq3,d,a,b,c,too many\nq4,d,a,b,c\n")
    aside = str(tmp_path / "aside")
    rows = corpus.scan_labels(spark, str(tmp_path / "g.csv"), aside)
    assert [r.id for r in rows.orderBy("id").collect()] == ["q1", "q4"]
    assert corpus.quarantined(spark, aside).first().n == 2
    for name, text in (("a", '{"slug": "a", "n": 1}'), ("b", "{broken"), ("c", '{"slug": "c", "n": 3}')):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "summary.json").write_text(text)
    got = corpus.scan_summaries(spark, str(tmp_path / "r"), "slug string, n long", aside)
    assert sorted((r.slug, r.n) for r in got.collect()) == [("a", 1), ("c", 3)]
    assert sum(r.n for r in corpus.quarantined(spark, aside).collect()) == 3


def test_artifacts_and_upserts_twice(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "slug string, v long")
    path = str(tmp_path / "art")
    corpus.write_artifacts(rows(("a", 1), ("b", 2)), path)
    corpus.write_artifacts(rows(("a", 3)), path)
    assert sorted((r.slug, r.v) for r in spark.read.json(path).collect()) == [("a", 3), ("b", 2)]
    table = str(tmp_path / "t")
    for batch, new in ((0, rows(("a", 1), ("a", 2))), (0, rows(("z", 9))), (1, rows(("a", 5), ("c", 6)))):
        assert corpus.upsert(new, table, "slug", batch) == new.count()
    assert sorted((r.slug, r.v) for r in corpus.upserted(spark, table, "slug", "slug string, v long").collect()) == [("a", 1), ("c", 6)]
    wanted, done = rows(("a", 1), ("b", 1)), rows(("a", 2), ("b", 1))
    assert [r.slug for r in corpus.pending(wanted, done, ["slug", "v"]).collect()] == ["a"] and corpus.pending(wanted, done, "slug").count() == 0
