"""Registered queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking, evaluation, retrieval
from lodestone.sources import corpus
from lodestone.sources.staging import settled, spread, staged
from lodestone.streaming import incremental

K = 5


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in ("documents", "embeddings") else rows


def units(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select(F.col("doc_id").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text"))


def questions(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"query_id": "item_id", "unit_id": "doc_id"})


def doc_token_stats(s, d):
    n = F.size(tx.tokens(F.coalesce("text", F.lit(""))))
    return read(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg(n), 6).alias("tokens_avg"))


def fixed_chunks(s, d):
    c = chunking.fixed(read(s, d, "documents"))
    return c.select("chunk_id", "doc_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "token_count")


def fixed_chunk_profile(s, d):
    docs = read(s, d, "documents")
    c = chunking.fixed(docs.select("doc_id", "text")).select("doc_id", "char_start", "char_end").join(docs.select("doc_id", "lang"), "doc_id")
    return c.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg(F.col("char_end") - F.col("char_start")), 6).alias("avg_len"))


def text_chunks(strategy):
    def run(s, d):
        c = chunking.chunk(read(s, d, "documents"), strategy)
        return c.select("chunk_id", "doc_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "token_count")

    return run


def bm25_chunk_topk(s, d):
    chunks = chunking.fixed(read(s, d, "documents")).select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("text"))
    return retrieval.bm25(chunks, questions(s, d), K).withColumnsRenamed({"query_id": "item_id", "unit_id": "chunk_id"})


def hash_embed_sparse(s, d):
    v = retrieval.hash_vectors(units(s, d), "unit_id")
    return v.select(F.col("unit_id").alias("doc_id"), "bucket", F.round("weight", 6).alias("weight"))


def vector_topk(s, d):
    rows = read(s, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    asked = rows.where(F.col("unit_id") % 20 == 0).withColumnRenamed("unit_id", "query_id")
    return retrieval.dense_top(rows, asked, 10).withColumnsRenamed({"query_id": "q_id", "unit_id": "vec_id"})


def vector_label_metrics(s, d):
    rows = read(s, d, "embeddings")
    top = vector_topk(s, d).where("q_id <> vec_id")
    kind = rows.select(F.col("vec_id"), "label")
    marked = top.join(kind, "vec_id").join(kind.select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label")), "q_id")
    hit = F.col("label") == F.col("q_label")
    per = marked.groupBy("q_id", "q_label").agg(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    return per.groupBy(F.col("q_label").alias("label")).agg(F.count("*").alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("share_same"))


def bm25_topk(s, d):
    return named(retrieval.bm25(units(s, d), questions(s, d), K))


def hash_vector_topk(s, d):
    return named(retrieval.sparse_top(units(s, d), questions(s, d), K))


def rrf_fuse(s, d):
    u, q = units(s, d), questions(s, d)
    return named(retrieval.fuse(retrieval.sparse_top(u, q, 3 * K), retrieval.bm25(u, q, 3 * K), K))


def lexical_rerank(s, d):
    q = questions(s, d)
    u = retrieval.lexical_index(units(s, d), q)
    return settled(named(retrieval.rerank(retrieval.bm25(u, q, 20), u, q, K).select("query_id", "unit_id", "rerank_score", "rank")), "reranked", u)


GATE = {"min_score": 0.60, "min_top": 0.66}


def gated(s, d):
    u, q = units(s, d), questions(s, d)
    fused = retrieval.fuse(retrieval.sparse_top(u, q, 3 * K), retrieval.bm25(u, q, 3 * K), K)
    return retrieval.gate(fused, **GATE)


def gate_decide(s, d):
    return named(retrieval.gate_report(gated(s, d), queries=questions(s, d), **GATE))


def gate_passages(s, d):
    return named(retrieval.gate_passages(gated(s, d)))


def evidence_spans(s, d):
    return evaluation.evidence_spans(read(s, d, "benchmark"), read(s, d, "documents"))


def overlap_labels(s, d):
    return evaluation.overlap_labels(evidence_spans(s, d), chunking.fixed(read(s, d, "documents")))


def doc_labels(s, d):
    return evidence_spans(s, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("unit_id"))


def retrieval_metrics(s, d):
    return named(evaluation.ranking_metrics(retrieval.bm25(units(s, d), questions(s, d), K), doc_labels(s, d), questions(s, d), K))


def config_metrics(s, d):
    q = questions(s, d)
    u = retrieval.lexical_index(units(s, d), q)
    wide = staged(retrieval.bm25(u, q, 20), "ranked")  # ranked once for both
    off, on = wide.where(F.col("rank") <= K).select("query_id", "unit_id", "rank"), retrieval.rerank(wide, u, q, K).select("query_id", "unit_id", "rank")
    slug = lambda rows, name: rows.withColumn("slug", F.lit(name))
    ranked = slug(off, "doc__bm25__norerank").unionByName(slug(on, "doc__bm25__lexical"))
    labels, asked = staged(doc_labels(s, d), "labels"), q.select("query_id")
    both = lambda rows: slug(rows, "doc__bm25__norerank").unionByName(slug(rows, "doc__bm25__lexical"))
    return settled(evaluation.ranking_metrics(ranked, both(labels), both(asked), K, extra=("slug",)), "metrics", u, wide, labels)


def config_summary(s, d):
    return config_metrics(s, d).groupBy("slug").agg(
        F.count("*").alias("questions"),
        *[F.round(evaluation.mean(F.col(c)), 6).alias(f"{c}_mean") for c in ("precision", "recall", "rr", "ndcg", "hit")],
        evaluation.nearest_rank(95, "rr").alias("rr_p95"),
    )


def rerank_pair_gain(s, d):
    m = config_summary(s, d).withColumn("retriever", F.split("slug", "__")[1])
    return m.groupBy("retriever").agg(
        F.max(F.when(F.col("slug").endswith("norerank"), F.col("rr_mean"))).alias("mrr_off"), F.max(F.when(~F.col("slug").endswith("norerank"), F.col("rr_mean"))).alias("mrr_on")
    ).withColumn("gain", F.round(F.col("mrr_on") - F.col("mrr_off"), 6))


def slice_rollup(s, d):
    rows = read(s, d, "documents").join(read(s, d, "labels"), "doc_id")
    return rows.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality_avg"), F.grouping_id().cast("long").alias("level"))


def judge_coverage(s, d):
    rows = read(s, d, "documents").select("doc_id", "source").join(read(s, d, "labels"), "doc_id", "left")
    return evaluation.coverage(rows, "source", F.col("quality").isNotNull(), F.col("quality"), 0.4).withColumnRenamed("score", "quality_avg")


def said(s, d):
    t = read(s, d, "conversations")
    answers = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("generated"))
    asked = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    later = t.where("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    return answers.join(asked, ["conv_id", "turn"], "left").join(later, ["conv_id", "turn"], "left")


def stub_judge(s, d):
    return evaluation.stub_verdicts(said(s, d)).select("conv_id", "turn", F.round("c_score", 6).alias("c_score"), F.round("f_score", 6).alias("f_score"), "correctness", "faithfulness")


def never_correct(s, d):
    v = evaluation.stub_verdicts(said(s, d))
    return v.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(evaluation.ordinal(F.col("correctness"))).alias("best")).where("best < 1")


def echo_answer(s, d):
    u, q = units(s, d), questions(s, d)
    shown = evaluation.context(retrieval.bm25(u, q, K), u)
    return q.select("query_id").join(shown, "query_id", "left").select(F.col("query_id").alias("item_id"), evaluation.echo(F.coalesce("context", F.lit("(no passages retrieved)"))).alias("answer"))


def dedup_triples(s, d):
    return read(s, d, "documents").groupBy(tx.triple_key(F.col("lang"), F.col("text")).alias("key")).agg(F.count("*").alias("copies"))


def cache_probe(s, d):
    docs = read(s, d, "documents")
    wanted = docs.select(tx.cache_key("hash-64", F.col("text")).alias("key"))
    cached = docs.join(read(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select(tx.cache_key("hash-64", F.col("text")).alias("key")).distinct()
    return corpus.cache_stats(corpus.probe(wanted, cached))


def resume_pending(s, d):
    return corpus.pending(read(s, d, "documents").select("doc_id"), read(s, d, "labels"), "doc_id")


def latency_by_type(s, d):
    return evaluation.latency_stats(read(s, d, "events"), "event_type", "value")


def latest_samples(s, d):
    return evaluation.rolling_latest(read(s, d, "events"), "event_type", ["ts", "event_id"], 1000).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def latency_windows(s, d):
    return incremental.latency_windows(read(s, d, "events"))


def threshold_tuning(s, d):
    u = units(s, d)
    asked = questions(s, d).withColumn("in_scope", F.lit(True))
    best = retrieval.sparse_top(u, asked, 1).select("query_id", F.col("sim").alias("best"))
    inside = doc_labels(s, d).select("query_id").distinct().withColumn("in_scope", F.lit(True))
    return evaluation.threshold(best.join(inside, "query_id", "left").select("query_id", "best", F.coalesce("in_scope", F.lit(False)).alias("in_scope")))


def term_idf(s, d):
    return retrieval.term_stats(units(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        doc_token_stats, fixed_chunks, fixed_chunk_profile, term_idf, bm25_topk, bm25_chunk_topk, hash_embed_sparse, vector_topk, vector_label_metrics, hash_vector_topk, rrf_fuse, lexical_rerank,
        gate_decide, gate_passages, evidence_spans, overlap_labels, retrieval_metrics, config_summary, rerank_pair_gain, slice_rollup, judge_coverage, stub_judge, never_correct, echo_answer,
        dedup_triples, cache_probe, resume_pending, latency_by_type, latest_samples, latency_windows, threshold_tuning,
    )
}
QUERIES |= {"recursive_chunks": text_chunks("recursive"), "semantic_chunks": text_chunks("semantic")}

# SQL ------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP}))"


_WORDS = r"list_filter(string_split_regex(lower(coalesce({c}, '')), '[\s\p{{Z}}\x{{85}}\x0b\x1c-\x1f]+'), lambda t: t <> '')"
_CHUNKS = """chunks AS (
  SELECT doc_id, k * 680 AS char_start, least(k * 680 + 800, length(text)) AS char_end, substr(text, k * 680 + 1, 800) AS content
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 800) / 680.0))::BIGINT)) AS k FROM documents WHERE text <> '')
  WHERE regexp_matches(substr(text, k * 680 + 1, 800), '[^\\s\\p{Z}]')
), ided AS (SELECT substr(sha1(concat_ws('|', doc_id, char_start, char_end, 'fixed')), 1, 16) AS chunk_id, * FROM chunks)"""
_IDF = "greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 1e-6)"


def _bm25(table: str, unit: str, text: str, k: int, name: str = "bm25") -> str:
    return f"""{name}_cut AS (SELECT {unit} AS unit_id, {_terms(text)} AS tokens FROM {table}),
{name}_total AS (SELECT count(*) AS n, coalesce(avg(len(tokens)), 0) AS avgdl FROM {name}_cut),
{name}_tf AS (SELECT unit_id, len, term, count(*) AS tf FROM (SELECT unit_id, len(tokens) AS len, unnest(tokens) AS term FROM {name}_cut) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
{name}_score AS (SELECT item_id, unit_id, round(sum(qtf * {_IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_df USING (term) JOIN {name}_tf USING (term), {name}_total GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, unit_id) AS rank FROM {name}_score WHERE score > 0) WHERE rank <= {k})"""


_HASH = f"""cells AS (SELECT src, id, bucket, count(*)::DOUBLE AS c FROM (
    SELECT src, id, (('0x' || substr(md5(word), 31, 2))::INT % 64)::BIGINT AS bucket FROM (
      SELECT 'd' AS src, doc_id AS id, unnest({_WORDS.format(c="text")}) AS word FROM documents
      UNION ALL SELECT 'q', item_id, unnest({_WORDS.format(c="text")}) FROM benchmark)) GROUP BY ALL),
weights AS (SELECT src, id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY src, id)) AS weight FROM cells),
sims AS (SELECT q.id AS item_id, d.id AS unit_id, round(sum(q.weight * d.weight), 6) AS sim FROM weights q JOIN weights d ON q.src = 'q' AND d.src = 'd' AND q.bucket = d.bucket GROUP BY ALL)"""


def _vector(k: int) -> str:
    return f"{_HASH}, vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, unit_id) AS rank FROM sims) WHERE rank <= {k})"


_FUSED = f"""{_vector(3 * K)}, {_bm25("documents", "doc_id", "coalesce(text, '')", 3 * K)},
both_ AS (SELECT item_id, unit_id, rank, sim FROM vector UNION ALL SELECT item_id, unit_id, rank, NULL FROM bm25),
fused_ AS (SELECT item_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused, max(sim) AS semantic_score FROM both_ GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, unit_id) AS rank FROM fused_) WHERE rank <= {K})"""
_GATED = f"""{_FUSED}, tops AS (SELECT *, max(semantic_score) OVER (PARTITION BY item_id) AS best FROM fused),
gated AS (SELECT *, best IS NULL OR (best >= 0.66 AND coalesce(semantic_score, 0) >= 0.60) AS keep FROM tops)"""
_SPANS = "spans AS (SELECT item_id, doc_id, (strpos(d.text, b.text) - 1)::BIGINT AS char_start, (strpos(d.text, b.text) - 1 + length(b.text))::BIGINT AS char_end FROM benchmark b, documents d WHERE b.text <> '' AND contains(d.text, b.text))"
_RERANKED = f"""{_bm25("documents", "doc_id", "coalesce(text, '')", 20, "wide")},
qt AS (SELECT item_id, list_distinct({_terms("text")}) AS qt FROM benchmark), ut AS (SELECT doc_id AS unit_id, list_distinct({_terms("coalesce(text, '')")}) AS ut FROM documents),
scored AS (SELECT item_id, unit_id, rank AS before, round(coalesce(len(list_intersect(qt, ut)) / nullif(len(qt), 0)::DOUBLE, 0), 6) AS rerank_score FROM wide JOIN qt USING (item_id) JOIN ut USING (unit_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, before) AS rank FROM scored) WHERE rank <= {K})"""


def _metrics(ranked: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""rel AS (SELECT item_id, count(*) AS rel FROM spans GROUP BY ALL),
got AS (SELECT {b}item_id, count(*) FILTER (rank <= {K}) AS hits, 1.0::DOUBLE / min(rank) AS rr, sum(1.0 / log2(rank + 1.0)) FILTER (rank <= {K}) AS dcg
  FROM {ranked} r JOIN spans s USING (item_id) WHERE r.unit_id = s.doc_id GROUP BY ALL)"""


_METRIC_COLUMNS = f"""round(coalesce(hits, 0) / {K}.0::DOUBLE, 6) AS precision, round(coalesce(hits / rel::DOUBLE, 0), 6) AS recall, round(coalesce(rr, 0), 6) AS rr,
  round(coalesce(dcg / list_sum(list_transform(generate_series(1, least(rel, {K})), lambda i: 1.0 / log2(i + 1.0))), 0), 6) AS ndcg, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit"""
_CONFIG = f"""{_SPANS}, {_bm25("documents", "doc_id", "coalesce(text, '')", K)}, {_RERANKED},
ranked AS (SELECT 'doc__bm25__norerank' AS slug, item_id, unit_id, rank FROM bm25 UNION ALL SELECT 'doc__bm25__lexical', item_id, unit_id, rank FROM reranked),
{_metrics("ranked", "slug")},
per AS (SELECT slug, item_id, {_METRIC_COLUMNS} FROM (SELECT item_id, unnest(['doc__bm25__norerank', 'doc__bm25__lexical']) AS slug FROM benchmark) LEFT JOIN rel USING (item_id) LEFT JOIN got USING (slug, item_id)),
summary AS (SELECT slug, count(*) AS questions, {", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}_mean" for c in ("precision", "recall", "rr", "ndcg", "hit"))}, coalesce(quantile_disc(rr, 0.95), 0) AS rr_p95 FROM per GROUP BY slug)"""
_NORM = "embedding::DOUBLE[]"
_NEAR = """unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS q_id, u.vec_id, round(list_dot_product(q.v, u.v), 6) AS sim, q.label AS q_label, u.label FROM unit q, unit u WHERE q.vec_id % 20 = 0)) WHERE rank <= 10)"""
_SAID = f"""said AS (SELECT a.conv_id, a.turn, list_distinct({_WORDS.format(c="a.text")}) AS g, list_distinct({_WORDS.format(c="q.text")}) AS c, list_distinct({_WORDS.format(c="n.text")}) AS e
  FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND q.role = 'user' LEFT JOIN conversations n ON n.conv_id = a.conv_id AND n.turn - 1 = a.turn AND n.role = 'user' WHERE a.role = 'assistant'),
scores AS (SELECT conv_id, turn, coalesce(len(list_intersect(e, g)) / nullif(len(e), 0)::DOUBLE, 0) AS cs, coalesce(len(list_intersect(g, c)) / nullif(len(g), 0)::DOUBLE, 0) AS fs FROM said)"""

ORACLES = {
    "doc_token_stats": f"SELECT lang, count(*) AS n_docs, round(avg(len({_terms("coalesce(text, '')")})), 6) AS tokens_avg FROM documents GROUP BY lang",
    "fixed_chunks": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, char_start, char_end, len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))::BIGINT AS token_count FROM ided",
    "fixed_chunk_profile": f"WITH {_CHUNKS} SELECT lang, count(*) AS chunks, round(avg(char_end - char_start), 6) AS avg_len FROM ided JOIN documents USING (doc_id) GROUP BY lang",
    "term_idf": f"WITH t AS (SELECT doc_id, unnest(list_distinct({_terms("coalesce(text, '')")})) AS term FROM documents), c AS (SELECT count(*) AS n FROM documents) SELECT term, df, round({_IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c",
    "bm25_topk": f"WITH {_bm25('documents', 'doc_id', "coalesce(text, '')", K)} SELECT item_id, unit_id AS doc_id, score, rank FROM bm25",
    "bm25_chunk_topk": f"WITH {_CHUNKS}, {_bm25('ided', 'chunk_id', 'content', K)} SELECT item_id, unit_id AS chunk_id, score, rank FROM bm25",
    "hash_embed_sparse": f"WITH {_HASH} SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM weights WHERE src = 'd'",
    "hash_vector_topk": f"WITH {_vector(K)} SELECT item_id, unit_id AS doc_id, sim, rank FROM vector",
    "vector_topk": f"WITH {_NEAR} SELECT q_id, vec_id, sim, rank FROM near",
    "vector_label_metrics": f"WITH {_NEAR}, per AS (SELECT q_id, q_label, coalesce(1.0::DOUBLE / min(rank) FILTER (label = q_label), 0) AS rr, count(*) FILTER (label = q_label) / count(*)::DOUBLE AS s FROM near WHERE q_id <> vec_id GROUP BY ALL) SELECT q_label AS label, count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg(s), 6) AS share_same FROM per GROUP BY q_label",
    "rrf_fuse": f"WITH {_FUSED} SELECT item_id, unit_id AS doc_id, fused, semantic_score, rank FROM fused",
    "lexical_rerank": f"WITH {_RERANKED} SELECT item_id, unit_id AS doc_id, rerank_score, rank FROM reranked",
    "gate_decide": f"WITH {_GATED} SELECT b.item_id, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, round(max(best), 4) AS best, CASE WHEN max(best) < 0.66 THEN 0.66::DOUBLE ELSE 0.60::DOUBLE END AS threshold, count(*) FILTER (keep) > 0 AS passed FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN gated USING (item_id) GROUP BY b.item_id",
    "gate_passages": f"WITH {_GATED} SELECT item_id, unit_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM gated WHERE keep",
    "evidence_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "overlap_labels": f"WITH {_CHUNKS}, {_SPANS} SELECT DISTINCT item_id, chunk_id FROM spans s JOIN ided c ON s.doc_id = c.doc_id AND s.char_start < c.char_end AND s.char_end > c.char_start",
    "retrieval_metrics": f"WITH {_SPANS}, {_bm25('documents', 'doc_id', "coalesce(text, '')", K)}, {_metrics('bm25')} SELECT item_id, {_METRIC_COLUMNS} FROM benchmark LEFT JOIN rel USING (item_id) LEFT JOIN got USING (item_id)",
    "config_summary": f"WITH {_CONFIG} SELECT * FROM summary",
    "rerank_pair_gain": f"WITH {_CONFIG}, p AS (SELECT 'bm25' AS retriever, max(rr_mean) FILTER (slug LIKE '%norerank') AS mrr_off, max(rr_mean) FILTER (slug NOT LIKE '%norerank') AS mrr_on FROM summary) SELECT *, round(mrr_on - mrr_off, 6) AS gain FROM p",
    "slice_rollup": "SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS quality_avg, grouping(lang, source)::BIGINT AS level FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)",
    "judge_coverage": "SELECT source, count(*) AS total, count(quality) AS measured, round(count(quality) / count(*)::DOUBLE, 6) AS coverage, round(CASE WHEN count(quality) / count(*)::DOUBLE >= 0.4 THEN avg(quality) END, 6) AS quality_avg FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "stub_judge": f"WITH {_SAID} SELECT conv_id, turn, round(cs, 6) AS c_score, round(fs, 6) AS f_score, CASE WHEN cs >= 0.75 THEN 'correct' WHEN cs >= 0.35 THEN 'partially-correct' ELSE 'incorrect' END AS correctness, CASE WHEN fs >= 0.75 THEN 'faithful' WHEN fs >= 0.35 THEN 'partially-faithful' ELSE 'unfaithful' END AS faithfulness FROM scores",
    "never_correct": f"WITH {_SAID} SELECT conv_id, count(*) AS n, max(CASE WHEN cs >= 0.75 THEN 1.0::DOUBLE WHEN cs >= 0.35 THEN 0.5 ELSE 0 END) AS best FROM scores GROUP BY conv_id HAVING max(cs) < 0.75",
    "echo_answer": f"WITH {_bm25('documents', 'doc_id', "coalesce(text, '')", 1)} SELECT item_id, CASE WHEN unit_id IS NULL THEN 'no context' ELSE substr(regexp_replace(split_part(' (source: ' || unit_id || ')' || chr(10) || d.text, chr(10) || chr(10), 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 1, 500) END AS answer FROM benchmark LEFT JOIN bm25 USING (item_id) LEFT JOIN documents d ON d.doc_id = unit_id",
    "dedup_triples": "SELECT sha1(concat_ws('|', coalesce(lang, ''), coalesce(text, ''))) AS key, count(*) AS copies FROM documents GROUP BY 1",
    "cache_probe": "WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), p AS (SELECT c.text IS NOT NULL AS found FROM documents d LEFT JOIN c ON d.text = c.text) SELECT count(*) FILTER (found) AS hits, count(*) FILTER (NOT found) AS misses, round(count(*) FILTER (found) / count(*)::DOUBLE, 4) AS hit_rate FROM p",
    "resume_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "latency_by_type": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "latest_samples": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 1000 GROUP BY event_type",
    "latency_windows": "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1, 2",
    "threshold_tuning": f"WITH {_vector(1)}, {_SPANS}, b AS (SELECT item_id, sim, item_id IN (SELECT item_id FROM spans) AS inside FROM vector), t AS (SELECT min(sim) FILTER (inside) AS wi, max(sim) FILTER (NOT inside) AS bo FROM b) SELECT round(wi, 6) AS worst_in, round(bo, 6) AS best_out, coalesce(wi > bo, false) AS separable, round(CASE WHEN wi > bo THEN bo + 0.35 * (wi - bo) END, 4) AS min_top_score, round(CASE WHEN wi > bo THEN bo + 0.35 * (wi - bo) - 0.05 END, 4) AS min_score FROM t",
}
