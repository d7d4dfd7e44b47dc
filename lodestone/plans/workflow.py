"""Registered queries on whole workflows: sweeps over configurations, labels, verdicts, answers, tuning, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import ann, answering, chunking, evaluation, judging, retrieval
from lodestone.operators.collection import Collection
from lodestone.plans import catalogue as cat
from lodestone.plans.catalogue import K, named, questions, read, units
from lodestone.sources import corpus
from lodestone.sources.keyed_cache import KeyedCache
from lodestone.sources.staging import dropped, scratch, settled, staged
from lodestone.streaming import stateful

FETCH = 20
RETRIEVERS = ("vector", "bm25", "hybrid")


def ranked_lists(chunks: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """(retriever, fetch, query_id, unit_id, rank): each retriever's k and candidate lists, from one search of each kind; a written table.
    ``index``: the chunks' lexical index."""
    lists = {
        "vector": staged(retrieval.sparse_top(chunks, asked, 3 * FETCH), "vector"),
        "bm25": staged(retrieval.bm25(index, asked, 3 * FETCH), "bm25"),
    }
    out = None
    for fetch in (K, FETCH):
        upto = lambda name, n: lists[name].where(F.col("rank") <= n)
        found = {name: upto(name, fetch) for name in lists}
        found["hybrid"] = retrieval.fuse(upto("vector", 3 * fetch), upto("bm25", 3 * fetch), fetch)
        for name in RETRIEVERS:
            rows = found[name].select(F.lit(name).alias("retriever"), F.lit(fetch).alias("fetch"), "query_id", "unit_id", "rank")
            out = rows if out is None else out.unionByName(rows)
    return settled(out, "lists", *lists.values())


def sweep_metrics(s, d, chunkers) -> DataFrame:
    """(slug, query_id, metrics) of chunkers x retrievers x with and without reranker, gate off; a written table. A chunk is relevant
    where it meets the question's evidence."""
    asked, spans = questions(s, d), staged(cat.evidence_spans(s, d), "spans")
    grid = corpus.grid(s, list(chunkers), list(RETRIEVERS), [None, "lexical"])
    ranked = labels = None
    spent = [spans]
    for name in chunkers:
        chunks = staged(chunking.chunk(read(s, d, "documents"), name).select("chunk_id", "doc_id", "char_start", "char_end", "content"), f"chunks-{name}")
        texts = chunks.select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("text"))
        index = retrieval.lexical_index(texts, asked)
        found = ranked_lists(texts, asked, index)
        shown = found.where(F.col("fetch") == K).select("retriever", F.lit("norerank").alias("reranker"), "query_id", "unit_id", "rank")
        # the reranker sees all retrievers' candidates at once, keyed by retriever and question; the index has what it asks of a chunk
        wide = found.where(F.col("fetch") == FETCH).withColumn("query_id", F.struct("retriever", "query_id"))
        each = wide.select("query_id").distinct().select("query_id", F.col("query_id.query_id").alias("item")).join(asked.select(F.col("query_id").alias("item"), "text"), "item")
        best = retrieval.rerank(wide.select("query_id", "unit_id", "rank"), index, each.select("query_id", "text"), K)
        best = best.select("query_id.retriever", F.lit("lexical").alias("reranker"), F.col("query_id.query_id").alias("query_id"), "unit_id", "rank")
        rows = staged(shown.unionByName(best).withColumn("chunker", F.lit(name)), "ranked")
        marks = staged(evaluation.overlap_labels(spans, chunks).select(F.lit(name).alias("chunker"), F.col("item_id").alias("query_id"), F.col("chunk_id").alias("unit_id")), "labels")
        dropped(chunks, index, found)  # one chunker's texts are on disk at a time
        spent += [rows, marks]
        ranked = rows if ranked is None else ranked.unionByName(rows)
        labels = marks if labels is None else labels.unionByName(marks)
    slug = F.concat_ws("__", "chunker", "retriever", "reranker")
    some = F.broadcast(grid.select("chunker", "slug"))  # at most 18 rows
    every = grid.select("slug").crossJoin(asked.select("query_id"))  # one row for each configuration and question
    return settled(evaluation.ranking_metrics(ranked.withColumn("slug", slug), labels.join(some, "chunker"), every, K, extra=("slug",)), "metrics", *spent)


def sweep(chunkers):
    def run(s, d):
        return sweep_metrics(s, d, chunkers).groupBy("slug").agg(
            F.count("*").alias("questions"),
            *[F.round(evaluation.mean(F.col(c)), 6).alias(f"{c}_mean") for c in ("precision", "recall", "rr", "ndcg", "hit")],
            evaluation.nearest_rank(95, "rr").alias("rr_p95"),
        )

    return run


def evidence_resolution(s, d):
    """Labels made of the tables: an item's document is the first that holds it; its evidence is the item's beginning
    and its rest, the latter with its blanks doubled."""
    first = cat.evidence_spans(s, d).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    rest = F.replace(F.substring("text", 41, 2**31 - 1), F.lit(" "), F.lit("  "))
    made = read(s, d, "benchmark").join(first, "item_id", "left").select("item_id", "doc_id", F.concat(F.substring("text", 1, 40), F.lit(" || "), rest).alias("evidence"))
    return evaluation.resolve_evidence(made, read(s, d, "documents"))


def answer_or_refuse(s, d):
    return named(answering.answer(units(s, d), questions(s, d), gate=cat.GATE))


def prompt_rows(s, d):
    u, q = units(s, d), questions(s, d)
    rows = answering.prompts(q, retrieval.bm25(u, q, 1), u)
    return named(rows.select("query_id", "n_passages", F.sha2(F.concat("system", F.lit("\n"), "user"), 256).alias("prompt_sha256")))


def scored(s, d):
    best = retrieval.sparse_top(units(s, d), questions(s, d), 1).select("query_id", F.col("sim").alias("best"))
    inside = cat.doc_labels(s, d).select("query_id").distinct().withColumn("in_scope", F.lit(True))
    return staged(best.join(inside, "query_id", "left").select("query_id", "best", F.coalesce("in_scope", F.lit(False)).alias("in_scope")), "scores")


def score_distribution(s, d):
    return evaluation.distribution(scored(s, d), "in_scope", "best")


def threshold_overlap(s, d):
    return named(evaluation.overlapping(scored(s, d)))


def value_distribution(s, d):
    return evaluation.distribution(read(s, d, "events"), "event_type", "value")


def evaluations(s, d) -> DataFrame:
    """An answer's verdict is measured where a user turn follows it; the others are pending."""
    rows = evaluation.stub_verdicts(cat.said(s, d)).withColumn("measured", F.col("expected").isNotNull())
    known = lambda c: F.when(F.col("measured"), F.col(c)).alias(c)
    return rows.select(
        "conv_id", "turn", tx.triple_key(F.col("context"), F.col("generated")).alias("key"), "measured", known("correctness"), known("faithfulness"),
        F.when(F.col("measured"), "").otherwise("judge error: nothing follows").alias("explanation"),
        tx.count_tokens(F.coalesce("context", F.lit(""))).alias("prompt_tokens"), tx.count_tokens(F.coalesce("generated", F.lit(""))).alias("completion_tokens"),
    )


def written_back(s, d):
    rows = staged(evaluations(s, d), "evaluations")
    known = corpus.first_of(rows.where("measured").select("key", "conv_id", "turn", *judging.VERDICT), "key", "conv_id", "turn")
    return judging.write_back(rows, known)


def verdict_write_back(s, d):
    return written_back(s, d).select("conv_id", "turn", "measured", "correctness", "faithfulness", "explanation")


def rebuilt_summary(s, d):
    return judging.rebuilt_summary(written_back(s, d), "turn")


def ordered_dedup(s, d):
    docs = read(s, d, "documents")
    return corpus.first_of(docs.select(tx.cache_key("text", F.col("text")).alias("key"), "doc_id", "source"), "key", "doc_id")


def index_dump(s, d):
    path = scratch(s, "index")
    corpus.index_write(chunking.fixed(read(s, d, "documents")), path)
    rows = corpus.index_dump(s, path, "fixed")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"))


def cache_newest(s, d):
    used = read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return corpus.evict(used, "user_id", "last_used")


def leaderboard(s, d):
    """Sources by mean quality, those with too few labels last and without a figure."""
    best = cat.judge_coverage(s, d).withColumn("slug", F.col("source"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("quality_avg"), "slug")).cast("long")  # one row a source
    cell = F.coalesce(F.format_string("%.3f", F.round("quality_avg", 3)), F.lit("--"))
    return best.select(place.alias("place"), "source", F.when(F.col("quality_avg").isNull(), "--").otherwise(cell).alias("cell"))


def json_repair(s, d):
    broken = F.concat(F.lit("```json\n"), F.replace(F.col("props"), F.lit("}"), F.lit(",}")), F.lit("\n```"))
    return read(s, d, "events").select("event_id", F.try_element_at(tx.json_object(broken), F.lit("k")).try_cast("long").alias("k"))


def rolling_latency(s, d):
    rows = evaluation.rolling_mean(read(s, d, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "event_id", "value")
    return rows.select("event_id", F.round("mean", 6).alias("mean_last_1000"))


def sweep_slices(s, d):
    """Means over the sweep of fixed chunks by retriever, by reranker, by both, and over all, in one aggregation."""
    rows = sweep_metrics(s, d, ("fixed",))
    part = lambda i: F.split("slug", "__")[i]
    rows = rows.withColumns({"chunker": part(0), "retriever": part(1), "reranker": part(2)})
    sets = [["chunker"], ["retriever"], ["reranker"], ["retriever", "reranker"], []]
    got = rows.groupingSets([[F.col(c) for c in own] for own in sets], "chunker", "retriever", "reranker")
    return got.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "rr", "ndcg", "hit")])


def list_index(s, d):
    rows = read(s, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    return ann.build(rows), rows.where(F.col("unit_id") % 20 == 0).withColumnRenamed("unit_id", "query_id")


def ivf_topk(s, d):
    """Approximate neighbours: as many lists probed as the index was measured to need."""
    index, asked = list_index(s, d)
    return settled(ann.search(index, asked, 10, ann.calibrate(index, 10)).withColumnsRenamed({"query_id": "q_id", "unit_id": "vec_id"}), "near", index.rows)


def ivf_all_lists(s, d):
    """With all lists probed the search is exact: every row is in the index, once."""
    index, asked = list_index(s, d)
    return settled(ann.search(index, asked, 10, len(index.means)).withColumnsRenamed({"query_id": "q_id", "unit_id": "vec_id"}), "near", index.rows)


def ivf_recall(s, d):
    """How much of the exact lists of :func:`vector_topk` the approximate search finds."""
    back = {"q_id": "query_id", "vec_id": "unit_id"}
    return ann.recall(ivf_topk(s, d).withColumnsRenamed(back), cat.vector_topk(s, d).withColumnsRenamed(back))


def ingested(s, d) -> Collection:
    """Documents ingested in three batches: a third of them with their text cut off, then all, then the first batch once more, which is done already."""
    made = Collection(s, scratch(s, "collection"))
    docs = read(s, d, "documents").select("doc_id", "text")
    first = docs.where(F.col("doc_id") % 3 == 0).withColumn("text", F.substring("text", 1, 1000))
    for n, rows in enumerate((first, docs)):
        made.ingest(rows, n)
    made.ingest(first, 0)
    return made


def ingested_bm25(s, d):
    return ingested(s, d).bm25(questions(s, d), K).withColumnsRenamed({"query_id": "item_id", "unit_id": "chunk_id"})


def ingested_terms(s, d):
    """How many chunks have each term, from the counters that ingest keeps."""
    made = ingested(s, d)
    made.compact()
    return made.ledger.read("counters").select("term", "df")


def cache_probe_bucketed(s, d):
    """Hits of documents' texts in a bucketed cache of the labelled ones."""
    docs = read(s, d, "documents")
    cached = docs.join(read(s, d, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = KeyedCache(s)
    cache.put_many(retrieval.vectors_of(cached.select(tx.cache_key("hash-64", F.col("text")).alias("key"), "text"), "key"), 1)
    out = staged(corpus.cache_stats(cache.probe(docs.select(tx.cache_key("hash-64", F.col("text")).alias("key")))), "stats")
    cache.drop()
    return out


def stream_latest_samples(s, d):
    """The newest 1,000 samples of each type and their mean, from a stream with state over the table's rows, dealt by hash to four
    batches in no order of time; the last figures of each type."""
    at, events = scratch(s, "latest"), read(s, d, "events")
    for n in range(4):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == n).write.mode("append").parquet(f"{at}/in")
    files = s.read.parquet(f"{at}/in").inputFiles()
    events = stateful.with_state(s).readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, len(files) // 4)).parquet(f"{at}/in")
    rows = stateful.newest(events, "event_type", "ts", "event_id", "value")
    write = lambda part, n: part.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/rows/part={n}")
    rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    last = s.read.parquet(f"{at}/rows").groupBy("key").agg(F.max_by(F.struct("n", "mean"), "batch").alias("r"))
    return last.select(F.col("key").alias("event_type"), "r.n", F.round("r.mean", 6).alias("mean"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_resolution, answer_or_refuse, prompt_rows, score_distribution, value_distribution, threshold_overlap, verdict_write_back, rebuilt_summary, ordered_dedup, index_dump,
        cache_newest, leaderboard, json_repair, rolling_latency, sweep_slices, ivf_topk, ivf_all_lists, ivf_recall, ingested_bm25, ingested_terms, cache_probe_bucketed, stream_latest_samples,
    )
}
QUERIES |= {"sweep_summary": sweep(("fixed", "recursive", "semantic")), "sweep_fixed_summary": sweep(("fixed",))}

# SQL ------------------------------------------------------------------------------------------------

_FLAT = r"'[\s\p{Z}]+'"
_STRIP = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
_COUNT = r"'[\p{L}\p{N}\p{M}_]+'"


def _cells(table: str, unit: str, text: str, name: str) -> str:
    words = cat._WORDS.format(c=text)
    return f"""{name}_c AS (SELECT id, bucket, count(*)::DOUBLE AS c FROM (SELECT id, (('0x' || substr(md5(word), 31, 2))::INT % 64)::BIGINT AS bucket
  FROM (SELECT {unit} AS id, unnest({words}) AS word FROM {table})) GROUP BY ALL),
{name} AS (SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS weight FROM {name}_c)"""


def _hybrid(k: int) -> str:
    return f"""hybrid{k} AS (SELECT * FROM (SELECT item_id, unit_id, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, unit_id) AS rank FROM (SELECT item_id, unit_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS fused
  FROM (SELECT item_id, unit_id, rank AS r FROM vector WHERE rank <= {3 * k} UNION ALL SELECT item_id, unit_id, rank FROM bm25 WHERE rank <= {3 * k}) GROUP BY item_id, unit_id)) WHERE rank <= {k})"""


def _lists(k: int) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS retriever, item_id, unit_id, rank FROM {r if r != 'hybrid' else f'hybrid{k}'} WHERE rank <= {k}" for r in RETRIEVERS)


_SLUGS = ", ".join(f"'fixed__{r}__{x}'" for r in RETRIEVERS for x in ("norerank", "lexical"))
_SWEEP = f"""{cat._CHUNKS}, {cat._SPANS}, {cat._bm25("ided", "chunk_id", "content", 3 * FETCH)},
{_cells("ided", "chunk_id", "content", "cells_d")}, {_cells("benchmark", "item_id", "text", "cells_q")},
near AS (SELECT q.id AS item_id, d.id AS unit_id, round(sum(q.weight * d.weight), 6) AS sim FROM cells_q q JOIN cells_d d USING (bucket) GROUP BY ALL),
cand AS (SELECT item_id, unit_id, coalesce(sim, 0) AS sim FROM (SELECT q.id AS item_id, d.id AS unit_id FROM (SELECT DISTINCT id FROM cells_q) q, (SELECT DISTINCT id FROM cells_d) d) LEFT JOIN near USING (item_id, unit_id)),
vector AS (SELECT * FROM (SELECT item_id, unit_id, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, unit_id) AS rank FROM cand) WHERE rank <= {3 * FETCH}),
{_hybrid(K)}, {_hybrid(FETCH)}, slim AS ({_lists(K)}), wide AS ({_lists(FETCH)}),
qt AS (SELECT item_id, list_distinct({cat._terms("text")}) AS qt FROM benchmark), ut AS (SELECT chunk_id AS unit_id, list_distinct({cat._terms("content")}) AS ut FROM ided),
again AS (SELECT retriever, item_id, unit_id, row_number() OVER (PARTITION BY retriever, item_id ORDER BY round(coalesce(len(list_intersect(qt, ut)) / nullif(len(qt), 0)::DOUBLE, 0), 6) DESC, rank) AS rank
  FROM wide JOIN qt USING (item_id) JOIN ut USING (unit_id)),
ranked AS (SELECT 'fixed__' || retriever || '__norerank' AS slug, item_id, unit_id, rank FROM slim UNION ALL SELECT 'fixed__' || retriever || '__lexical', item_id, unit_id, rank FROM again WHERE rank <= {K}),
marks AS (SELECT DISTINCT item_id, chunk_id AS unit_id FROM spans s JOIN ided c ON s.doc_id = c.doc_id AND s.char_start < c.char_end AND s.char_end > c.char_start),
rel AS (SELECT item_id, count(*) AS rel FROM marks GROUP BY ALL),
got AS (SELECT slug, item_id, count(*) FILTER (rank <= {K}) AS hits, 1.0::DOUBLE / min(rank) AS rr, sum(1.0 / log2(rank + 1.0)) FILTER (rank <= {K}) AS dcg FROM ranked JOIN marks USING (item_id, unit_id) GROUP BY ALL),
per AS (SELECT slug, item_id, {cat._METRIC_COLUMNS} FROM (SELECT item_id, unnest([{_SLUGS}]) AS slug FROM benchmark) LEFT JOIN rel USING (item_id) LEFT JOIN got USING (slug, item_id))"""
_SCORED = f"{cat._vector(1)}, {cat._SPANS}, b AS (SELECT item_id, sim AS best, item_id IN (SELECT item_id FROM spans) AS in_scope FROM vector)"


def _distribution(table: str, by: str, value: str) -> str:
    at = lambda i, name: f"max(CASE WHEN i = {i} THEN {value} END) AS {name}"
    return f"""SELECT {by}, max(n) AS n, min({value}) AS low, {at("greatest(0, n // 10 - 1)", "p10")}, {at("n // 2", "middle")}, {at("least(n - 1, 9 * n // 10)", "p90")}, max({value}) AS high
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {table} WHERE {value} IS NOT NULL) GROUP BY {by}"""


_EVALUATIONS = f"""{cat._SAID},
ev AS (SELECT a.conv_id, a.turn, sha1(concat_ws('|', coalesce(q.text, ''), coalesce(a.text, ''))) AS key, n.text IS NOT NULL AS measured,
    CASE WHEN cs >= 0.75 THEN 'correct' WHEN cs >= 0.35 THEN 'partially-correct' ELSE 'incorrect' END AS c, CASE WHEN fs >= 0.75 THEN 'faithful' WHEN fs >= 0.35 THEN 'partially-faithful' ELSE 'unfaithful' END AS f,
    len(regexp_extract_all(coalesce(q.text, ''), {_COUNT}))::BIGINT AS prompt, len(regexp_extract_all(coalesce(a.text, ''), {_COUNT}))::BIGINT AS completion
  FROM conversations a JOIN scores s ON s.conv_id = a.conv_id AND s.turn = a.turn
  LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND q.role = 'user' LEFT JOIN conversations n ON n.conv_id = a.conv_id AND n.turn - 1 = a.turn AND n.role = 'user' WHERE a.role = 'assistant'),
kept AS (SELECT key, c, f FROM ev WHERE measured QUALIFY row_number() OVER (PARTITION BY key ORDER BY conv_id, turn) = 1),
back AS (SELECT conv_id, turn, ev.measured OR kept.key IS NOT NULL AS measured, CASE WHEN ev.measured THEN ev.c ELSE kept.c END AS correctness, CASE WHEN ev.measured THEN ev.f ELSE kept.f END AS faithfulness,
    CASE WHEN ev.measured OR kept.key IS NOT NULL THEN '' ELSE 'judge error: nothing follows' END AS explanation, prompt, completion FROM ev LEFT JOIN kept USING (key)),
points AS (SELECT *, CASE correctness WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partially-correct' THEN 0.5 ELSE 0 END AS cp, CASE faithfulness WHEN 'faithful' THEN 1.0::DOUBLE WHEN 'partially-faithful' THEN 0.5 ELSE 0 END AS fp FROM back)"""

ORACLES = {
    "sweep_fixed_summary": f"WITH {_SWEEP} SELECT slug, count(*) AS questions, {', '.join(f'round(coalesce(avg({c}), 0), 6) AS {c}_mean' for c in ('precision', 'recall', 'rr', 'ndcg', 'hit'))}, coalesce(quantile_disc(rr, 0.95), 0) AS rr_p95 FROM per GROUP BY slug",
    "evidence_resolution": f"""WITH {cat._SPANS}, h AS (SELECT item_id, min(doc_id) AS doc_id FROM spans GROUP BY 1),
p AS (SELECT item_id, 0::BIGINT AS part, regexp_replace(substr(text, 1, 40), {_STRIP}, '', 'g') AS snippet FROM benchmark UNION ALL SELECT item_id, CASE WHEN regexp_matches(substr(text, 1, 40), '[^\\s\\p{{Z}}]') THEN 1 ELSE 0 END, regexp_replace(substr(text, 41), {_STRIP}, '', 'g') FROM benchmark)
SELECT item_id, doc_id, part, CASE WHEN strpos(d.text, snippet) > 0 THEN strpos(d.text, snippet) - 1 END::BIGINT AS char_start,
  CASE WHEN strpos(d.text, snippet) > 0 THEN strpos(d.text, snippet) - 1 + length(regexp_replace(snippet, {_FLAT}, ' ', 'g')) END::BIGINT AS char_end, CASE WHEN d.doc_id IS NULL THEN 'no document' WHEN strpos(d.text, snippet) = 0 THEN 'not found' END AS problem
FROM p LEFT JOIN h USING (item_id) LEFT JOIN documents d USING (doc_id) WHERE snippet <> ''""",
    "answer_or_refuse": f"""WITH {cat._GATED}, n AS (SELECT item_id, count(*) AS n FROM gated WHERE keep GROUP BY 1), top AS (SELECT item_id, unit_id FROM gated WHERE keep QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) = 1)
SELECT item_id, coalesce(n, 0) AS n_passages, n IS NULL AS refused, CASE WHEN n IS NULL THEN '{answering.REFUSAL}' ELSE substr(regexp_replace(split_part(' (source: ' || unit_id || ')' || chr(10) || coalesce(d.text, ''), chr(10) || chr(10), 1), {_STRIP}, '', 'g'), 1, 500) END AS answer
FROM benchmark LEFT JOIN n USING (item_id) LEFT JOIN top USING (item_id) LEFT JOIN documents d ON d.doc_id = unit_id""",
    "prompt_rows": f"""WITH {cat._bm25("documents", "doc_id", "coalesce(text, '')", 1)}
SELECT item_id, (CASE WHEN unit_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_passages, sha256('{answering.SYSTEM}' || chr(10) || 'Context passages:' || chr(10) || chr(10) || CASE WHEN unit_id IS NULL THEN '{answering.NOTHING}' ELSE '[1] (source: ' || unit_id || ')' || chr(10) || coalesce(d.text, '') END || chr(10) || chr(10) || 'Question: ' || coalesce(b.text, '')) AS prompt_sha256
FROM benchmark b LEFT JOIN bm25 USING (item_id) LEFT JOIN documents d ON d.doc_id = unit_id""",
    "score_distribution": f"WITH {_SCORED} {_distribution('b', 'in_scope', 'best')}",
    "value_distribution": _distribution("events", "event_type", "value"),
    "threshold_overlap": f"WITH {_SCORED} SELECT item_id, best FROM b WHERE NOT in_scope AND best >= (SELECT min(best) FROM b WHERE in_scope)",
    "verdict_write_back": f"WITH {_EVALUATIONS} SELECT conv_id, turn, measured, correctness, faithfulness, explanation FROM back",
    "rebuilt_summary": f"""WITH {_EVALUATIONS} SELECT turn, count(*) AS total, count(*) FILTER (measured) AS judged, round(count(*) FILTER (measured) / count(*)::DOUBLE, 6) AS judge_coverage, round(avg(cp) FILTER (measured), 6) AS correctness, round(avg(fp) FILTER (measured), 6) AS faithfulness,
  round(avg(cp) FILTER (measured) - avg(fp) FILTER (measured), 6) AS gap, count(*) FILTER (measured AND correctness = 'correct') AS correct_count, count(*) FILTER (measured AND faithfulness = 'faithful') AS faithful_count,
  round(avg(prompt), 6) AS prompt_tokens_mean, round(avg(completion), 6) AS completion_tokens_mean, quantile_disc(completion::DOUBLE, 0.95) AS completion_tokens_p95 FROM points GROUP BY turn""",
    "ordered_dedup": "SELECT sha256('text' || chr(0) || text) AS key, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "index_dump": f"WITH {cat._CHUNKS} SELECT doc_id, count(*) AS chunks, sum(char_end - char_start)::BIGINT AS chars FROM ided GROUP BY doc_id",
    "cache_newest": "SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 2048",
    "leaderboard": f"WITH c AS ({cat.ORACLES['judge_coverage']}) SELECT row_number() OVER (ORDER BY quality_avg DESC NULLS LAST, source NULLS FIRST) AS place, source, CASE WHEN quality_avg IS NULL THEN '--' ELSE printf('%.3f', round(quality_avg, 3)) END AS cell FROM c",
    "json_repair": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "rolling_latency": "SELECT event_id, round(sum(value::DECIMAL(18, 4)) OVER w::DOUBLE / count(value) OVER w, 6) AS mean_last_1000 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)",
    "sweep_slices": f"""WITH {_SWEEP}, p AS (SELECT *, split_part(slug, '__', 1) AS chunker, split_part(slug, '__', 2) AS retriever, split_part(slug, '__', 3) AS reranker FROM per)
SELECT chunker, retriever, reranker, grouping(chunker, retriever, reranker)::BIGINT AS level, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('precision', 'recall', 'rr', 'ndcg', 'hit'))}
FROM p GROUP BY GROUPING SETS ((chunker), (retriever), (reranker), (retriever, reranker), ())""",
    "ivf_all_lists": cat.ORACLES["vector_topk"],
    "ingested_bm25": cat.ORACLES["bm25_chunk_topk"],
    "ingested_terms": f"WITH {cat._CHUNKS} SELECT term, count(*) AS df FROM (SELECT chunk_id, unnest(list_distinct({cat._terms('content')})) AS term FROM ided) GROUP BY term",
    "cache_probe_bucketed": cat.ORACLES["cache_probe"],
    "stream_latest_samples": cat.ORACLES["latest_samples"],
}
