"""Labels, ranking metrics, judging and summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice, pairwise
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.selection import nearest, order_statistics

#: Anchors that a scan of documents carries, and short items that one looks for.
ANCHORS, SHORT = 20_000, 256


def _anchor(text: Column) -> Column:
    """What stands as whole words in every text that holds ``text``: of its inner words (those with white space on both sides) the
    longest two that follow each other, or the only one; null without any. White space is that of regular expressions."""
    inner = F.filter(F.slice(F.split(text, r"\s+"), 2, F.greatest(F.size(F.split(text, r"\s+")) - 2, F.lit(0))), lambda w: w != "")
    pairs = F.zip_with(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))), F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    longest = F.array_max(F.transform(pairs, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    return F.when(F.size(inner) >= 2, longest).when(F.size(inner) == 1, inner[0])


def _met(anchors: list[str]):
    """(doc_id, text, anchor): each of ``anchors``, words or two that follow each other, that a text has. White space is that of Java's expressions."""
    known, cut = frozenset(anchors), re.compile(r"[^ \t\n\x0b\f\r]+").findall
    firsts = frozenset(a.split(" ")[0] for a in anchors if " " in a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, row, found = batch.slice(at, 256), [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = cut(text)
                    met = known.intersection(words)
                    if firsts.intersection(words):
                        met |= known.intersection(f"{a} {b}" for a, b in pairwise(words) if a in firsts)
                    row += [i] * len(met)
                    found += met
                if row:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("text").take(pa.array(row)), pa.array(found, pa.string())], ["doc_id", "text", "anchor"])

    return run


def evidence_spans(examples: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, char_start, char_end): first place of each item's text in each document that holds it.

    A document is asked only for items one of whose pairs of words it has: the anchors of all items are looked up among its words, and
    what is met is joined with its items and located. Items are a stated set: their anchors go with the scan up to ANCHORS, beyond that
    they are joined. Items too short for an anchor are looked for in every document, ``SHORT`` at a time in one pass."""
    items = examples.where("text <> ''").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("needle"), _anchor(F.col("text")).alias("anchor"))
    pages = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = [r["anchor"] for r in items.select("anchor").where("anchor IS NOT NULL").distinct().limit(ANCHORS + 1).collect()]
    if len(keys) <= ANCHORS:
        asked = pages.mapInArrow(_met(keys), "doc_id long, text string, anchor string")
    else:
        words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        met = F.concat("words", F.filter(pairs, lambda w: w.isNotNull()))
        asked = pages.withColumn("words", words).select("doc_id", "text", F.explode(F.array_distinct(met)).alias("anchor"))
    found = asked.join(items, "anchor").select("item_id", "doc_id", F.expr("locate(needle, text)").alias("at"), F.char_length("needle").alias("n"))
    short = items.where("anchor IS NULL").select("item_id", "needle").toLocalIterator()
    while block := list(islice(short, SHORT)):
        each = F.explode(F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["needle"]).alias("needle")) for r in block])).alias("item")
        some = pages.where(reduce(or_, [F.contains("text", F.lit(r["needle"])) for r in block])).select("doc_id", "text", each)
        found = found.unionByName(some.select("item.item_id", "doc_id", F.expr("locate(item.needle, text)").alias("at"), F.char_length("item.needle").alias("n")))
    return found.where("at > 0").select("item_id", "doc_id", (F.col("at") - 1).cast("long").alias("char_start"), (F.col("at") - 1 + F.col("n")).cast("long").alias("char_end"))


def resolve_evidence(examples: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, part, char_start, char_end, problem): each snippet's first place in its labelled document.

    examples: (item_id, doc_id, evidence), snippets parted by a double bar. A snippet that isn't there word for word is
    looked for with any white space between its words; its end then counts one blank between words. ``problem`` says
    what is wrong, null for resolved snippets; :func:`require_resolved` refuses rows that have one. Examples without a
    snippet give no row. A document id that occurs twice gives rows for both."""
    parts = examples.select("item_id", "doc_id", F.posexplode(tx.evidence_parts(F.col("evidence"))).alias("part", "needle"))
    pages = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text_"), F.lit(True).alias("there_"))
    rows = parts.join(pages, "doc_id", "left")
    terms = F.filter(F.split("needle", r"(?U)\s+"), lambda t: t != "")
    quoted = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    loose = F.array_join(quoted, r"\s+")
    # the text before the match, in code points
    front = F.call_function("regexp_extract", F.col("text_"), F.concat(F.lit("(?Us)^(.*?)"), loose), F.lit(1))
    exact = F.expr("locate(needle, text_)")
    start = F.when(exact > 0, exact - 1).when(F.regexp("text_", F.concat(F.lit("(?U)"), loose)), F.char_length(front))
    length = F.when(exact > 0, F.char_length("needle")).otherwise(F.char_length(F.array_join(terms, " ")))
    problem = F.when(F.col("there_").isNull(), "no document").when(F.col("char_start").isNull(), "not found")
    rows = rows.withColumn("char_start", start.cast("long")).withColumn("char_end", F.col("char_start") + length)
    return rows.select("item_id", "doc_id", F.col("part").cast("long").alias("part"), "char_start", "char_end", problem.alias("problem"))


def require_resolved(spans: DataFrame, shown: int = 20) -> DataFrame:
    """``spans`` unless one has a problem: a label that no longer fits its document must not go unnoticed."""
    if bad := spans.where("problem IS NOT NULL").limit(shown).collect():
        raise ValueError("labels could not be resolved: " + "; ".join(f"{r.item_id} in {r.doc_id}: {r.problem}" for r in bad))
    return spans


def overlap_labels(spans: DataFrame, chunks: DataFrame, width: int = 4096) -> DataFrame:
    """(item_id, chunk_id): chunks of the span's document whose half-open range meets it.

    Ranges are joined by document and stretch of ``width`` characters, so a document with very many chunks is many tasks' work; a pair is
    taken in the stretch where the later of its two ranges begins, once."""
    stretches = lambda a, b: F.sequence(F.expr(f"{a} div {width}"), F.expr(f"greatest({a}, {b} - 1) div {width}"))
    s = spans.select("item_id", "doc_id", F.col("char_start").cast("long").alias("a"), F.col("char_end").cast("long").alias("b")).withColumn("at", F.explode(stretches("a", "b")))
    c = chunks.select("chunk_id", "doc_id", F.col("char_start").cast("long").alias("c"), F.col("char_end").cast("long").alias("d")).withColumn("at", F.explode(stretches("c", "d")))
    both = s.join(c, ["doc_id", "at"]).where(F.expr(f"a < d AND b > c AND at = greatest(a, c) div {width}"))
    return both.select("item_id", "chunk_id").distinct()


def ranking_metrics(ranked: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 5, extra: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, precision, recall, rr, ndcg, hit) of each query, 0 where nothing was found or is relevant.

    ranked: (query_id, unit_id, rank); labels: (query_id, unit_id). Precision is over k, however few came
    back; the reciprocal rank is not cut at k."""
    keys = [*extra, "query_id"]
    marked = labels.select(*keys, "unit_id").distinct().withColumn("hit", F.lit(1))
    rel = marked.groupBy(*keys).agg(F.count("*").alias("rel"))
    rows = ranked.join(marked, [*keys, "unit_id"])
    got = rows.groupBy(*keys).agg(
        F.count_if(F.col("rank") <= k).alias("hits"),
        (1.0 / F.min("rank")).alias("rr"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.when(F.col("rel") > 0, F.sequence(F.lit(1), F.least(F.col("rel"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    all_ = queries.select(*keys).distinct().join(rel, keys, "left").join(got, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits = F.coalesce("hits", F.lit(0))
    return all_.select(
        *keys,
        F.round(hits / F.lit(float(k)), 6).alias("precision"),
        F.round(zero(F.try_divide(hits.cast("double"), F.col("rel"))), 6).alias("recall"),
        F.round(zero(F.col("rr")), 6).alias("rr"),
        F.round(zero(F.try_divide(F.col("dcg"), ideal)), 6).alias("ndcg"),
        F.when(hits > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def nearest_rank(p: float, column: str) -> Column:
    """Nearest-rank percentile of a column; 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{column}`)"), F.lit(0.0))


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def stub_verdicts(rows: DataFrame) -> DataFrame:
    """``rows`` (expected, generated, context) with correctness and faithfulness scores and labels by word overlap."""
    e, g, c = (F.array_distinct(tx.words(F.coalesce(x, F.lit("")))) for x in ("expected", "generated", "context"))
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), F.lit(0.0))
    rows = rows.withColumn("c_score", share(e, g)).withColumn("f_score", share(g, c))
    rows = rows.withColumn("correctness", tx.bucket(F.col("c_score"), "incorrect", "partially-correct", "correct"))
    return rows.withColumn("faithfulness", tx.bucket(F.col("f_score"), "unfaithful", "partially-faithful", "faithful"))


def ordinal(label: Column) -> Column:
    """Score of a verdict; null stays null: not measured is not zero."""
    return F.when(label.isin("correct", "faithful"), 1.0).when(label.isin("partially-correct", "partially-faithful"), 0.5).when(label.isin("incorrect", "unfaithful"), 0.0)


def needs_judging(measured: Column, correctness: Column, explanation: Column) -> Column:
    """No verdict yet, or one that only records that the judge failed."""
    told = F.lower(explanation)
    failed = F.coalesce(told.contains("judge error") | told.contains("judge unavailable"), F.lit(False))
    return ~F.coalesce(measured, F.lit(False)) & (correctness.isNull() | failed)


def coverage(rows: DataFrame, by: str, measured: Column, score: Column, least: float = 0.9) -> DataFrame:
    """(by, total, measured, coverage, score): the mean score, null while too few rows are measured."""
    got = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(measured).alias("measured"), F.avg(F.when(measured, score)).alias("mean"))
    share = F.coalesce(F.try_divide(F.col("measured").cast("double"), F.col("total")), F.lit(0.0))
    return got.select(by, "total", "measured", F.round(share, 6).alias("coverage"), F.round(F.when(share >= least, F.col("mean")), 6).alias("score"))


def leaderboard(summary: DataFrame, by: str) -> DataFrame:
    """Best first by any column, rows without a value last."""
    return summary.orderBy(F.desc_nulls_last(by), "slug")


def context(ranked: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, context, n_passages): numbered passages with their source (the unit's id where ``units`` has no column of that
    name), blank lines between. A query has at most k passages."""
    source = F.col("source" if "source" in units.columns else "unit_id")
    rows = ranked.join(units.select("unit_id", source.cast("string").alias("source"), "text"), "unit_id")
    block = F.array_sort(F.collect_list(F.struct("rank", "source", "text")))
    shown = F.transform(block, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] (source: "), x["source"], F.lit(")\n"), x["text"]))
    return rows.groupBy("query_id").agg(F.array_join(shown, "\n\n").alias("context"), F.count("*").alias("n_passages"))


def echo(context: Column) -> Column:
    """Offline answer: what follows the first passage mark up to a blank line, at most 500 characters."""
    at = F.locate("[1]", context)
    rest = F.substring(context, at + F.lit(3), F.lit(2**31 - 1))
    return F.when(at > 0, F.substring(tx.strip(F.substring_index(rest, "\n\n", 1)), 1, 500)).otherwise("no context")


def threshold(scores: DataFrame) -> DataFrame:
    """One row from (query_id, best, in_scope): worst in, best out, whether they separate, and thresholds between."""
    got = scores.agg(F.min(F.when(F.col("in_scope"), F.col("best"))).alias("worst_in"), F.max(F.when(~F.col("in_scope"), F.col("best"))).alias("best_out"))
    apart = F.coalesce(F.col("worst_in") > F.col("best_out"), F.lit(False))
    point = F.col("best_out") + 0.35 * (F.col("worst_in") - F.col("best_out"))
    return got.select(F.round("worst_in", 6).alias("worst_in"), F.round("best_out", 6).alias("best_out"), apart.alias("separable"), F.round(F.when(apart, point), 4).alias("min_top_score"), F.round(F.when(apart, point - 0.05), 4).alias("min_score"))


def distribution(scores: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, low, p10, middle, p90, high) by places in the sorted list: n // 10 - 1 (at least 0), n // 2 and
    9 n // 10 (at most n - 1), counted from 0. Rows without a value are left out. No group is brought into one task."""
    n = lambda form: lambda c: F.expr(form)
    places = {"p10": n("greatest(0, n div 10 - 1)"), "middle": n("n div 2"), "p90": n("least(n - 1, 9 * n div 10)")}
    return order_statistics(scores, [by], value, places).select(by, "n", "low", "p10", "middle", "p90", "high")


def latency_stats(samples: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, p50, p95, p99, low, high): nearest-rank percentiles of each group, by :func:`order_statistics`."""
    got = order_statistics(samples, [by], value, {f"p{p}": nearest(p) for p in (50, 95, 99)}, mean=F.round(F.avg(value), 6))
    return got.select(by, "n", "mean", "p50", "p95", "p99", "low", "high")


def overlapping(scores: DataFrame) -> DataFrame:
    """(query_id, best): queries out of scope that score no less than the worst in scope; none if there is none in scope."""
    worst = scores.where("in_scope").agg(F.min("best").alias("worst_in"))  # one row
    return scores.where("NOT in_scope").crossJoin(F.broadcast(worst)).where("best >= worst_in").select("query_id", "best")


def rolling_mean(samples: DataFrame, by: str, at: str, tie: str, value: str, n: int = 1000, block: int = 50_000) -> DataFrame:
    """``samples`` with ``mean``, that of the newest n samples of their group up to each, in order of ``at`` and ``tie``.

    A group may hold a third of all rows, so it is not sorted in one task: hours are counted and numbered first, which
    gives each row its place, and blocks of places get the n - 1 rows before them as well. Means come from running
    sums in a block, so the work doesn't grow with n; values are taken at ten decimals, so that sums are exact."""
    if not 1 <= n <= block:
        raise ValueError("n must be in [1, block]")
    rows = samples.withColumn("hour_", F.date_trunc("hour", at))
    hours = rows.groupBy(F.col(by).alias("by_"), F.col("hour_").alias("of_")).agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(Window.partitionBy("by_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("by_", "of_", before.alias("before_"))
    nth = F.row_number().over(Window.partitionBy(by, "hour_").orderBy(at, tie)) - 1
    rows = rows.withColumn("nth_", nth).join(hours, F.col(by).eqNullSafe(F.col("by_")) & F.col("hour_").eqNullSafe(F.col("of_")))
    rows = rows.withColumn("place_", F.col("before_") + F.col("nth_")).withColumn("own_", F.expr(f"place_ div {block}"))
    also = F.when(F.col("place_") % block > block - n, F.array(F.col("own_"), F.col("own_") + 1)).otherwise(F.array("own_"))
    rows = rows.withColumn("part_", F.explode(also))
    w = Window.partitionBy(by, "part_").orderBy("place_")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_", F.coalesce(F.sum(F.col(value).cast("decimal(28,10)")).over(run), F.lit(0).cast("decimal(38,10)"))).withColumn("n_", F.count(value).over(run))
    last = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0))
    rows = rows.withColumn("mean", F.try_divide(last("sum_").cast("double"), last("n_")))
    return rows.where("part_ = own_").select(*samples.columns, "mean")


def rolling_latest(samples: DataFrame, by: str, order: list[str], n: int = 1000) -> DataFrame:
    """The newest n samples of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")
