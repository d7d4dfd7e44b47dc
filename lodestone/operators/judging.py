"""Verdicts brought back to evaluations, and the summaries made from them anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluation as ev
from lodestone.operators.selection import nearest, order_statistics

VERDICT = ("correctness", "faithfulness", "explanation")


def judge(rows: DataFrame, model: Callable[[Column], Column], ask: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """``rows`` (expected, generated, context, others) with key, measured, correctness, faithfulness and explanation.

    Triples that are the same are judged once, whatever the rows that hold them. ``ask`` makes the message of a triple's columns, and
    ``model`` answers it (:func:`lodestone.functions.models.answers`); its JSON is read by :func:`lodestone.functions.text.json_verdict`. A null
    answer, or one without a verdict, leaves the row pending, with the reason in its explanation."""
    parts = ("expected", "generated", "context")
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in parts}
    keyed = rows.withColumn("key", tx.triple_key(*text.values()))
    asked = ask or (lambda e, g, c: F.concat(F.lit("Expected answer:\n"), e, F.lit("\n\nGiven answer:\n"), g, F.lit("\n\nPassages:\n"), c))
    one = keyed.groupBy("key").agg(*[F.min(text[c]).alias(c) for c in parts])
    said = one.select("key", model(asked(*[F.col(c) for c in parts])).alias("said"))
    told = said.select("key", tx.json_verdict(F.col("said")).alias("v"), F.col("said").isNull().alias("silent"))
    why = F.when(F.col("silent"), "judge error: no answer").when(F.col("v").isNull(), "judge error: no verdict").otherwise(F.col("v.explanation"))
    verdicts = told.select("key", F.col("v").isNotNull().alias("measured"), F.col("v.correctness").alias("correctness"), F.col("v.faithfulness").alias("faithfulness"), why.alias("explanation"))
    return keyed.join(verdicts, "key")


def write_back(evaluations: DataFrame, verdicts: DataFrame, key: str = "key") -> DataFrame:
    """``evaluations`` (key, measured, correctness, faithfulness, explanation, ...) with the verdicts that were pending.

    verdicts: (key, correctness, faithfulness, explanation), one for each key. A pending row without a verdict becomes
    unmeasured and keeps its explanation ("not judged" where it has none); a row already judged stays as it is, and
    where it doesn't say whether it was measured, having a correctness does."""
    new = verdicts.select(key, *[F.col(c).alias(f"{c}_") for c in VERDICT], F.lit(True).alias("there_"))
    ask = ev.needs_judging(F.col("measured"), F.col("correctness"), F.col("explanation"))
    rows = evaluations.join(new, key, "left").withColumn("ask_", ask).withColumn("there_", F.coalesce("there_", F.lit(False)))
    told = F.when(F.col("there_"), F.col("explanation_")).otherwise(F.coalesce("explanation", F.lit("not judged")))
    mended = {
        "measured": F.when(F.col("ask_"), F.col("there_")).otherwise(F.coalesce("measured", F.col("correctness").isNotNull())),
        "correctness": F.when(F.col("ask_"), F.col("correctness_")).otherwise(F.col("correctness")),
        "faithfulness": F.when(F.col("ask_"), F.col("faithfulness_")).otherwise(F.col("faithfulness")),
        "explanation": F.when(F.col("ask_"), told).otherwise(F.col("explanation")),
    }
    return rows.withColumns(mended).select(*evaluations.columns)


def rebuilt_summary(rows: DataFrame, by: str) -> DataFrame:
    """The generation half of a summary: coverage, means over measured rows alone (null without any), top labels,
    means of tokens over all rows, and how far correctness is from faithfulness."""
    measured = F.coalesce("measured", F.lit(False))
    score = lambda c: F.avg(F.when(measured, ev.ordinal(F.col(c))))
    got = rows.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(measured).alias("judged"),
        score("correctness").alias("c"),
        score("faithfulness").alias("f"),
        F.count_if(measured & (F.col("correctness") == "correct")).alias("correct_count"),
        F.count_if(measured & (F.col("faithfulness") == "faithful")).alias("faithful_count"),
        F.round(ev.mean(F.col("prompt_tokens")), 6).alias("prompt_tokens_mean"),
        F.round(ev.mean(F.col("completion_tokens")), 6).alias("completion_tokens_mean"),
    )
    # no group is brought into one task for its percentile
    high = order_statistics(rows, [by], "completion_tokens", {"high_": nearest(95)}).select(F.col(by).alias("by_"), "high_")
    got = got.join(high, F.col(by).eqNullSafe(F.col("by_")), "left").withColumn("completion_tokens_p95", F.coalesce(F.col("high_").cast("double"), F.lit(0.0)))
    coverage = F.round(F.col("judged") / F.col("total"), 6).alias("judge_coverage")
    return got.select(by, "total", "judged", coverage, F.round("c", 6).alias("correctness"), F.round("f", 6).alias("faithfulness"), F.round(F.col("c") - F.col("f"), 6).alias("gap"), "correct_count", "faithful_count", "prompt_tokens_mean", "completion_tokens_mean", "completion_tokens_p95")
