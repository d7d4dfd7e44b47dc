"""Prompts and answers: what was retrieved, shown to a generator, or a refusal where nothing was relevant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluation, retrieval

NOTHING = "(no passages retrieved)"
#: The refusal, and what a generator is told.
REFUSAL = "The provided documents do not cover this question. No sufficiently relevant passage was found."
SYSTEM = """You answer questions using only the numbered context passages provided.

Rules:
- Use only what the passages state. Do not add facts from your own knowledge.
- If the passages do not contain the answer, say exactly: "The provided context does not contain this information."
- Cite the passage numbers you used, like [2] or [1][3].
- Be concise. Two or three sentences unless the question needs more."""


def prompts(queries: DataFrame, ranked: DataFrame, units: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(query_id, n_passages, system, user): the messages of each query, also of those that found nothing."""
    shown = evaluation.context(ranked, units)
    rows = queries.join(shown, "query_id", "left")
    user = F.concat(F.lit("Context passages:\n\n"), F.coalesce("context", F.lit(NOTHING)), F.lit("\n\nQuestion: "), F.coalesce("text", F.lit("")))
    return rows.select("query_id", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.lit(system).alias("system"), user.alias("user"))


def answer(
    units: DataFrame, queries: DataFrame, retriever: str = "hybrid", k: int = 5, reranked: bool = False, gate: dict | None = None, generator: Callable[[Column], Column] = evaluation.echo,
    embedder: retrieval.Embedder = retrieval.vectors_of, scorer: retrieval.Scorer | None = None, refusal: str = REFUSAL,
) -> DataFrame:
    """(query_id, n_passages, refused, answer): retrieve, gate, and generate from the user message.

    ``gate`` holds the arguments of :func:`retrieval.gate`, None turns it off. With a gate, a query without passages
    is refused and the generator's answer isn't used; without one, the generator is told that nothing was found.
    ``generator`` maps a column of messages to one of answers, :func:`lodestone.functions.models.answers` for instance;
    ``embedder`` and ``scorer`` are those of :func:`retrieval.retrieve`."""
    found = retrieval.retrieve(units, queries, retriever, k, reranked, embedder, scorer)
    if gate is not None:
        found = retrieval.gate_passages(retrieval.gate(found, **gate))
    rows = prompts(queries, found, units)
    refused = F.lit(gate is not None) & (F.col("n_passages") == 0)
    return rows.select("query_id", "n_passages", refused.alias("refused"), F.when(refused, refusal).otherwise(generator(F.col("user"))).alias("answer"))
