"""Text functions as Spark columns. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of the index and of queries.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def tokens(text: Column) -> Column:
    """Index terms: lower-case runs of ASCII letters and digits, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def words(text: Column) -> Column:
    """Lower-case words between Unicode white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunk_id(doc: Column, start: Column, end: Column, strategy: str | Column) -> Column:
    """Sixteen hex digits that name a chunk by its document, offsets and strategy."""
    return F.substring(F.sha1(F.concat_ws("|", doc.cast("string"), start.cast("string"), end.cast("string"), F.lit(strategy))), 1, 16)


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def triple_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def model_tag(name: Column) -> Column:
    """Last path segment of a model name, dots as dashes."""
    return F.replace(F.element_at(F.split(name, "/"), -1), F.lit("."), F.lit("-"))


def evidence_parts(evidence: Column) -> Column:
    """Snippets of an evidence field: split at a double bar, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(evidence, r"\|\|"), strip), lambda x: x != "")


def bucket(score: Column, low: str, middle: str, high: str) -> Column:
    return F.when(score >= 0.75, high).when(score >= 0.35, middle).otherwise(low)


def json_object(raw: Column) -> Column:
    """Fields of the object in an answer, as strings: code fences at line ends off, the outer braces taken, trailing
    commas mended only where the object cannot be read as it is; null where none can be read."""
    body = F.nullif(F.regexp_extract(F.regexp_replace(strip(raw), "(?m)^```(json)?|```$", ""), r"(?s)\{.*\}", 0), F.lit(""))
    read = lambda text: F.from_json(text, "map<string,string>")
    return F.coalesce(read(body), read(F.regexp_replace(body, r",(\s*[}\]])", "$1")))


def json_verdict(raw: Column) -> Column:
    """Struct (correctness, faithfulness, explanation) of a judge's answer, from its :func:`json_object`. Labels are
    trimmed and lower-cased, a missing or unknown one becomes the worst; null where no object can be read."""
    fields = json_object(raw)
    got = {k: F.try_element_at(fields, F.lit(k)) for k in ("correctness", "faithfulness", "explanation")}
    known = lambda c, worst, *rest: F.when(F.lower(strip(c)).isin(*rest), F.lower(strip(c))).otherwise(worst)
    return F.when(
        fields.isNotNull(),
        F.struct(
            known(got["correctness"], "incorrect", "partially-correct", "correct").alias("correctness"),
            known(got["faithfulness"], "unfaithful", "partially-faithful", "faithful").alias("faithfulness"),
            F.substring(F.coalesce(got["explanation"], F.lit("")), 1, 500).alias("explanation"),
        ),
    )


def retry_after(message: Column) -> Column:
    """Seconds to wait, from "try again in 1m2.5s" or "try again in 3s" in a rate-limit message (half a second is
    added to the latter); null without one."""
    number = lambda pattern, i: F.regexp_extract(message, pattern, i).try_cast("double")
    both, alone = r"try again in ([0-9.]+)m([0-9.]+)s", r"try again in ([0-9.]+)s"
    return F.coalesce(number(both, 1) * 60 + number(both, 2), number(alone, 1) + 0.5)
