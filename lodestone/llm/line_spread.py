"""Line dedup by distinct-site spread, in DataFrame functions alone.

Each line's key (64-bit hash and length) gathers a HyperLogLog sketch of the sites it stands on;
partial sketches merge as the aggregation does, so a line on every page moves one small sketch for
each task. Lines whose estimate lies well above ``min_sites`` are boilerplate, those well below are
not, and those near it get an exact distinct count. Boilerplate lines leave every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, row_key, table

MIN_SITES, LG_K, NEAR = 10, 12, 0.1
BLANKS = " \t\r\x0b\x0c"


def pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(bare(line)).alias("h"), F.char_length(bare(line)).alias("n"))


def site_lines(docs: DataFrame, site: str) -> DataFrame:
    """(site, h, n) of each line with anything but white space."""
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(F.transform(pieces(docs["text"]), line_key)).alias("k"))
    return lines.where("k.n > 0").select("site", "k.h", "k.n")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, n) of lines that stand on ``min_sites`` sites or more; a null site counts for none."""
    lines = site_lines(docs, site).where("site IS NOT NULL")
    spread = lines.groupBy("h", "n").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    spread = materialise(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    far, near = (spread.where(c).select("h", "n") for c in (F.col("sites") > min_sites * (1 + NEAR), F.col("sites") <= min_sites * (1 + NEAR)))
    exact = lines.join(near, ["h", "n"], "left_semi").distinct().groupBy("h", "n").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return materialise(far.union(exact.select("h", "n")), "boilerplate")


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (r, n_lines, n_removed, text): r holds the columns of ``docs``, text what is left.

    Lines are compared without the blanks around them; blank lines stay. A null text counts as
    empty, one blank line. Repeated rows each lose the same lines. An empty table gives no rows."""
    bad = boilerplate(docs, site, min_sites)
    keyed = docs.select(*row_key(docs["doc_id"], docs["text"]), F.struct(*docs.columns).alias("r"))
    per = docs.select(*row_key(docs["doc_id"], docs["text"]), F.explode(F.array_distinct(F.transform(pieces(docs["text"]), line_key))).alias("k"))
    hit = per.select("k1", "k2", "k.h", "k.n").join(bad, ["h", "n"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "n")).alias("bad"))
    lines = pieces(F.col("r.text"))
    left = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), line_key(x))))
    rows = keyed.join(hit, ["k1", "k2"], "left").select("r", F.size(lines).cast("long").alias("n_lines"), left.alias("left"))
    return rows.select("r", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_removed"), F.array_join("left", "\n").alias("text"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return left.select(F.col("r.doc_id").alias("doc_id"), "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


_BARE = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
bad AS (SELECT {_BARE} AS b FROM lines WHERE {_BARE} <> '' GROUP BY b HAVING count(DISTINCT source) >= {MIN_SITES}),
flagged AS (SELECT lines.*, bad.b IS NOT NULL AS gone FROM lines LEFT JOIN bad ON {_BARE} = bad.b)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), ''))::BIGINT AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY r, doc_id
"""
