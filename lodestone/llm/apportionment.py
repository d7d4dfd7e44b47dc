"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

1. Each source's share of the mix is its target, in words; targets stop at ``cap`` times what the
   source holds, and the excess is reshared by weight.
2. Rows are dealt to shards of their source by a seeded hash and ordered in it by another; a
   shard's words in that order are cut into blocks of ``block_words``. Equal rows are counted first
   and dealt in parts of at most ``DOCS_PER_SHARD``, so that many copies fill many shards.
3. The highest quotients weight/(2k+1) give each source an integer number of blocks, and so each
   of its shards: quotas sum to the total at both levels.
4. A shard with n blocks and quota q takes every block q // n times, and the q % n of a seeded
   systematic draw once more. Sums over such a draw have a closed form, so the words taken of a
   row follow from its place alone: no block is made a row.

Only per-source and per-shard totals reach the driver; there are at most ``max_shards`` shards
besides one for each source. The window over a shard holds ids and counts.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

WEIGHTS, SHARE, CAP, BLOCK_WORDS, SEED = (3, 1, 2), 1.5, 2, 32, 17
DOCS_PER_SHARD, MAX_SHARDS = 128, 1 << 14


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null name for each source; null is one of them."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: dict[str, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str, float]:
    """Words aimed at for each source key: weights repeat over the keys by code point, null last."""
    names = [*sorted(k for k in sizes if k != "n"), *(k for k in sizes if k == "n")]
    by = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(by[k] for k in open_)
        full = [k for k in names if k in open_ and unit * by[k] > cap * sizes[k]]
        if not full:
            return out | {k: unit * by[k] for k in open_}
        for k in full:
            out[k] = float(cap * sizes[k])
            left -= out[k]
            open_.remove(k)
    return out


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients weight/(2k+1), none above its cap; ties go to the earlier entry."""
    seats, total = min(seats, sum(caps)), sum(weights)
    if not seats or not total:
        return [0] * len(weights)
    got = [min(c, int(w * seats / total + 0.5)) for w, c in zip(weights, caps, strict=True)]
    over = sum(got) - seats
    if over > 0:
        heap = [(weights[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g]
        heapq.heapify(heap)
        for _ in range(over):
            i = -heapq.heappop(heap)[1]
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (weights[i] / (2 * got[i] - 1), -i))
    else:
        heap = [(-weights[i] / (2 * g + 1), i) for i, g in enumerate(got) if g < caps[i]]
        heapq.heapify(heap)
        for _ in range(-over):
            i = heapq.heappop(heap)[1]
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


#: Rows of a per-source or per-shard table that are sent to every task; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SMALL_ROWS else rows


def in_parts(counted: DataFrame) -> DataFrame:
    """Rows that stand for ``n`` equal ones as rows (n, part) of at most DOCS_PER_SHARD each."""
    parts = counted.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {DOCS_PER_SHARD})")))
    return parts.withColumn("n", F.least(F.lit(DOCS_PER_SHARD), F.col("n") - F.col("part") * DOCS_PER_SHARD))


def with_shards(dealt: DataFrame, stats: DataFrame, max_shards: int) -> DataFrame:
    """``dealt`` (from ``in_parts``) with the shard of each part; ``stats``: (src, rows, ...) of each source."""
    total = stats.agg(F.sum("rows")).first()[0] or 1  # a local table
    per = max(DOCS_PER_SHARD, -(-total // max_shards))
    by = stats.select("src", F.ceil(F.col("rows") / per).cast("long").alias("shards"))
    return dealt.join(by, "src").withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "tie", "part"), F.col("shards"))).drop("shards")


def plan(counted: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, block_words=BLOCK_WORDS, max_shards=MAX_SHARDS) -> tuple[DataFrame, DataFrame]:
    """From rows of ``count_equal``: per-source (src, rows, source_size, target) and per-shard (src, shard, blocks, quota, offset)."""
    spark, words_of = counted.sparkSession, F.sum(F.col("size") * F.col("n")).alias("size")
    found = counted.groupBy("src").agg(F.sum("n").alias("rows"), words_of).collect()
    sizes = {r["src"]: r["size"] for r in found}
    aim = targets(sizes, weights, share, cap)
    stats = small(spark.createDataFrame([(r["src"], r["rows"], r["size"], aim[r["src"]]) for r in found], "src string, rows long, source_size long, target double"), len(found))
    shards = with_shards(in_parts(counted), stats, max_shards).groupBy("src", "shard").agg(words_of).collect()
    by: dict[str, list[tuple[int, int, int]]] = {}
    for r in sorted(shards, key=lambda r: (r["src"], r["shard"])):
        by.setdefault(r["src"], []).append((r["shard"], r["size"], -(-r["size"] // block_words)))
    names = sorted(by)
    most = [cap * sum(n for *_, n in by[k]) for k in names]
    blocks = sainte_lague([aim[k] for k in names], round(sum(aim.values()) / block_words), most)
    rows = []
    for k, quota in zip(names, blocks, strict=True):
        for (shard, _, n), q in zip(by[k], sainte_lague([s for _, s, _ in by[k]], quota, [cap * n for *_, n in by[k]]), strict=True):
            rows.append((k, shard, n, q, random.Random(f"{SEED}/{k}/{shard}").randrange(n) if n else 0))
    return stats, small(spark.createDataFrame(rows, "src string, shard long, blocks long, quota long, offset long"), len(rows))


def place(counted: DataFrame, stats: DataFrame, quotas: DataFrame, block_words=BLOCK_WORDS, max_shards=MAX_SHARDS, many: bool = True) -> DataFrame:
    """``counted`` (doc_id, src, size, tie, n and any others) as a row for each of the n, with source_size, target, start, end,
    taken and the draw (base, extra, blocks, offset) of its shard. Where not ``many``, each n is 1 and no row is repeated."""
    order = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id", "size", "tie", "part")
    # dealt by shard: the window would else be content with a deal by source, and a hot source with one task
    dealt = in_parts(counted) if many else counted.withColumn("part", F.lit(0).cast("long"))
    rows = with_shards(dealt, stats, max_shards).repartition("src", "shard")
    rows = rows.withColumn("all", F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.explode(F.expr("sequence(0L, n - 1)")) if many else F.lit(0)).withColumn("end", F.col("all") - F.col("after") * F.col("size"))
    rows = rows.withColumn("start", F.col("end") - F.col("size"))
    rows = rows.join(quotas, ["src", "shard"]).join(stats.select("src", "source_size", "target"), "src")
    rows = rows.withColumn("base", F.expr("if(blocks = 0, 0L, quota div blocks)")).withColumn("extra", F.expr("if(blocks = 0, 0L, quota % blocks)"))
    n, b = "greatest(blocks, 1L)", f"{block_words}L"
    upto = lambda x: (  # noqa: E731  words taken of the shard's first x
        f"(base * {x} + {b} * ((({x} div {b} - 1) * extra + offset + {n}) div {n} - (offset - extra + {n}) div {n})"
        f" + if(pmod(({x} div {b}) * extra + offset, {n}) < extra, {x} % {b}, 0L))"
    )
    return rows.withColumn("taken", F.expr(f"{upto('`end`')} - {upto('`start`')}"))


def sized_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, src, size, tie) of each row; ``tie`` is a key of all its columns, and which of them are null."""
    held = [F.map_entries(F.col(f"`{n}`")) if kind.startswith("map") else F.col(f"`{n}`") for n, kind in docs.dtypes]
    tie = F.xxhash64(*held, *(c.isNull() for c in held))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(docs["source"]).alias("src"), words(docs["text"]).alias("size"), tie.alias("tie"), *more)


KEY = ("doc_id", "src", "size", "tie")


def count_equal(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size, tie, n): rows equal in all columns as one, with their number; a written table."""
    return materialise(sized_rows(docs).groupBy(*KEY).agg(F.count("*").alias("n")), "sized")


def with_rows(docs: DataFrame, counted: DataFrame) -> tuple[DataFrame, bool]:
    """Rows (KEY, n, r) that together stand for those of ``docs``, r their columns: those with more than DOCS_PER_SHARD
    copies once, picked before they are dealt, the others each by itself; and whether there are any of the first kind."""
    rows = sized_rows(docs, F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("r"))
    hot = counted.where(F.col("n") > DOCS_PER_SHARD)
    found = hot.count()
    if not found:
        return rows.withColumn("n", F.lit(1).cast("long")), False
    other = small(hot.select(*[F.col(k).alias(f"hot_{k}") for k in KEY], "n"), found)
    same = rows["doc_id"].eqNullSafe(other["hot_doc_id"])
    for k in KEY[1:]:
        same &= rows[k] == other[f"hot_{k}"]
    once = rows.join(other, same).groupBy(*KEY, "n").agg(F.first("r").alias("r"))
    return rows.join(other, same, "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(once), True


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs`` (doc_id, source, text).

    Null texts have size 0 and nothing is taken of them; null is a source of its own, last in
    order; repeated rows each hold their own place; an empty table gives no rows. Equal inputs
    give equal results whatever their partitioning. Other columns, whatever their names, only help to tell rows apart."""
    counted = count_equal(docs)
    stats, quotas = plan(counted, **how)
    return place(counted, stats, quotas).select("doc_id", "size", "source_size", "target", "taken")


def mix_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a row is drawn from, its text
    cut to the words drawn (white space between them stays); rows drawn whole keep their text unchanged."""
    names, counted = docs.columns, count_equal(docs)
    stats, quotas = plan(counted, **how)
    rows, many = with_rows(docs, counted)
    placed = place(rows, stats, quotas, many=many).where("taken > 0")
    # whole blocks come `base` times, drawn ones once more: at most cap passes over a row
    passes = placed.withColumn("pass", F.explode(F.expr("sequence(1, cast(base + if(extra > 0, 1, 0) as int))")))
    b = BLOCK_WORDS
    some = F.col("pass") > F.col("base")
    pieces = F.expr(
        f"filter(transform(sequence(`start` div {b}L, (`end` - 1) div {b}L), k -> struct(k as k, greatest(k * {b}L, `start`) - `start` as lo, least((k + 1) * {b}L, `end`) - `start` as hi)), x -> pmod(x.k * extra + offset, blocks) < extra)"
    )
    passes = passes.withColumn("pieces", F.when(some, pieces)).where(~some | (F.size("pieces") > 0))
    text = F.col("r.text")
    tokens = F.regexp_extract_all(text, F.lit(rf"{WORD}\s*"), F.lit(0))
    # through an array of one, so that the words are found once, not for each piece
    cut = F.transform(F.array(tokens), lambda t: F.array_join(F.transform("pieces", lambda x: F.array_join(F.slice(t, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")), "")), ""))[0]
    whole = ~some | (F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"]) == F.col("size"))
    passes = passes.withColumn("cut", F.when(whole, text).otherwise(cut))
    return passes.select(*[F.col("cut").alias("text") if c == "text" else F.col(f"r.`{c}`").alias(c) for c in names])


def op6_apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
