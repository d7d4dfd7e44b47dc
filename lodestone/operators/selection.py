"""Exact order statistics by group, without bringing a group into one task.

Equal values are counted first, spread over tasks by group and value. While a group still holds more than ``LIMIT``
distinct values, its range is cut into ``BINS`` of equal width, the bins are counted (partial sums, so what is
shuffled is bins, not rows), and the search goes on within the bin that holds the wanted place. What is left of it, at most
``LIMIT`` distinct values, is put in order by a window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.staging import dropped, staged

LIMIT, BINS = 1 << 16, 4096
#: From the number of values to the place of one of them, counted from 0.
Place = Callable[[Column], Column]


def nearest(p: float) -> Place:
    """The nearest-rank percentile's place: the least that has at least p hundredths of the values up to it."""
    return lambda n: F.greatest(F.ceil(n * F.lit(p) / 100) - 1, F.lit(0)).cast("long")


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Bins in order of values: -inf, finite ones by equal width, inf, NaN. Halves, so that no difference overflows."""
    x = value.cast("double")
    at = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    inner = F.least(F.floor(F.coalesce(at, F.lit(0.0)) * BINS), F.lit(BINS - 1))
    return F.when(F.isnan(x), BINS + 1).when(x == float("inf"), BINS).when(x == float("-inf"), -1).otherwise(inner).cast("int")


def order_statistics(rows: DataFrame, by: list[str], value: str, places: Mapping[str, Place], **more: Column) -> DataFrame:
    """(by, n, low, high, one column for each of ``places``, ``more`` aggregates) of the values that aren't null.

    ``more`` are aggregates over rows with a value. NaN counts as the greatest value; groups without a value give no row;
    a null in ``by`` is a group of its own. Values are numbers or timestamps. The result is a written table."""
    used = rows.where(F.col(value).isNotNull()).withColumn("key_", F.struct(*by)).withColumn("v_", F.col(value))
    counted = staged(used.groupBy("key_", "v_").agg(F.count("*").alias("c_")), "counted")
    as_number = F.col("v_").cast("double")
    finite = F.when(~F.isnan(as_number) & (F.abs(as_number) != float("inf")), as_number)
    groups = counted.groupBy("key_").agg(F.sum("c_").alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high"), F.count("*").alias("d_"), F.min(finite).alias("from_"), F.max(finite).alias("to_"))
    groups = staged(groups, "groups")
    wants = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).alias("place")) for name, place in places.items()])).alias("want")
    state = groups.select("key_", wants, F.col("low").alias("lo_"), F.col("high").alias("hi_"), "from_", "to_", "d_").select("key_", "want.name", "want.place", "lo_", "hi_", "from_", "to_", "d_")
    spent: list[DataFrame] = [counted, groups]
    ranges = ["key_", "lo_", "hi_", "from_", "to_"]
    # bins part what doubles can tell apart: the few values between two neighbouring doubles stay together
    parts = F.coalesce((F.col("d_") > LIMIT) & (F.col("lo_") < F.col("hi_")) & (F.col("to_") / 2 - F.col("from_") / 2 > 0), F.lit(False))
    while not (wide := state.where(parts)).isEmpty():
        there = counted.join(wide.select(*ranges).distinct(), "key_").where("v_ BETWEEN lo_ AND hi_")
        bins = there.withColumn("bin_", _bin(F.col("v_"), F.col("from_"), F.col("to_"))).groupBy(*ranges, "bin_").agg(F.sum("c_").alias("c_"), F.min("v_").alias("l_"), F.max("v_").alias("h_"), F.count("*").alias("b_"))
        upto = F.sum("c_").over(Window.partitionBy(*ranges).orderBy("bin_").rowsBetween(Window.unboundedPreceding, 0))  # BINS + 3 rows at most
        bins = bins.withColumn("upto_", upto).withColumn("before_", F.col("upto_") - F.col("c_")).drop("c_")
        met = wide.join(bins, ranges).where("place >= before_ AND place < upto_")
        closer = met.select("key_", "name", (F.col("place") - F.col("before_")).alias("place"), F.col("l_").alias("lo_"), F.col("h_").alias("hi_"), F.col("l_").cast("double").alias("from_"), F.col("h_").cast("double").alias("to_"), F.col("b_").alias("d_"))
        state = staged(state.where(~parts).unionByName(closer), "narrowed")
        spent.append(state)
    near = counted.join(state.select("key_", "lo_", "hi_").distinct(), "key_").where("v_ BETWEEN lo_ AND hi_")
    upto = F.sum("c_").over(Window.partitionBy("key_", "lo_", "hi_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto_", upto).select("key_", "lo_", "hi_", "v_", "upto_", (F.col("upto_") - F.col("c_")).alias("before_"))
    found = state.join(near, ["key_", "lo_", "hi_"]).where("place >= before_ AND place < upto_")
    wide_form = found.groupBy("key_").agg(*[F.max(F.when(F.col("name") == name, F.struct("v_")))["v_"].alias(name) for name in places])
    out = groups.select("key_", "n", "low", "high").join(wide_form, "key_")
    if more:
        out = out.join(used.groupBy("key_").agg(*[c.alias(name) for name, c in more.items()]), "key_")
    result = staged(out.select(*[F.col("key_")[b].alias(b) for b in by], "n", "low", "high", *places, *more), "selected")
    dropped(*spent)
    return result
