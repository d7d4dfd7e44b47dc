"""Leaderboards as text: cells by kind of column, rows in order, tables in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(name: str) -> Column:
    """A figure as text: shares of coverage in percent, milliseconds without decimals, others with three; ``--`` for none."""
    value = F.col(name)
    if name.endswith("coverage"):
        text = F.format_string("%.0f%%", F.bround(value.cast("double") * 100, 0))
    elif name.endswith("_ms"):
        text = F.format_string("%.0f", F.bround(value.cast("double"), 0))
    else:
        text = F.format_string("%.3f", F.round(value.cast("double"), 3))
    return F.when(value.isNotNull(), text).otherwise("--")


def stamp(at: Column) -> Column:
    """A time as UTC, to the second, whatever the session's zone."""
    zone = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(zone, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def table(rows: DataFrame, key: str, columns: list[str], by: str) -> DataFrame:
    """(place, line): a Markdown table of ``rows``, one for each configuration, best ``by`` first, those without a figure last; ties by key."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(by), key))  # one row for each configuration
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce(F.col(key).cast("string"), F.lit("--")), *[cell(c) for c in columns]), F.lit(" |"))
    body = rows.select((place + 1).cast("long").alias("place"), line.alias("line"))
    head = [(0, "| " + " | ".join([key, *columns]) + " |"), (1, "|" + "---|" * (len(columns) + 1))]
    return rows.sparkSession.createDataFrame(head, "place long, line string").unionByName(body)
