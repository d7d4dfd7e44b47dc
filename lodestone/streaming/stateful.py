"""Stateful streams: the newest items of each key, kept between batches.

One processor serves rolling latency samples (the last 1,000 of a kind) and the list of a cache's keys used last: state holds at most
n items a key, merged by time, so the result doesn't depend on the order in which rows come. A late row counts if it is among
the newest n, and changes nothing if not; an item that comes again stands at its latest time. Before rows reach the state, each Arrow
batch hands on no more than its own newest n of a key, so a hot key sends little to its one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: State of this kind lives in RocksDB, which the session must name.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ITEMS = "at array<long>, id array<string>, value array<double>"


def with_state(spark: SparkSession) -> SparkSession:
    """The session, set up for state that :func:`newest` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _cut(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n newest items by time, ties by greater id, each id once at its latest time; rows without a time or id are left out."""
    rows = rows.dropna(subset=["at", "id"]).sort_values(["at", "id"], ascending=False, kind="stable")
    return rows.drop_duplicates("id").head(n)


class Newest(StatefulProcessor):
    def __init__(self, n: int, items: bool):
        self.n, self.items = n, items

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", _ITEMS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        parts = [p[["at", "id", "value"]] for p in rows]
        if self.kept.exists():
            parts.append(pd.DataFrame(dict(zip(("at", "id", "value"), map(list, self.kept.get()), strict=True))))
        now = _cut(pd.concat([p.astype({"at": "Int64", "id": object, "value": "Float64"}) for p in parts]), self.n)
        value = [None if pd.isna(v) else float(v) for v in now["value"]]
        self.kept.update((now["at"].astype(int).tolist(), now["id"].tolist(), value))
        if self.items:
            yield pd.DataFrame({"key": key[0], "id": now["id"].tolist(), "at": now["at"].astype(int).tolist()})
        else:
            some = [v for v in value if v is not None]
            yield pd.DataFrame({"key": [key[0]], "n": [len(now)], "mean": [sum(some) / len(some) if some else None]}).astype({"mean": "float64"})

    def close(self) -> None:
        pass


def newest(stream: DataFrame, by: str, at: str, tie: str, value: str | None = None, n: int = 1000, items: bool = False) -> DataFrame:
    """Of a stream, the n newest rows of each ``by`` by the time ``at``, ties by ``tie``, which names an item.

    Gives (key, n, mean of ``value``) for each key that a batch touched, or with ``items`` its whole list (key, id, at in
    microseconds); the latest batch of a key holds. A null key is one of its own, written as null."""
    rows = stream.select(F.col(by).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("string").alias("id"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([_cut(own, n) for _, own in batch.groupby("key", dropna=False)]) if len(batch) else batch

    near = rows.mapInPandas(first, "key string, at long, id string, value double")
    shape = "key string, id string, at long" if items else "key string, n long, mean double"
    return near.groupBy("key").transformWithStateInPandas(statefulProcessor=Newest(n, items), outputStructType=shape, outputMode="Update", timeMode="None")
