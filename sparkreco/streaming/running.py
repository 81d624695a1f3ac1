"""The batch states as Structured Streaming: running sums, day sessions, recent items, refits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkreco.operators.learning import factorize_ids


def running_weights(events: DataFrame) -> DataFrame:
    """Summed weight of each user and item, for update mode."""
    return events.groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"))


def daily_sessions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each user's items of a day, given out when no later event of it can come."""
    return events.withWatermark("timestamp", late).groupBy("user_id", F.window("timestamp", "1 day").alias("day")).agg(F.collect_set("item_id").alias("items"), F.count("*").alias("events"))


class _Recent(StatefulProcessor):
    """A user's n latest items: a list state, and a timer that clears it when no event has come for a while."""

    def __init__(self, n: int, keep_ms: int):
        self.n, self.keep_ms = n, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item_id long, at long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = dict(self.items.get()) if self.items.exists() else {}
        for f in rows:
            for item, at in zip(f["item_id"].tolist(), f["timestamp"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
                latest[item] = max(at, latest.get(item, at))
        best = sorted(latest.items(), key=lambda x: (-x[1], x[0]))[: self.n]
        self.items.put(best)
        if self.keep_ms:
            at = best[0][1] // 1000 + self.keep_ms
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame({"user_id": [key[0]], "items": [[i for i, _ in best]], "expired": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.items.clear()
        self.timer.clear()
        yield pd.DataFrame({"user_id": [key[0]], "items": [[]], "expired": [True]})

    def close(self) -> None:
        pass


def recent_per_user(events: DataFrame, n: int = 5, late: str = "1 day", keep_days: int = 0) -> DataFrame:
    """(user_id, items, expired): each user's n items with the latest events, for update mode; the state holds n pairs a user.

    Events later than the watermark allows are left out. keep_days: a user without events for so long loses the state, and a row with
    expired says so. The state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    own = events.withWatermark("timestamp", late).select("user_id", "item_id", "timestamp")
    return own.groupBy("user_id").transformWithStateInPandas(_Recent(n, keep_days * 86400000), "user_id long, items array<long>, expired boolean", "update", "eventTime")


def refit_factors(history: str, rank: int = 64) -> Callable[[DataFrame, int], None]:
    """For refit_each_batch: a batch's weights (user_id, item_id, weight) join the history folder, and the factors are fitted anew on all of it.

    A batch that comes again after a failure overwrites its own subfolder, so no weight counts twice. The factors of batch k stand in
    history/factors/k.
    """

    def fit(batch: DataFrame, number: int) -> None:
        batch.select("user_id", "item_id", "weight").write.mode("overwrite").parquet(f"{history}/weights/batch={number}")
        every = batch.sparkSession.read.parquet(f"{history}/weights").groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"))
        model, users, items = factorize_ids(every, rank=rank)
        for name, factors, ids in (("user", model.userFactors, users), ("item", model.itemFactors, items)):
            factors.join(ids.withColumn("id", F.col("idx").cast("int")), "id").select(f"{name}_id", "features").write.mode("overwrite").parquet(f"{history}/factors/{number}/{name}")

    return fit


def refit_each_batch(events: DataFrame, fit: Callable[[DataFrame, int], object], checkpoint: str) -> StreamingQuery:
    """Calls fit with each batch of what has come."""
    return events.writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
