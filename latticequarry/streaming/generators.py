"""Minimal generators of event-time windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import itemsets


def window_baskets(events: DataFrame, ts: str, tid: str, item: str, size: str, slide: str, watermark: str) -> DataFrame:
    """(window_start, tid, items): the item set of each transaction in each window; emitted once the watermark has passed it.

    State is one set per open window and transaction; late rows beyond the watermark are dropped.
    """
    w = events.where(F.col(item).isNotNull() & F.col(tid).isNotNull()).withWatermark(ts, watermark)
    g = w.groupBy(F.window(ts, size, slide), F.col(tid).alias("tid")).agg(F.collect_set(item).alias("items"))
    return g.select(F.col("window.start").alias("window_start"), "tid", "items")


def mine_windows(baskets: DataFrame, absolute: int, max_size: int | None = None) -> DataFrame:
    """(window_start, items, size, support): generators of each window of a batch of finished baskets."""
    rows = baskets.select(F.unix_micros("window_start").alias("w"), F.xxhash64(F.col("tid").cast("string")).alias("tid"), F.explode("items").alias("item"))
    found = itemsets.minimal_generators(itemsets.mine(itemsets.as_database(rows, "w"), absolute=absolute, max_size=max_size), "never")
    return found.select(F.timestamp_micros("g").alias("window_start"), "items", "size", "support")


def start(events: DataFrame, path: str, checkpoint: str, absolute: int, *, ts: str = "ts", tid: str = "user_id", item: str = "event_type", size: str = "1 day", slide: str = "1 day", watermark: str = "1 hour", max_size: int | None = None, once: bool = True) -> StreamingQuery:
    """Mine finished windows batch by batch into `path`, one folder per batch, overwritten if the batch runs again (so: exactly once).

    A window's transactions leave the state together, in the batch in which the watermark passes the window's end.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            mine_windows(batch, absolute, max_size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = window_baskets(events, ts, tid, item, size, slide, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()
