"""Generators of every window of an ordered transaction stream, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import itemsets


def day_windows(tx: DataFrame, order: str, size: int, slide: int) -> DataFrame:
    """tx with window_id (the window's first position): all windows [w, w + size) with w a multiple of `slide` that hold the row."""
    last = F.floor(F.col(order) / slide) * slide
    first = (F.floor((F.col(order) - size) / slide) + 1) * slide
    return tx.where(F.col(order).isNotNull()).withColumn("window_id", F.explode(F.sequence(first, last, F.lit(slide).cast("long"))))


def windowed_generators(tx: DataFrame, order: str, size: int, slide: int, absolute: int, max_size: int | None = None) -> DataFrame:
    """(window_id, items, size, support): minimal generators of each window, of any size unless the caller sets one, without the empty set.

    The window is a key of every step, so all windows are mined in the same few jobs.
    """
    db = itemsets.as_database(day_windows(tx, order, size, slide), "window_id")
    return itemsets.minimal_generators(itemsets.mine(db, absolute=absolute, max_size=max_size), "never").withColumnRenamed("g", "window_id")


def windowed_closures(tx: DataFrame, order: str, size: int, slide: int, absolute: int, max_size: int | None = None) -> DataFrame:
    """(window_id, generator, closure, support) of each window, the empty generator included."""
    db = itemsets.as_database(day_windows(tx, order, size, slide), "window_id")
    return itemsets.generator_closures(itemsets.mine(db, absolute=absolute, max_size=max_size, closures=True)).withColumnRenamed("g", "window_id")
