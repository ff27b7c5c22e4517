"""Filling fixed-capacity containers with items of varying length.

Method: sum-of-squares packing. An item goes where the sum over residual gaps of the
squared number of open containers with that gap becomes smallest. Items are packed in
hash shards of bounded size; containers that a shard leaves badly filled are packed
once more, as units, so that shards cost next to nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SHARD = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (1 <= size <= capacity), placed in the given order.

    Equal choices go to the tightest gap, so results don't depend on chance.
    """
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes):
        s = int(s)
        gaps = np.flatnonzero(count[s:]) + s
        left = gaps - s
        # growth of the sum of squares if a container of each gap takes the item; full ones no longer count
        grow = 2 - 2 * count[gaps] + np.where(left > 0, 2 * count[left], -1)
        own = capacity - s
        fresh = 2 * count[own] + 1 if own else 0
        if len(gaps) and grow[k := int(grow.argmin())] <= fresh:
            g = int(gaps[k])
            b = stacks[g].pop()
            count[g] -= 1
            g -= s
        else:
            b, g = opened, own
            opened += 1
        out[i] = b
        if g:
            count[g] += 1
            stacks[g].append(b)
    return out


def _round(units: DataFrame, name: str) -> DataFrame:
    """units (capacity_id, capacity_tokens, unit, size) with their container in this round."""
    shards = F.ceil(F.col("n") / SHARD)
    n = units.groupBy("capacity_id").agg(F.count("*").alias("n"))
    # one row per capacity
    placed = units.join(F.broadcast(n), "capacity_id").withColumn("shard", F.pmod(F.xxhash64("unit"), shards).cast("long")).drop("n")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
        box = sum_of_squares(pdf["size"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        label = f"{pdf['capacity_id'].iloc[0]}-{name}{pdf['shard'].iloc[0]}-"
        return pd.DataFrame({"capacity_id": pdf["capacity_id"], "capacity_tokens": pdf["capacity_tokens"], "unit": pdf["unit"], "size": pdf["size"], "box": [f"{label}{b}" for b in box]})

    return placed.groupBy("capacity_id", "shard").applyInPandas(pack, "capacity_id int, capacity_tokens int, unit string, size long, box string")


def contents(items: DataFrame, capacities: DataFrame, well_filled: float = 0.995) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, tokens): what each container holds.

    items: (doc_id, tokens). Only items longer than a container are split, into full pieces and a rest.
    Items without tokens or id take no room and are left out; capacities below 1 hold nothing;
    repeated items are packed as often as they occur.
    """
    # the capacities are a parameter table: one row per kind of container
    caps = capacities.where("capacity_tokens >= 1").select("capacity_id", "capacity_tokens").distinct()
    # copies are numbered, so that an item's shard is the same in every run
    named = items.where("doc_id IS NOT NULL AND tokens > 0").groupBy("doc_id", "tokens").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    pieces = named.crossJoin(F.broadcast(caps)).withColumn("piece", F.explode(F.expr("sequence(0, int((tokens - 1) div capacity_tokens))")))
    pieces = pieces.select("capacity_id", "capacity_tokens", "doc_id", "piece", F.concat_ws(".", "doc_id", "tokens", "piece", "copy").alias("unit"), F.least(F.col("capacity_tokens").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity_tokens")).alias("size"))
    pieces = cut(pieces)
    first = cut(_round(pieces.where("size < capacity_tokens").select("capacity_id", "capacity_tokens", "unit", "size"), "a"))
    boxes = first.groupBy("capacity_id", "capacity_tokens", F.col("box").alias("unit")).agg(F.sum("size").alias("size"))
    second = _round(boxes.where(F.col("size") < well_filled * F.col("capacity_tokens")), "b").select(F.col("unit").alias("box"), F.col("box").alias("final"))
    at = first.join(second, "box", "left").select("capacity_id", "unit", F.coalesce("final", "box").alias("container_id"))
    part = pieces.where("size < capacity_tokens").join(at, ["capacity_id", "unit"])
    full = pieces.where("size = capacity_tokens").withColumn("container_id", F.concat(F.col("capacity_id"), F.lit("-f-"), "unit"))
    return part.select("capacity_id", "container_id", "doc_id", "piece", F.col("size").alias("tokens")).unionAll(full.select("capacity_id", "container_id", "doc_id", "piece", F.col("size").alias("tokens")))


def containers(held: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container_id, items, used, unused) of each container."""
    caps = capacities.select("capacity_id", "capacity_tokens").distinct()
    g = held.groupBy("capacity_id", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))
    return g.join(F.broadcast(caps), "capacity_id").select("capacity_id", "container_id", "items", "used", (F.col("capacity_tokens") - F.col("used")).alias("unused"))
