"""Utility families: high-utility generators, their closure variant, and utility-minimal sets.

Utilities travel along the projection of the mining run, so patterns never meet transactions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import itemsets
from .itemsets import Mined, _stack, named, subsets_of


def utility_database(rows: DataFrame) -> DataFrame:
    """(tid, item, util): utilities of a repeated item in a transaction are summed; null ids, items and utilities are left out."""
    return rows.where("tid IS NOT NULL AND item IS NOT NULL AND util IS NOT NULL").groupBy("tid", "item").agg(F.sum("util").alias("util"))


def transaction_weighted_utility(util: DataFrame) -> DataFrame:
    """(item, twu): summed utility of all transactions that hold the item, an upper bound for every superset."""
    total = util.groupBy("tid").agg(F.sum("util").alias("tu"))
    return util.join(total, "tid").groupBy("item").agg(F.sum("tu").alias("twu"))


def mine_utilities(util: DataFrame, theta: int, max_size: int | None = None, generators: bool = True, closures: bool = False) -> Mined:
    """Generators (or all itemsets) of support >= 1 whose transaction-weighted utility reaches theta, with their utility u.

    The bound holds for every superset and every closure, so no set with u or closure utility >= theta is lost.
    Utilities must not be negative.
    """
    db = util.select(F.lit(0).cast("long").alias("g"), F.col("tid").cast("long").alias("tid"), F.col("item").cast("string").alias("item"), F.col("util").cast("long").alias("util"))
    return itemsets.mine(db, absolute=1, max_size=max_size, generators=generators, closures=closures, theta=theta)


def _patterns(m: Mined) -> DataFrame:
    return _stack([k.select("g", "key", "sup", "u") for k in m.kept])


def _named(rows: DataFrame, m: Mined) -> DataFrame:
    return named(rows, m.ranks).select("items", F.col("sup").alias("support"), F.col("u").alias("utility"))


def high_utility_generators(m: Mined, theta: int) -> DataFrame:
    """(items, support, utility): generators with u(X) >= theta."""
    return _named(_patterns(m).where(F.col("u") >= theta), m)


def ghui(m: Mined, theta: int) -> DataFrame:
    """(items, support, utility, closure_utility): generators (a run with closures) whose closure has u >= theta."""
    rows = _stack([c.select("g", "key", "sup", "u", "uc") for c in m.closed]).where(F.col("uc") >= theta)
    return named(rows, m.ranks).select("items", F.col("sup").alias("support"), F.col("u").alias("utility"), F.col("uc").alias("closure_utility"))


def utility_minimal(m: Mined, theta: int) -> DataFrame:
    """(items, support, utility): itemsets (a run with generators=False) with u >= theta no immediate subset of which has it."""
    high = _patterns(m).where(F.col("u") >= theta)
    sub = high.where(F.size("key") > 1).select("g", "key", F.explode(subsets_of(F.col("key"))).alias("sub"))
    bad = sub.join(high.select("g", F.col("key").alias("sub")), ["g", "sub"], "left_semi").select("g", "key").distinct()
    return _named(high.join(bad, ["g", "key"], "left_anti"), m)
