"""Soundness and completeness of a given pattern set against a database; comparison of pattern sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import itemsets

SPLIT = r"\|"


def audit_generators(db: DataFrame, given: DataFrame, truth: DataFrame) -> DataFrame:
    """(items, finding): bad_support, not_minimal, unknown_item or extra rows of `given` (items, support), and missing rows of `truth`.

    Supports and minimality are recomputed from the database, completeness is read off `truth`.
    """
    sub = given.select("items", F.filter(F.split("items", SPLIT), lambda x: x != "").alias("k"))
    drops = sub.select("items", F.explode(F.transform("k", lambda _, i: F.concat_ws("|", F.filter("k", lambda __, j: j != i)))).alias("less"))
    ask = given.select("items").unionAll(drops.select(F.col("less").alias("items")))
    true = itemsets.itemset_support(db, ask)
    own = given.join(true.withColumnRenamed("support", "true_support"), "items")
    wrong = own.where("support <> true_support").select("items", F.lit("bad_support").alias("finding"))
    low = drops.join(true.select(F.col("items").alias("less"), F.col("support").alias("low")), "less")
    dull = own.join(low, "items").where("low = true_support").select("items", F.lit("not_minimal").alias("finding")).distinct()
    lacking = truth.join(given, "items", "left_anti").select("items", F.lit("missing").alias("finding"))
    beyond = given.join(truth, "items", "left_anti").select("items", F.lit("extra").alias("finding"))
    return wrong.unionAll(dull).unionAll(lacking).unionAll(beyond)


def audit_closures(m: itemsets.Mined, given: DataFrame) -> DataFrame:
    """(generator, closure, finding): bad_closure where a given pair (generator, closure) has another closure in the database,
    not_generator where the first is none, and missing pairs. m: a run with closures of the same database and threshold."""
    true = itemsets.generator_closures(m).select("generator", F.col("closure").alias("true_closure"))
    j = given.select("generator", "closure").distinct().join(true, "generator", "full_outer")
    finding = F.when(F.col("closure").isNull(), "missing").when(F.col("true_closure").isNull(), "not_generator").when(F.col("closure") != F.col("true_closure"), "bad_closure")
    return j.withColumn("finding", finding).where("finding IS NOT NULL").select("generator", F.coalesce("closure", "true_closure").alias("closure"), "finding")


def pattern_set_difference(a: DataFrame, b: DataFrame, left: str = "only_left", right: str = "only_right") -> DataFrame:
    """(items, side, left_support, right_support): patterns of one set only, and those of different supports."""
    j = a.select("items", F.col("support").alias("left_support")).join(b.select("items", F.col("support").alias("right_support")), "items", "full_outer")
    side = F.when(F.col("right_support").isNull(), left).when(F.col("left_support").isNull(), right).when(F.col("left_support") != F.col("right_support"), "support")
    return j.withColumn("side", side).where("side IS NOT NULL").select("items", "side", "left_support", "right_support")
