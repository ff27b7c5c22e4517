"""Consolidating pairwise matches into groups (connected components).

Method: peel the giant component by frontier breadth-first joins from the vertex
of highest degree, anti-join it away, and label the remaining small components
by minimum propagation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def undirected_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct (src, dst) in both directions; nulls and self pairs dropped."""
    one = (
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .distinct()
    )
    return one.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def _propagate_minima(edges: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex by minimum propagation.

    Each round hooks a vertex to its smallest neighbour, halves the paths twice
    and contracts the edges, so chains shrink geometrically.
    """
    labels = cut(edges.select(F.col("src").alias("vertex")).distinct().withColumn("label", F.col("vertex")))
    while not edges.isEmpty():
        hook = edges.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("up"))
        for _ in range(2):
            above = hook.select(F.col("src").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up", "left").select("src", F.coalesce("top", "up").alias("up"))
        hook = cut(hook)
        to = hook.select(F.col("src").alias("dst"), F.col("up").alias("dst_up"))
        labels = cut(labels.join(hook.withColumnRenamed("src", "label"), "label", "left").select("vertex", F.coalesce("up", "label").alias("label")))
        edges = cut(
            edges.join(hook, "src").join(to, "dst").where(F.col("up") != F.col("dst_up")).select(F.col("up").alias("src"), F.col("dst_up").alias("dst")).distinct()
        )
    return labels


def consolidate(pairs: DataFrame, left: str, right: str, max_levels: int = 24) -> DataFrame:
    """(vertex, group_id) for every vertex that a pair links to another one.

    group_id is the smallest vertex of the group. Null ends and self pairs link
    nothing; repeated and reversed pairs count once; an empty table gives an empty
    result; other columns are ignored. Values may repeat without bound: every step
    is a join or a pre-aggregated group. A giant component that is more than
    `max_levels` steps wide is contracted to one vertex as far as it was reached,
    and the rest of it is finished by minimum propagation, so the result is exact.
    """
    edges = cut(undirected_edges(pairs, left, right))
    top = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", -F.col("src"))).alias("m"), F.count("*").alias("v")).first()
    kind = edges.schema["src"].dataType
    if not top["v"]:
        return edges.select(F.col("src").alias("vertex"), F.col("src").alias("group_id"))
    root = -top["m"][1]
    spark = pairs.sparkSession
    frontier = spark.range(1).select(F.lit(root).cast(kind).alias("src"))
    seen, ended = frontier, False
    for _ in range(max_levels):
        step = edges.join(F.broadcast(frontier), "src") if _ == 0 else edges.join(frontier, "src")
        frontier = cut(step.select(F.col("dst").alias("src")).distinct().join(seen, "src", "left_anti"))
        if frontier.isEmpty():
            ended = True
            break
        seen = seen.unionAll(frontier)
    seen = cut(seen)
    least = seen.agg(F.min("src")).first()[0]
    giant = seen.select(F.col("src").alias("vertex"), F.lit(least).cast(kind).alias("label"))
    rest = edges.join(seen, "src", "left_anti")
    if not ended:  # the part reached becomes one vertex, named by its minimum
        rest = rest.join(seen.select(F.col("src").alias("dst"), F.lit(True).alias("in_giant")), "dst", "left")
        rest = rest.select("src", F.when(F.col("in_giant"), F.lit(least).cast(kind)).otherwise(F.col("dst")).alias("dst")).distinct()
        rest = rest.unionAll(rest.where(F.col("dst") == least).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    small = _propagate_minima(cut(rest))
    if not ended:
        of_least = small.where(F.col("vertex") == least).select("label").first()
        if of_least:
            giant = giant.withColumn("label", F.lit(of_least[0]).cast(kind))
        small = small.where(F.col("vertex") != least)
    return giant.unionAll(small).select("vertex", F.col("label").alias("group_id"))
