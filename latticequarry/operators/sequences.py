"""Sequential patterns and generators over sequences of itemsets."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A sequence as text: items of an itemset joined by ' ', itemsets by ' > '.
TEXT = "array_join(transform(sequence, x -> array_join(array_sort(x), ' ')), ' > ')"
SHORTER = (
    "flatten(transform(sequence(0, size(sequence) - 1), i -> transform(sequence(0, size(sequence[i]) - 1), j -> "
    "filter(transform(sequence, (x, k) -> CASE WHEN k = i THEN filter(x, (y, l) -> l <> j) ELSE x END), x -> size(x) > 0))))"
)


def contains(seq: Column, pattern: Column) -> Column:
    """Greedy earliest match: the pattern's itemsets are subsets of itemsets of the sequence, in order."""
    # fold over the sequence: how many itemsets of the pattern are matched so far
    step = F.aggregate(seq, F.lit(0), lambda k, x: F.when((k < F.size(pattern)) & (F.size(F.array_except(F.get(pattern, k), x)) == 0), k + 1).otherwise(k))
    return step == F.size(pattern)


def immediate_subsequences(rows: DataFrame) -> DataFrame:
    """rows with `shorter`: the distinct sequences with one item deleted; an itemset that empties goes."""
    return rows.withColumn("shorter", F.when(F.size("sequence") > 0, F.expr(f"array_distinct({SHORTER})")).otherwise(F.array().cast("array<array<array<string>>>")))


def sequence_support(data: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, support) of given patterns (column sequence); patterns are broadcast only by Catalyst's own size check.

    Rows meet patterns by an item of the pattern's first itemset, so unrelated rows don't meet; the empty pattern holds everywhere.
    """
    p = patterns.select(F.expr(TEXT).alias("pattern"), F.col("sequence").alias("p")).distinct().withColumn("item", F.get(F.get("p", 0), 0))
    s = data.select("sid", F.col("sequence").alias("s")).withColumn("item", F.explode(F.array_distinct(F.flatten("s"))))
    hit = s.join(p.where("item IS NOT NULL"), "item").where(contains(F.col("s"), F.col("p"))).groupBy("pattern").agg(F.count("*").alias("support"))
    n = data.agg(F.count("*").alias("n"))
    return p.join(hit, "pattern", "left").crossJoin(F.broadcast(n)).select("pattern", F.when(F.size("p") == 0, F.col("n")).otherwise(F.coalesce("support", F.lit(0))).alias("support"))


def sequential_patterns(data: DataFrame, minimum: int, max_length: int | None = None) -> DataFrame:
    """(sequence, pattern, length, support) of all frequent sequences, of any length unless the caller sets one.

    All of them are needed: sequence generators are not closed under subsequences. No pattern is longer than the
    longest sequence, which bounds the projection.
    """
    rows = data.where(F.size("sequence") > 0).select("sequence")
    n, longest = rows.agg(F.count("*"), F.max(F.size(F.flatten("sequence")))).first()
    max_length = max_length or longest
    if n == 0 or minimum > n:
        return data.select("sequence").limit(0).select("sequence", F.expr(TEXT).alias("pattern"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("support"))
    found = PrefixSpan(minSupport=max(0.0, (minimum - 0.5) / n), maxPatternLength=max_length, sequenceCol="sequence").findFrequentSequentialPatterns(rows)
    return found.select("sequence", F.expr(TEXT).alias("pattern"), F.size(F.flatten("sequence")).alias("length"), F.col("freq").alias("support"))


def sequential_generators(data: DataFrame, minimum: int, max_length: int | None = None, empty: bool = False) -> DataFrame:
    """(pattern, length, support): frequent sequences no immediate subsequence of which has equal support.

    {} has support n, so a single item in every sequence is none; `empty` adds {} itself.
    """
    n = data.where(F.size("sequence") > 0).count()
    freq = cut(sequential_patterns(data, minimum, max_length))
    sub = immediate_subsequences(freq).select("pattern", "support", F.explode_outer("shorter").alias("sequence")).withColumn("sub", F.expr(TEXT))
    known = freq.select(F.col("pattern").alias("sub"), F.col("support").alias("low"))
    bad = sub.join(known, "sub", "left").where((F.coalesce("low", F.lit(n)) == F.col("support"))).select("pattern").distinct()
    out = freq.join(bad, "pattern", "left_anti").select("pattern", "length", "support")
    if empty:
        out = out.unionAll(data.sparkSession.range(1).select(F.lit("").alias("pattern"), F.lit(0).alias("length"), F.lit(n).cast("long").alias("support")))
    return out
