"""Rank tests and comparisons over the run table; every statistic is one pass of windows and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Two-sided 5 % quantiles of the studentised range over sqrt(2), for 2 to 10 treatments.
NEMENYI_05 = [1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164]


def average_rank(rows: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    """rows with `to`: the rank of value within `by`, ties share their mean rank."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(value))
    same = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn(to, low + (same - 1) / 2)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution by a rational approximation (absolute error below 1.5e-7)."""
    # fixed values: coefficients of the classical approximation of the error function
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, rho): rank correlation of x and y within each group; rows with a null in either are left out, rho is null without spread."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(by), F.col(x).alias("_x"), F.col(y).alias("_y"))
    r = average_rank(average_rank(r, [by], "_x", "_rx"), [by], "_y", "_ry")
    return r.groupBy(by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho")).withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))


def wilcoxon(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, w_plus, w_minus, z, p) of the signed ranks of a - b; zero differences are left out; normal approximation with ties."""
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_size", F.abs("_d"))
    r = average_rank(d, by, "_size", "_r")
    t = r.groupBy(*by, "_size").agg(F.count("*").alias("_k")).groupBy(*by).agg(F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).alias("ties"))
    s = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread)
    return s.join(t, by).withColumn("z", z).select(*by, "n", "w_plus", "w_minus", "z", normal_tail(F.col("z")).alias("p"))


def holm(tests: DataFrame, name: list[str], p: str = "p") -> DataFrame:
    """(name, p, adjusted): step-down adjusted p-values of a family of tests (one row each); ties in order of name, nulls are no tests."""
    w = Window.orderBy(p, *name)
    m = tests.agg(F.count(p).alias("m"))
    r = tests.where(F.col(p).isNotNull()).withColumn("i", F.row_number().over(w)).crossJoin(F.broadcast(m))  # one row
    step = F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col(p))
    return r.withColumn("step", step).select(*name, p, F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted"))


def friedman(costs: DataFrame, block: list[str], treatment: str, value: str) -> DataFrame:
    """(blocks, treatments, chi2, critical_difference) over the blocks that hold every treatment."""
    k = costs.select(treatment).distinct().agg(F.count("*").alias("_all"))
    full = costs.groupBy(*block).agg(F.countDistinct(treatment).alias("_own")).crossJoin(F.broadcast(k)).where("_own = _all").select(*block)  # one row
    ranked = average_rank(costs.join(full, block, "left_semi"), block, value, "_r")
    mean = ranked.groupBy(treatment).agg(F.avg("_r").alias("_mean"), F.count("*").alias("_n"))
    one = mean.agg(F.max("_n").alias("blocks"), F.count("*").alias("treatments"), F.sum(F.col("_mean") * F.col("_mean")).alias("sq"))
    n, t = F.col("blocks"), F.col("treatments")
    q = F.get(F.array(*map(F.lit, NEMENYI_05)), (t - 2).cast("int"))
    chi = 12 * n / (t * (t + 1)) * (F.col("sq") - t * (t + 1) * (t + 1) / 4)
    return one.select("blocks", "treatments", chi.alias("chi2"), F.when(t >= 2, q * F.sqrt(t * (t + 1) / (6 * n))).alias("critical_difference"))


def mcnemar(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, only_a, only_b, chi2) of two yes-no outcomes, with continuity correction; null if they never differ."""
    g = pairs.groupBy(*by).agg(F.count(F.when(F.col(a) & ~F.col(b), 1)).alias("only_a"), F.count(F.when(~F.col(a) & F.col(b), 1)).alias("only_b"))
    d = F.col("only_a") + F.col("only_b")
    return g.withColumn("chi2", F.when(d > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), F.lit(2)) / d))
