"""Run-table analytics: costs, portfolios, regret, intervals, survival, ranks.

A run has algorithm, dataset, param_name, param_value, runtime_s, peak_memory_mb,
generator_count, timed_out, error; a configuration is (dataset, param_name, param_value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIMEOUT = 3600.0
CONFIG = ["dataset", "param_name", "param_value"]


def latest_runs(rows: DataFrame, key: str = "run_id", loaded: str = "loaded_at") -> DataFrame:
    """One row per run: the one loaded last (re-runs replace older rows); combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, loaded)]
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), loaded).alias("r"))
    return g.select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def completed() -> Column:
    """Neither timed out nor failed, with a runtime."""
    return ~F.coalesce("timed_out", F.lit(False)) & (F.coalesce("error", F.lit("")) == "") & F.col("runtime_s").isNotNull()


def failure_class() -> Column:
    """ok, timeout, memory, stack, native (a signal or exit code), output, error; a timeout is no error."""
    e = F.lower(F.coalesce("error", F.lit("")))
    return (
        F.when(F.coalesce("timed_out", F.lit(False)), "timeout").when(e == "", F.when(F.col("runtime_s").isNull(), "no runtime").otherwise("ok")).when(e.rlike("out of ?memory|killed by limit|exit code 137"), "memory")
        .when(e.rlike("stack ?overflow"), "stack").when(e.rlike("segmentation|exit code"), "native").when(e.rlike("no output"), "output").otherwise("error")
    )


def conventional_count(rc: Column, count: Column) -> Column:
    """Whether an exit status only repeats the number of patterns (whole or its last byte)."""
    return (rc == count) | (rc == count.bitwiseAND(F.lit(0xFF)))


def par10() -> Column:
    """Runtime, or ten times the time limit for a run that didn't complete."""
    return F.when(completed(), F.col("runtime_s")).otherwise(F.lit(10 * TIMEOUT))


def costs(runs: DataFrame) -> DataFrame:
    """(configuration, algorithm, cost): the best PAR10 of each algorithm on each configuration."""
    return runs.groupBy(*CONFIG, "algorithm").agg(F.min(par10()).alias("cost"))


def algorithm_summary(runs: DataFrame) -> DataFrame:
    """Counts of outcomes and the runtimes, memory and pattern counts of completed runs by algorithm."""
    ok = completed()
    late = F.coalesce("timed_out", F.lit(False))
    of = lambda c: F.when(ok, F.col(c))
    return runs.groupBy("algorithm").agg(
        F.count("*").alias("n_total"), F.count(F.when(ok, 1)).alias("n_ok"), F.count(F.when(late, 1)).alias("n_dnf"), F.count(F.when(~ok & ~late, 1)).alias("n_crash"), F.avg(of("runtime_s")).alias("mean_runtime"), F.min(of("runtime_s")).alias("min_runtime"),
        F.max(of("runtime_s")).alias("max_runtime"), F.avg(of("peak_memory_mb")).alias("mean_memory"), F.avg(of("generator_count")).alias("mean_count"),
    )


def memory_pivot(runs: DataFrame, algorithms: list[str]) -> DataFrame:
    """(dataset, one column per algorithm): mean memory of completed runs; datasets without all of them are dropped."""
    return runs.where(completed() & F.col("algorithm").isin(*algorithms)).groupBy("dataset").pivot("algorithm", algorithms).agg(F.avg("peak_memory_mb")).dropna()


def best_and_second(c: DataFrame) -> DataFrame:
    """(configuration, best, second, winner, n): one pass by two-smallest of each configuration; an algorithm is one row of it."""
    two = F.array_sort(F.collect_list(F.struct("cost", "algorithm")))
    g = c.groupBy(*CONFIG).agg(two.alias("s"))
    return g.select(*CONFIG, F.col("s")[0]["cost"].alias("best"), F.get("s", F.lit(1))["cost"].alias("second"), F.col("s")[0]["algorithm"].alias("winner"), F.size("s").alias("n"))


def portfolio(runs: DataFrame) -> DataFrame:
    """(algorithm, configs, mean_par10, geo_ratio, wins): against the best of each configuration."""
    c = costs(runs)
    j = c.join(best_and_second(c), CONFIG)
    return j.groupBy("algorithm").agg(F.count("*").alias("configs"), F.avg("cost").alias("mean_par10"), F.exp(F.avg(F.log(F.greatest("cost", F.lit(0.001)) / F.greatest("best", F.lit(0.001))))).alias("geo_ratio"), F.sum(F.when(F.col("algorithm") == F.col("winner"), 1).otherwise(0)).alias("wins"))


def marginal_contribution(runs: DataFrame) -> DataFrame:
    """(algorithm, wins, contribution, share): growth of the summed best cost if the algorithm is left out (sole solvers: to the penalty)."""
    b = best_and_second(costs(runs)).withColumn("gain", F.coalesce("second", F.lit(10 * TIMEOUT)) - F.col("best"))
    g = b.groupBy(F.col("winner").alias("algorithm")).agg(F.count("*").alias("wins"), F.sum("gain").alias("contribution"))
    total = g.agg(F.sum("contribution").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("algorithm", "wins", "contribution", F.when(F.col("all") > 0, F.col("contribution") / F.col("all")).alias("share"))  # one row


def normalised_par10(runs: DataFrame) -> DataFrame:
    """(algorithm, npar10) = (mean - VBS) / (SBS - VBS) over the algorithm's own configurations; null if SBS = VBS."""
    p = portfolio(runs)
    c = costs(runs)
    vbs = best_and_second(c).agg(F.avg("best").alias("vbs"))
    sbs = p.agg(F.min_by("mean_par10", F.struct(-F.col("configs"), "mean_par10")).alias("sbs"))
    gap = F.col("sbs") - F.col("vbs")
    return p.crossJoin(F.broadcast(vbs)).crossJoin(F.broadcast(sbs)).select("algorithm", F.when(F.abs(gap) > 1e-12, (F.col("mean_par10") - F.col("vbs")) / gap).alias("npar10"))


def regret(runs: DataFrame, column: str = "runtime_s", floor: float = 0.01, failed: float = 10.0) -> DataFrame:
    """(algorithm, instances, geo_regret): cost over the best completed one; a run that failed counts `failed`.

    Configurations with fewer than two candidates or none completed are skipped.
    """
    v = F.greatest(F.col(column), F.lit(floor))
    c = runs.groupBy(*CONFIG, "algorithm").agg(F.min(F.when(completed(), v)).alias("v"))
    best = c.groupBy(*CONFIG).agg(F.min("v").alias("best"), F.count("*").alias("n")).where("n >= 2 AND best IS NOT NULL")
    j = c.join(best, CONFIG).withColumn("r", F.coalesce(F.col("v") / F.col("best"), F.lit(failed)))
    return j.groupBy("algorithm").agg(F.count("*").alias("instances"), F.exp(F.avg(F.log("r"))).alias("geo_regret"))


def excess_memory(runs: DataFrame) -> DataFrame:
    """(algorithm, median_excess, over_10): memory above the configuration's smallest: median, and share above 10 MB."""
    c = runs.where(completed() & F.col("peak_memory_mb").isNotNull()).groupBy(*CONFIG, "algorithm").agg(F.min("peak_memory_mb").alias("m"))
    best = c.groupBy(*CONFIG).agg(F.min("m").alias("best"))
    j = c.join(best, CONFIG).withColumn("x", F.col("m") - F.col("best"))
    return j.groupBy("algorithm").agg(F.percentile("x", 0.5).alias("median_excess"), F.avg(F.when(F.col("x") > 10, 1.0).otherwise(0.0)).alias("over_10"))


def design_effect(runs: DataFrame) -> DataFrame:
    """(n, groups, icc, n_eff) of log10 runtime by dataset: variance between over total, n / (1 + (mean size - 1) icc)."""
    x = runs.where(completed() & (F.col("runtime_s") > 0)).select("dataset", F.log10("runtime_s").alias("x"))
    g = x.groupBy("dataset").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    one = g.agg(F.sum("k").alias("n"), F.count("*").alias("groups"), (F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mean"), (F.sum(F.col("k") * F.col("m") * F.col("m")) / F.sum("k")).alias("msq"), (F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("within"))
    between = F.col("msq") - F.col("mean") * F.col("mean")
    icc = between / (between + F.col("within"))
    return one.select("n", "groups", icc.alias("icc"), (F.col("n") / (1 + (F.col("n") / F.col("groups") - 1) * icc)).alias("n_eff"))


def conformal_interval(residuals: DataFrame, group: str, by: str, alpha: float = 0.10) -> DataFrame:
    """(by, k, lo, hi): split-conformal quantiles of residual r with alpha tightened to alpha k / (k + 1), k groups."""
    # alpha differs by row of `by`, so quantiles are read off the counted residuals at their own place (linear between two)
    n = residuals.where("r IS NOT NULL").groupBy(by, "r").agg(F.count("*").alias("c"))
    over = Window.partitionBy(by).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    k = residuals.groupBy(by).agg(F.countDistinct(group).alias("k"), F.count("r").alias("n"))
    s = n.withColumn("end", F.sum("c").over(over)).join(k, by)  # residual r stands at places end - c to end - 1
    a = F.lit(alpha) * F.col("k") / (F.col("k") + 1)

    def at(q: Column) -> Column:
        p = q * (F.col("n") - 1)
        low, high = F.floor(p), F.least(F.floor(p) + 1, F.col("n") - 1)
        here = lambda x: F.max(F.when((x >= F.col("end") - F.col("c")) & (x < F.col("end")), F.col("r")))
        return here(low) + F.max(p - F.floor(p)) * (here(high) - here(low))

    return s.groupBy(by, "k").agg(at(a / 2).alias("lo"), at(1 - a / 2).alias("hi"))


def pooled_interval(residuals: DataFrame, group: str, by: str, alpha: float = 0.10) -> DataFrame:
    """(by, lo, hi): quantiles of the mean of the groups' distributions: every residual weighs one over its group's size."""
    n = residuals.groupBy(by, group).agg(F.count("*").alias("n"))
    w = residuals.join(n, [by, group]).groupBy(by, "r").agg(F.sum(1 / F.col("n")).alias("w"))
    over = Window.partitionBy(by).orderBy("r")
    c = w.withColumn("c", F.sum("w").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    total = w.groupBy(by).agg(F.sum("w").alias("t"))
    c = c.join(total, by)
    first = lambda q: F.min(F.when(F.col("c") >= q * F.col("t") - 1e-9, F.col("r")))
    return c.groupBy(by).agg(first(alpha / 2).alias("lo"), first(1 - alpha / 2).alias("hi"))


def coverage(residuals: DataFrame, bounds: DataFrame, group: str, by: str) -> DataFrame:
    """(by, coverage): share of residuals within their bounds, averaged over groups."""
    j = residuals.join(bounds, by).withColumn("in", F.when(F.col("r").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0))
    return j.groupBy(by, group).agg(F.avg("in").alias("c")).groupBy(by).agg(F.avg("c").alias("coverage"))


def count_agreement(runs: DataFrame, with_empty: list[str]) -> DataFrame:
    """(configuration, algorithms, counts): distinct pattern counts of completed runs, without the empty set some emit."""
    c = F.col("generator_count") - F.when(F.col("algorithm").isin(*with_empty), 1).otherwise(0)
    return runs.where(completed() & F.col("generator_count").isNotNull()).groupBy(*CONFIG).agg(F.countDistinct("algorithm").alias("algorithms"), F.countDistinct(c).alias("counts"))


def pareto_front(points: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of `points` that no other row beats: sorted by x, those with a y below all before; ties stay.

    One row per algorithm is expected, so the running minimum is a window over few rows.
    """
    best = points.groupBy(x).agg(F.min(y).alias(y))  # of equal x the smallest y
    low = best.withColumn("_low", F.min(y).over(Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)))
    return points.join(low.where((F.col("_low").isNull()) | (F.col(y) < F.col("_low"))).select(x, y), [x, y], "left_semi")


def mean_ranks(runs: DataFrame) -> DataFrame:
    """(algorithm, mean_rank): average rank of the cost on each configuration, ties share their mean rank."""
    c = costs(runs)
    w = Window.partitionBy(*CONFIG)
    r = c.withColumn("lo", F.rank().over(w.orderBy("cost"))).withColumn("k", F.count("*").over(Window.partitionBy(*CONFIG, "cost")))
    return r.groupBy("algorithm").agg(F.avg(F.col("lo") + (F.col("k") - 1) / 2).alias("mean_rank"))


def kaplan_meier(runs: DataFrame) -> DataFrame:
    """(algorithm, t, s): product-limit survival of the runtime; runs that didn't complete are censored at the time limit."""
    t = F.when(completed(), F.least("runtime_s", F.lit(TIMEOUT))).otherwise(F.lit(TIMEOUT))
    e = runs.select("algorithm", t.alias("t"), completed().cast("int").alias("d")).groupBy("algorithm", "t").agg(F.sum("d").alias("d"), F.count("*").alias("k"))
    w = Window.partitionBy("algorithm").orderBy("t")
    risk = e.withColumn("risk", F.sum("k").over(w.rowsBetween(0, Window.unboundedFollowing))).where("d > 0")
    step = F.when(F.col("d") >= F.col("risk"), F.lit(-700.0)).otherwise(F.log(1 - F.col("d") / F.col("risk")))
    return risk.select("algorithm", "t", F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("s"))


def restricted_mean(curve: DataFrame) -> DataFrame:
    """(algorithm, rmst, s_end, e_par10, median): integrals of survival curves up to the time limit.

    S is 1 before the first step and constant after each; E[PAR10] = rmst + 9 C S(C); the median is the first time with S <= 0.5, else C.
    """
    w = Window.partitionBy("algorithm").orderBy("t")
    nxt = F.coalesce(F.lead("t").over(w), F.lit(TIMEOUT))
    c = curve.withColumn("area", F.col("s") * (nxt - F.col("t")))
    g = c.groupBy("algorithm").agg((F.min("t") + F.sum("area")).alias("rmst"), F.min("s").alias("s_end"), F.coalesce(F.min(F.when(F.col("s") <= 0.5, F.col("t"))), F.lit(TIMEOUT)).alias("median"))
    return g.select("algorithm", "rmst", "s_end", (F.col("rmst") + 9 * TIMEOUT * F.col("s_end")).alias("e_par10"), "median")


def nearest(points: DataFrame, queries: DataFrame, features: list[str], k: int) -> DataFrame:
    """(query, point, distance): the k nearest points of each query on standardised features (population sd, at least 1e-12).

    queries is a stated small set (one row per algorithm); it meets all points in blocks, then the top k by window.
    """
    stats = points.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.greatest(F.stddev_pop(f), F.lit(1e-12)).alias(f"s_{f}") for f in features))
    q = queries.select(F.col("query"), *(F.col(f).alias(f"q_{f}") for f in features))
    j = points.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(q))
    dist = sum(F.pow((F.col(f) - F.col(f"q_{f}")) / F.col(f"s_{f}"), 2) for f in features)
    w = Window.partitionBy("query").orderBy("distance", "point")
    return j.select("query", "point", F.sqrt(dist).alias("distance")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query", "point", "distance")


def bootstrap_means(values: DataFrame, group: str, value: str, resamples: int = 200, seed: int = 1) -> DataFrame:
    """(mean, lo, hi): cluster bootstrap over groups, 5 to 95 %. Each group enters a resample a Poisson number of times.

    Groups are summed first, so a resample draws over groups, not rows; Poisson draws keep the resampling distributed.
    """
    g = values.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    r = g.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64(F.col(group), "b", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    w = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.99634, 4).otherwise(5)
    m = r.withColumn("w", w).groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", 0.05).alias("lo"), F.percentile("m", 0.95).alias("hi"))
