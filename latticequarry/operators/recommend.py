"""Choosing an implementation: training tables, cost models, probes, scores, budgets and tiers.

Everything is keyed by a request, so that any number of requests is answered in the same few jobs.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runs import TIMEOUT, completed

#: Factors by which a score grows beyond a budget and for a miner that lags behind in its probe.
OVER, LAG = 1e6, 1e3
OBJECTIVES = ("runtime", "memory", "balanced")


def training_rows(runs: DataFrame, features: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """Runs with the features of their dataset (inner join) and, where given, the landmarks of (dataset, threshold) (left join).

    Landmarks hold for relative thresholds only, so runs with another parameter than minsup get none.
    """
    rows = runs.join(features, "dataset")
    if landmarks is None:
        return rows
    mark = landmarks.withColumn("param_name", F.lit("minsup")).withColumnRenamed("sigma", "param_value")
    return rows.join(mark, ["dataset", "param_name", "param_value"], "left")


def domains(rows: DataFrame, features: list[str]) -> DataFrame:
    """(algorithm, feature, lo, hi): range of each feature over an algorithm's training rows."""
    long = rows.select("algorithm", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("e"))
    return long.where("e.v IS NOT NULL").groupBy("algorithm", F.col("e.feature").alias("feature")).agg(F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))


def outside(requests: DataFrame, domain: DataFrame, features: list[str], slack: float = 0.0) -> DataFrame:
    """(request, algorithm, feature): features of a request that lie beyond an algorithm's training range by more than slack."""
    long = requests.select("request", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("e")).select("request", "e.*")
    return long.join(domain, "feature").where((F.col("v") < F.col("lo") - slack) | (F.col("v") > F.col("hi") + slack)).select("request", "algorithm", "feature")


class CostModel:
    """Forests for log10 runtime, log10 memory and completion; the algorithm is one categorical feature.

    Algorithms with fewer than `least` completed rows answer with their own means instead.
    """

    def __init__(self, rows: DataFrame, features: list[str], least: int = 8, trees: int = 20, seed: int = 0):
        self.features = features
        rows = rows.withColumn("done", completed().cast("double"))
        self.index = StringIndexer(inputCol="algorithm", outputCol="algorithm_no", handleInvalid="keep").fit(rows)
        self.vector = VectorAssembler(inputCols=["algorithm_no", *features], outputCol="x", handleInvalid="skip")
        ok = rows.where("done = 1 AND runtime_s IS NOT NULL AND peak_memory_mb > 0")
        self.means = ok.groupBy("algorithm").agg(F.avg(F.log10(F.greatest("runtime_s", F.lit(0.01)))).alias("own_rt"), F.avg(F.log10("peak_memory_mb")).alias("own_mem"), F.count("*").alias("rows"))
        self.least = least
        fit = lambda kind, label, data, **kw: kind(featuresCol="x", labelCol=label, numTrees=trees, minInstancesPerNode=2, maxBins=64, seed=seed, **kw).fit(self._x(data))
        ok = ok.withColumn("rt", F.log10(F.greatest("runtime_s", F.lit(0.01)))).withColumn("mem", F.log10("peak_memory_mb"))
        self.runtime, self.memory = fit(RandomForestRegressor, "rt", ok), fit(RandomForestRegressor, "mem", ok)
        self.done = fit(RandomForestRegressor, "done", rows)  # the mean of 0 and 1 is the chance to complete

    def _x(self, rows: DataFrame) -> DataFrame:
        return self.vector.transform(self.index.transform(rows))

    @staticmethod
    def _band(rows: DataFrame, model, to: str) -> DataFrame:
        """rows with to_lo and to_hi: 5 and 95 % of the trees' own predictions."""
        names = [f"_{to}{i}" for i in range(len(model.trees))]
        for tree, n in zip(model.trees, names, strict=True):
            rows = tree.setPredictionCol(n).transform(rows)
        s = F.array_sort(F.array(*names))
        at = lambda q: F.get(s, F.lit(round(q * (len(names) - 1))))
        return rows.withColumns({to: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / len(names), to + "_lo": at(0.05), to + "_hi": at(0.95)}).drop(*names)

    def predict(self, candidates: DataFrame) -> DataFrame:
        """(request, algorithm, runtime, runtime_lo, runtime_hi, memory, memory_lo, memory_hi, p_complete) of candidates with all features."""
        rows = self._band(self._band(self._x(candidates), self.runtime, "rt"), self.memory, "mem")
        rows = self.done.setPredictionCol("p").transform(rows)
        # the table of means has one row per algorithm
        rows = rows.join(self.means, "algorithm", "left")
        few = F.coalesce("rows", F.lit(0)) < self.least
        out = lambda c, own: F.pow(F.lit(10.0), F.when(few, F.coalesce(own, c)).otherwise(F.col(c)))
        cols = {"runtime": out("rt", "own_rt"), "runtime_lo": out("rt_lo", "own_rt"), "runtime_hi": out("rt_hi", "own_rt"), "memory": out("mem", "own_mem"), "memory_lo": out("mem_lo", "own_mem"), "memory_hi": out("mem_hi", "own_mem")}
        return rows.select("request", "algorithm", *(c.alias(n) for n, c in cols.items()), F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)).alias("p_complete"))


def probe_sizes(n: int, sigma: float) -> tuple[str, list[int]]:
    """(mode, sizes): three growing samples, the smallest of which keeps an absolute support of 10, or the whole database at once."""
    s1 = max(2500, math.ceil(10 / sigma))
    return ("direct", [n]) if 16 * s1 > n / 2 else ("sampled", [s1, 4 * s1, 16 * s1])


def sample_transactions(baskets: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k transactions (tid, items) by hash order; the same ones for the same seed, so that smaller samples lie within larger ones."""
    return baskets.orderBy(F.xxhash64("tid", F.lit(seed)), "tid").limit(k)


def extrapolate(points: DataFrame, n: str = "n", most: float = 1.2, fixed: float = 13.816) -> DataFrame:
    """(algorithm, affine, loglog, power): cost at size n from the two largest probe points (algorithm, size, value, n).

    affine: a fixed part and a cost per transaction that isn't negative; loglog: slope within [0, most]; power: a fixed part
    of at most `fixed`, the rest grows with an exponent within [0, 1]. Null with fewer than two points.
    """
    w = Window.partitionBy("algorithm").orderBy(F.desc("size"))
    two = points.withColumn("i", F.row_number().over(w)).where("i <= 2")
    g = two.groupBy("algorithm").agg(F.max(n).alias("n"), F.count("*").alias("k"), *(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c[0]}{j}") for i, j in ((1, 2), (2, 1)) for c in ("size", "value"))).where("k = 2 AND s2 > s1")
    s1, s2, v1, v2, at = (F.col(c) for c in ("s1", "s2", "v1", "v2", "n"))
    slope = lambda a, b, top: F.least(F.greatest(F.log(b / a) / F.log(s2 / s1), F.lit(0.0)), F.lit(top))
    base = F.least(F.lit(fixed), v1, v2)
    rest = slope(F.greatest(v1 - base, F.lit(1e-9)), F.greatest(v2 - base, F.lit(1e-9)), 1.0)
    return g.select("algorithm", (v2 + F.greatest((v2 - v1) / (s2 - s1), F.lit(0.0)) * (at - s2)).alias("affine"), (v2 * F.pow(at / s2, slope(v1, v2, most))).alias("loglog"), (base + (v2 - base) * F.pow(at / s2, rest)).alias("power"))


def probe_scale(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by, scale): median log10 of measured over modelled memory; 0 with fewer than two miners."""
    g = measured.where("measured > 0 AND modelled > 0").groupBy(*by).agg(F.count("*").alias("k"), F.percentile(F.log10(F.col("measured") / F.col("modelled")), 0.5).alias("m"))
    return g.select(*by, F.when(F.col("k") >= 2, F.col("m")).otherwise(0.0).alias("scale"))


def budget_notes(max_runtime: float | None, max_memory: float | None) -> tuple[Column, Column]:
    """(over budget, notes): the typical runtime and memory against the budgets, and completion below 0.6."""
    slow = F.col("runtime") > max_runtime if max_runtime else F.lit(False)
    big = F.col("memory") > max_memory if max_memory else F.lit(False)
    return slow | big, F.concat_ws("; ", F.when(slow, "over the time budget"), F.when(big, "over the memory budget"), F.when(F.col("p_complete") < 0.6, "unlikely to complete"))


def scores(candidates: DataFrame, objective: str = "runtime", max_runtime: float | None = None, max_memory: float | None = None) -> DataFrame:
    """candidates with score, expected_cost, over_budget, notes, place and on_front, by request.

    candidates: (request, algorithm, runtime, memory, memory_hi, p_complete) and optionally lagging. Memory enters by its upper
    end; ratios to the request's smallest value are divided by the chance to complete; places go by score, then expected
    cost, then name. A request holds a row per implementation, so its window is small.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    w = Window.partitionBy("request")
    rt = F.col("runtime") / F.min("runtime").over(w)
    mem = F.col("memory_hi") / F.min("memory_hi").over(w)
    over, notes = budget_notes(max_runtime, max_memory)
    base = {"runtime": rt, "memory": mem, "balanced": F.sqrt(rt * mem)}[objective] / F.greatest("p_complete", F.lit(0.01))
    lag = F.coalesce("lagging", F.lit(False)) if "lagging" in candidates.columns else F.lit(False)
    score = base * F.when(over, OVER).otherwise(1.0) * F.when(lag, LAG).otherwise(1.0)
    cost = F.col("p_complete") * F.col("runtime") + (1 - F.col("p_complete")) * 10 * TIMEOUT
    rows = candidates.withColumns({"score": score, "expected_cost": cost, "over_budget": over, "notes": notes})
    # on the front: none as fast is smaller, and none as small is faster
    front = (F.col("memory") <= F.min("memory").over(w.orderBy("runtime"))) & (F.col("runtime") <= F.min("runtime").over(w.orderBy("memory")))
    return rows.withColumn("on_front", front).withColumn("place", F.row_number().over(w.orderBy("score", "expected_cost", "algorithm")))


def tiers(scored: DataFrame, lo: str, hi: str) -> DataFrame:
    """scored with tier: candidates in order of place stay in a tier while their band (lo, hi) meets the band of the tier's first.

    A candidate without a band stays in the tier where it stands. A request's candidates, one per implementation, are folded in one array.
    """
    s = F.array_sort(F.collect_list(F.struct("place", F.col(lo).alias("lo"), F.col(hi).alias("hi"))))
    start = F.struct(F.lit(1).alias("tier"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        bare = x["lo"].isNull() | x["hi"].isNull()
        first = ~bare & a["lo"].isNull()
        apart = ~bare & ~first & ((x["lo"] > a["hi"]) | (x["hi"] < a["lo"]))
        tier = a["tier"] + F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0)
        new = first | F.coalesce(apart, F.lit(False))
        return F.struct(tier.alias("tier"), F.when(new, x["lo"]).otherwise(a["lo"]).alias("lo"), F.when(new, x["hi"]).otherwise(a["hi"]).alias("hi"), F.concat(a["out"], F.array(tier)).alias("out"))

    g = scored.groupBy("request").agg(F.aggregate(s, start, step)["out"].alias("t"))
    return scored.join(g, "request").withColumn("tier", F.get("t", F.col("place") - 1)).drop("t")


def recommend(candidates: DataFrame, objective: str = "runtime", max_runtime: float | None = None, max_memory: float | None = None) -> DataFrame:
    """Scored candidates with tiers by the band of the objective (the balanced one: runtime)."""
    band = "memory" if objective == "memory" else "runtime"
    return tiers(scores(candidates, objective, max_runtime, max_memory), f"{band}_lo", f"{band}_hi")
