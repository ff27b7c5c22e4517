"""Queries of the statistics and of the choice of implementations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import itemsets, profile, recommend, runs, statistics
from .queries_mining import T5
from .queries_runs import BASE, _r, _runs
from .sources import fixtures as fx

Q: dict = {}
S: dict = {}
CFG = "dataset, param_name, param_value"


def _ok(spark, d):
    return _runs(spark, d).where(runs.completed())


Q["spearman"] = lambda spark, d: _r(statistics.spearman(_ok(spark, d), "algorithm", "runtime_s", "peak_memory_mb"))
S["spearman"] = (
    BASE + ", s AS (SELECT algorithm, runtime_s AS a, peak_memory_mb AS b FROM x WHERE ok AND peak_memory_mb IS NOT NULL), k AS (SELECT algorithm, rank() OVER (PARTITION BY algorithm ORDER BY a) + (count(*) OVER (PARTITION BY algorithm, a) - 1) / 2.0 AS ra, "
    "rank() OVER (PARTITION BY algorithm ORDER BY b) + (count(*) OVER (PARTITION BY algorithm, b) - 1) / 2.0 AS rb FROM s) SELECT algorithm, count(*) AS n, round(CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END, 6) AS rho FROM k GROUP BY algorithm"
)


def _pairs(spark, d):
    """Costs of each two algorithms on the configurations that both ran."""
    c = runs.costs(_runs(spark, d))
    b = c.select(*runs.CONFIG, F.col("algorithm").alias("other"), F.col("cost").alias("other_cost"))
    return c.join(b, runs.CONFIG).where("algorithm < other")  # a configuration holds a row per algorithm


_PAIR = ", pr AS (SELECT a.algorithm, b.algorithm AS other, a.cost, b.cost AS other_cost FROM c a JOIN c b USING (dataset, param_name, param_value) WHERE a.algorithm < b.algorithm) "
_WX = _PAIR + (
    ", dd AS (SELECT algorithm, other, cost - other_cost AS d FROM pr WHERE cost <> other_cost), rr AS (SELECT *, rank() OVER (PARTITION BY algorithm, other ORDER BY abs(d)) + (count(*) OVER (PARTITION BY algorithm, other, abs(d)) - 1) / 2.0 AS r FROM dd), "
    "tt AS (SELECT algorithm, other, sum(k * k * k - k) AS ties FROM (SELECT algorithm, other, abs(d) AS v, count(*) AS k FROM dd GROUP BY ALL) GROUP BY ALL), ss AS (SELECT algorithm, other, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM rr GROUP BY ALL), "
    "wx AS (SELECT algorithm, other, n, w_plus, w_minus, CASE WHEN n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0 > 0 THEN (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) END AS z FROM ss JOIN tt USING (algorithm, other)) "
)
Q["wilcoxon"] = lambda spark, d: _r(statistics.wilcoxon(_pairs(spark, d), ["algorithm", "other"], "cost", "other_cost").drop("p"))
S["wilcoxon"] = BASE + _WX + "SELECT algorithm, other, n, round(CAST(w_plus AS DOUBLE), 6) AS w_plus, round(CAST(w_minus AS DOUBLE), 6) AS w_minus, round(z, 6) AS z FROM wx"
Q["holm_adjusted"] = lambda spark, d: _r(statistics.holm(statistics.wilcoxon(_pairs(spark, d), ["algorithm", "other"], "cost", "other_cost").withColumn("p", F.exp(F.col("z"))), ["algorithm", "other"]).drop("p"))
S["holm_adjusted"] = BASE + _WX + (
    ", pz AS (SELECT algorithm, other, exp(z) AS p FROM wx), ho AS (SELECT *, row_number() OVER (ORDER BY p, algorithm, other) AS i, (SELECT count(p) FROM pz) AS m FROM pz WHERE p IS NOT NULL) "
    "SELECT algorithm, other, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, algorithm, other ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM ho"
)
PORTFOLIO = ["Apriori_Gen_Borgelt", "Eclat_Gen_Borgelt", "FPgrowth_Gen_Borgelt", "Gr_growth"]
Q["friedman_nemenyi"] = lambda spark, d: _r(statistics.friedman(runs.costs(_runs(spark, d)).where(F.col("algorithm").isin(*PORTFOLIO)), runs.CONFIG, "algorithm", "cost"))
S["friedman_nemenyi"] = BASE + (
    f", cc AS (SELECT * FROM c WHERE algorithm IN {tuple(PORTFOLIO)}), fu AS (SELECT {CFG} FROM cc GROUP BY {CFG} HAVING count(DISTINCT algorithm) = (SELECT count(DISTINCT algorithm) FROM cc)), "
    f"rk AS (SELECT algorithm, rank() OVER (PARTITION BY {CFG} ORDER BY cost) + (count(*) OVER (PARTITION BY {CFG}, cost) - 1) / 2.0 AS r FROM cc JOIN fu USING ({CFG})), mr AS (SELECT algorithm, avg(r) AS r, count(*) AS n FROM rk GROUP BY algorithm), "
    f"o AS (SELECT max(n) AS blocks, count(*) AS treatments, sum(r * r) AS sq FROM mr) SELECT blocks, treatments, round(12.0 * blocks / (treatments * (treatments + 1)) * (sq - treatments * (treatments + 1) * (treatments + 1) / 4.0), 6) AS chi2, "
    f"round({statistics.NEMENYI_05}[treatments - 1] * sqrt(treatments * (treatments + 1) / (6.0 * blocks)), 6) AS critical_difference FROM o"
)


def _outcomes(spark, d):
    p = _pairs(spark, d)
    return p.select("algorithm", "other", (F.col("cost") < 10 * runs.TIMEOUT).alias("a"), (F.col("other_cost") < 10 * runs.TIMEOUT).alias("b"))


Q["mcnemar"] = lambda spark, d: _r(statistics.mcnemar(_outcomes(spark, d), ["algorithm", "other"], "a", "b"))
S["mcnemar"] = BASE + _PAIR + (
    ", m AS (SELECT algorithm, other, count(*) FILTER (cost < 36000 AND NOT other_cost < 36000) AS only_a, count(*) FILTER (NOT cost < 36000 AND other_cost < 36000) AS only_b FROM pr GROUP BY ALL) "
    "SELECT *, round(CASE WHEN only_a + only_b > 0 THEN greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) END, 6) AS chi2 FROM m"
)
Q["top_items"] = lambda spark, d: _r(profile.top_items(itemsets.as_database(fx.order_brands(spark, d)), 10))
S["top_items"] = f"WITH tx AS ({T5}) SELECT item, count(*) AS support, round(100.0 * count(*) / (SELECT count(DISTINCT tid) FROM tx), 6) AS percent FROM tx GROUP BY item ORDER BY support DESC, item LIMIT 10"
Q["cost_pivot"] = lambda spark, d: _r(runs.costs(_runs(spark, d)).groupBy(*runs.CONFIG).pivot("algorithm", PORTFOLIO).agg(F.min("cost")).dropna())
S["cost_pivot"] = BASE + f"SELECT * FROM (SELECT {CFG}, " + ", ".join(f"round(min(cost) FILTER (algorithm = '{a}'), 6) AS \"{a}\"" for a in PORTFOLIO) + f" FROM c GROUP BY {CFG}) WHERE " + " AND ".join(f'"{a}" IS NOT NULL' for a in PORTFOLIO)
FEATURES = ["configs", "mean_log_count"]
_FEAT = ", ft AS (SELECT dataset, count(*) AS configs, coalesce(avg(log10(generator_count + 1)), 0) AS mean_log_count FROM x WHERE ok GROUP BY dataset)"


def _features(spark, d):
    """Features of a dataset that the run table itself gives."""
    return _ok(spark, d).groupBy("dataset").agg(F.count("*").alias("configs"), F.coalesce(F.avg(F.log10(F.col("generator_count") + 1)), F.lit(0.0)).alias("mean_log_count"))


def _training(spark, d):
    marks = _ok(spark, d).where("param_name = 'minsup'").groupBy("dataset", F.col("param_value").alias("sigma")).agg(F.max("generator_count").alias("most"))
    return recommend.training_rows(_runs(spark, d), _features(spark, d), marks)


Q["training_rows"] = lambda spark, d: _r(_training(spark, d).select("run_id", "algorithm", "dataset", "configs", "mean_log_count", "most"))
S["training_rows"] = BASE + _FEAT + (
    ", mk AS (SELECT dataset, param_value, max(generator_count) AS most FROM x WHERE ok AND param_name = 'minsup' GROUP BY ALL) SELECT run_id, algorithm, x.dataset, configs, round(mean_log_count, 6) AS mean_log_count, most FROM x JOIN ft USING (dataset) "
    "LEFT JOIN mk ON mk.dataset = x.dataset AND mk.param_value = x.param_value AND x.param_name = 'minsup'"
)


def _outside(spark, d):
    """Datasets beyond the range of the datasets that an algorithm has completed on."""
    seen = _ok(spark, d).join(_features(spark, d), "dataset")
    return recommend.outside(_features(spark, d).withColumnRenamed("dataset", "request"), recommend.domains(seen, FEATURES), FEATURES)


Q["domain_check"] = _outside
S["domain_check"] = BASE + _FEAT + (
    ", dm AS (SELECT algorithm, min(configs) AS c0, max(configs) AS c1, min(mean_log_count) AS g0, max(mean_log_count) AS g1 FROM x JOIN ft USING (dataset) WHERE ok GROUP BY algorithm) "
    "SELECT dataset AS request, algorithm, 'configs' AS feature FROM ft, dm WHERE configs < c0 OR configs > c1 UNION ALL SELECT dataset, algorithm, 'mean_log_count' FROM ft, dm WHERE mean_log_count < g0 OR mean_log_count > g1"
)


def _candidates(spark, d):
    """One candidate per dataset and algorithm with what its own runs say."""
    done = runs.completed()
    of = lambda c: F.when(done & F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.01)))
    g = _runs(spark, d).groupBy(F.col("dataset").alias("request"), "algorithm").agg(
        F.exp(F.avg(F.log(of("runtime_s")))).alias("runtime"), F.min(of("runtime_s")).alias("runtime_lo"), F.max(of("runtime_s")).alias("runtime_hi"),
        F.exp(F.avg(F.log(of("peak_memory_mb")))).alias("memory"), F.min(of("peak_memory_mb")).alias("memory_lo"), F.max(of("peak_memory_mb")).alias("memory_hi"), F.avg(done.cast("double")).alias("p_complete"),
    )
    return g.where("runtime IS NOT NULL AND memory IS NOT NULL")


_CAND = (
    ", cd AS (SELECT dataset AS request, algorithm, exp(avg(ln(greatest(runtime_s, 0.01))) FILTER (ok)) AS runtime, exp(avg(ln(greatest(peak_memory_mb, 0.01))) FILTER (ok AND peak_memory_mb IS NOT NULL)) AS memory, max(greatest(peak_memory_mb, 0.01)) FILTER (ok AND peak_memory_mb IS NOT NULL) AS memory_hi, avg(CAST(ok AS DOUBLE)) AS p FROM x GROUP BY ALL), "
    "cn AS (SELECT *, runtime > 5 OR memory > 500 AS over_budget FROM cd WHERE runtime IS NOT NULL AND memory IS NOT NULL), "
    "sc AS (SELECT request, algorithm, runtime, memory, over_budget, sqrt(runtime / min(runtime) OVER w * memory_hi / min(memory_hi) OVER w) / greatest(p, 0.01) * CASE WHEN over_budget THEN 1e6 ELSE 1 END AS score, p * runtime + (1 - p) * 36000 AS expected_cost FROM cn WINDOW w AS (PARTITION BY request)) "
)
Q["recommend_scores"] = lambda spark, d: _r(recommend.scores(_candidates(spark, d), "balanced", 5.0, 500.0).select("request", "algorithm", "over_budget", "expected_cost", "on_front", (F.col("score") / F.max("score").over(recommend.Window.partitionBy("request"))).alias("score_share")))
S["recommend_scores"] = BASE + _CAND + (
    "SELECT request, algorithm, over_budget, round(expected_cost, 6) AS expected_cost, NOT EXISTS (SELECT 1 FROM sc o WHERE o.request = s.request AND o.runtime <= s.runtime AND o.memory <= s.memory AND (o.runtime < s.runtime OR o.memory < s.memory)) AS on_front, round(score / max(score) OVER (PARTITION BY request), 6) AS score_share FROM sc s"
)
Q["recommend"] = lambda spark, d: recommend.recommend(_candidates(spark, d), "balanced", 5.0, 500.0).select("request", "algorithm", "place", "tier", "notes")


def _probe(spark, d):
    """Growth of the memory of each algorithm over its two largest databases by pattern count, read on to twice the largest."""
    p = _ok(spark, d).where("generator_count > 0 AND peak_memory_mb > 0").groupBy("algorithm", F.col("generator_count").alias("size")).agg(F.min("peak_memory_mb").alias("value"))
    return recommend.extrapolate(p.withColumn("n", 2 * F.max("size").over(recommend.Window.partitionBy("algorithm"))))


Q["probe_extrapolation"] = lambda spark, d: _r(_probe(spark, d), 4)
S["probe_extrapolation"] = BASE + (
    ", pt AS (SELECT algorithm, generator_count AS size, min(peak_memory_mb) AS v FROM x WHERE ok AND generator_count > 0 AND peak_memory_mb > 0 GROUP BY ALL), rn AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY size DESC) AS i FROM pt), "
    "tw AS (SELECT a.algorithm, b.size AS s1, a.size AS s2, b.v AS v1, a.v AS v2, 2 * a.size AS n, least(13.816, a.v, b.v) AS f FROM rn a JOIN rn b ON a.algorithm = b.algorithm AND a.i = 1 AND b.i = 2) "
    "SELECT algorithm, round(v2 + greatest((v2 - v1) / (s2 - s1), 0) * (n - s2), 4) AS affine, round(v2 * pow(n / s2, least(greatest(ln(v2 / v1) / ln(s2 / s1), 0), 1.2)), 4) AS loglog, "
    "round(f + (v2 - f) * pow(n / s2, least(greatest(ln(greatest(v2 - f, 1e-9) / greatest(v1 - f, 1e-9)) / ln(s2 / s1), 0), 1)), 4) AS power FROM tw"
)


def _modelled(spark, d):
    """Predictions for every dataset and algorithm by models fitted on all runs."""
    rows = _runs(spark, d).join(_features(spark, d), "dataset").cache()
    cand = rows.select(F.col("dataset").alias("request"), "algorithm", *FEATURES).distinct()
    return recommend.CostModel(rows, FEATURES).predict(cand)


Q["cost_model"] = _modelled
QUERIES, ORACLE = Q, S
