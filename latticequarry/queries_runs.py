"""Run-table and recommendation queries with their SQL, over the published run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import itemsets, runs
from .plans import capabilities as cap
from .plans.conventions import threshold_column
from .session import load
from .sources import fixtures as fx
from .sources import formats

Q: dict = {}
S: dict = {}

_COLS = "algorithm, dataset, param_name, param_value, runtime_s, peak_memory_mb, generator_count, timed_out, error, runtime_s_recorded"
BASE = (
    f"WITH r AS (SELECT run_id, {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC) AS rn FROM published_linux_rerun) WHERE rn = 1), "
    "x AS (SELECT *, (NOT coalesce(timed_out, false) AND coalesce(error, '') = '' AND runtime_s IS NOT NULL) AS ok FROM r), "
    "c AS (SELECT dataset, param_name, param_value, algorithm, min(CASE WHEN ok THEN runtime_s ELSE 36000.0 END) AS cost FROM x GROUP BY ALL), "
    "b AS (SELECT dataset, param_name, param_value, min(cost) AS best, arg_min(algorithm, (cost, algorithm)) AS winner, list_sort(list(cost))[2] AS second, count(*) AS n FROM c GROUP BY ALL), "
    "j AS (SELECT c.*, b.best, b.winner FROM c JOIN b USING (dataset, param_name, param_value)), "
    "pf AS (SELECT algorithm, count(*) AS configs, avg(cost) AS mean_par10, exp(avg(ln(greatest(cost, 0.001) / greatest(best, 0.001)))) AS geo_ratio, CAST(sum(CASE WHEN algorithm = winner THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM j GROUP BY algorithm) "
)


def _runs(spark, d):
    return runs.latest_runs(load(spark, d, "published_linux_rerun").select("run_id", "loaded_at", *[c.strip() for c in _COLS.split(",")]))


def _r(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _round(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols.split())


Q["runs_latest"] = lambda spark, d: _runs(spark, d)
S["runs_latest"] = BASE + f"SELECT run_id, {_COLS} FROM r"
Q["failure_class"] = lambda spark, d: _runs(spark, d).groupBy("algorithm", runs.failure_class().alias("failure")).agg(F.count("*").alias("n"))
S["failure_class"] = (
    BASE + "SELECT algorithm, CASE WHEN coalesce(timed_out, false) THEN 'timeout' WHEN coalesce(error, '') = '' THEN CASE WHEN runtime_s IS NULL THEN 'no runtime' ELSE 'ok' END WHEN regexp_matches(lower(error), 'out of ?memory|killed by limit|exit code 137') THEN 'memory' "
    "WHEN regexp_matches(lower(error), 'stack ?overflow') THEN 'stack' WHEN regexp_matches(lower(error), 'segmentation|exit code') THEN 'native' WHEN regexp_matches(lower(error), 'no output') THEN 'output' ELSE 'error' END AS failure, count(*) AS n FROM r GROUP BY ALL"
)
Q["algo_summary"] = lambda spark, d: _r(runs.algorithm_summary(_runs(spark, d)))
S["algo_summary"] = (
    BASE + "SELECT algorithm, count(*) AS n_total, count(*) FILTER (ok) AS n_ok, count(*) FILTER (coalesce(timed_out, false)) AS n_dnf, count(*) FILTER (NOT ok AND NOT coalesce(timed_out, false)) AS n_crash, round(avg(runtime_s) FILTER (ok), 6) AS mean_runtime, round(min(runtime_s) FILTER (ok), 6) AS min_runtime, "
    "round(max(runtime_s) FILTER (ok), 6) AS max_runtime, round(avg(peak_memory_mb) FILTER (ok), 6) AS mean_memory, round(avg(generator_count) FILTER (ok), 6) AS mean_count FROM x GROUP BY algorithm"
)
PIVOT = ["Apriori_Gen_Borgelt", "Eclat_Gen_Borgelt", "FPgrowth_Gen_Borgelt"]
Q["memory_pivot"] = lambda spark, d: _r(runs.memory_pivot(_runs(spark, d), PIVOT))
S["memory_pivot"] = BASE + "SELECT * FROM (SELECT dataset, " + ", ".join(f"round(avg(peak_memory_mb) FILTER (algorithm = '{a}'), 6) AS \"{a}\"" for a in PIVOT) + " FROM x WHERE ok GROUP BY dataset) WHERE " + " AND ".join(f'"{a}" IS NOT NULL' for a in PIVOT)
Q["par10_vbs_sbs"] = lambda spark, d: _r(runs.portfolio(_runs(spark, d)))
S["par10_vbs_sbs"] = BASE + f"SELECT algorithm, configs, {_round('mean_par10 geo_ratio')}, wins FROM pf"
Q["marginal_contribution"] = lambda spark, d: _r(runs.marginal_contribution(_runs(spark, d)))
S["marginal_contribution"] = BASE + "SELECT winner AS algorithm, count(*) AS wins, round(sum(coalesce(second, 36000.0) - best), 6) AS contribution, round(sum(coalesce(second, 36000.0) - best) / sum(sum(coalesce(second, 36000.0) - best)) OVER (), 6) AS share FROM b GROUP BY winner"
Q["npar10"] = lambda spark, d: _r(runs.normalised_par10(_runs(spark, d)))
S["npar10"] = BASE + ", v AS (SELECT avg(best) AS vbs FROM b), s AS (SELECT mean_par10 AS sbs FROM pf ORDER BY configs DESC, mean_par10 LIMIT 1) SELECT algorithm, round(CASE WHEN abs(sbs - vbs) > 1e-12 THEN (mean_par10 - vbs) / (sbs - vbs) END, 6) AS npar10 FROM pf, v, s"
for _name, _col in (("geo_regret", "runtime_s"), ("geo_regret_memory", "peak_memory_mb")):
    Q[_name] = lambda spark, d, col=_col: _r(runs.regret(_runs(spark, d), col))
    S[_name] = (
        BASE + f", v AS (SELECT dataset, param_name, param_value, algorithm, min(greatest({_col}, 0.01)) FILTER (ok) AS v FROM x GROUP BY ALL), w AS (SELECT dataset, param_name, param_value, min(v) AS best FROM v GROUP BY ALL HAVING count(*) >= 2 AND min(v) IS NOT NULL) "
        "SELECT algorithm, count(*) AS instances, round(exp(avg(ln(coalesce(v / best, 10.0)))), 6) AS geo_regret FROM v JOIN w USING (dataset, param_name, param_value) GROUP BY algorithm"
    )
Q["excess_memory"] = lambda spark, d: _r(runs.excess_memory(_runs(spark, d)))
S["excess_memory"] = (
    BASE + ", m AS (SELECT dataset, param_name, param_value, algorithm, min(peak_memory_mb) AS m FROM x WHERE ok AND peak_memory_mb IS NOT NULL GROUP BY ALL), w AS (SELECT dataset, param_name, param_value, min(m) AS best FROM m GROUP BY ALL) "
    "SELECT algorithm, round(quantile_cont(m - best, 0.5), 6) AS median_excess, round(avg(CASE WHEN m - best > 10 THEN 1.0 ELSE 0.0 END), 6) AS over_10 FROM m JOIN w USING (dataset, param_name, param_value) GROUP BY algorithm"
)
Q["design_effect"] = lambda spark, d: _r(runs.design_effect(_runs(spark, d)))
S["design_effect"] = (
    BASE + ", l AS (SELECT dataset, log10(runtime_s) AS v FROM x WHERE ok AND runtime_s > 0), g AS (SELECT dataset, count(*) AS k, avg(v) AS m, var_pop(v) AS w FROM l GROUP BY dataset), o AS (SELECT sum(k) AS n, count(*) AS groups, sum(k * m) / sum(k) AS mean, sum(k * m * m) / sum(k) AS msq, sum(k * w) / sum(k) AS within FROM g), "
    "i AS (SELECT *, (msq - mean * mean) / (msq - mean * mean + within) AS icc FROM o) SELECT CAST(n AS BIGINT) AS n, groups, round(icc, 6) AS icc, round(n / (1 + (n / groups - 1) * icc), 6) AS n_eff FROM i"
)
_RES = ", e AS (SELECT algorithm, dataset, log10(greatest(runtime_s, 0.01) / greatest(runtime_s_recorded, 0.01)) AS r FROM x WHERE ok AND runtime_s_recorded IS NOT NULL)"


def _residuals(spark, d):
    x = _runs(spark, d).where(runs.completed() & F.col("runtime_s_recorded").isNotNull())
    return x.select("algorithm", "dataset", F.log10(F.greatest("runtime_s", F.lit(0.01)) / F.greatest("runtime_s_recorded", F.lit(0.01))).alias("r"))


Q["conformal_interval"] = lambda spark, d: _r(runs.conformal_interval(_residuals(spark, d), "dataset", "algorithm"))
S["conformal_interval"] = (
    BASE + _RES + ", k AS (SELECT algorithm, count(DISTINCT dataset) AS k, list_sort(list(r)) AS s FROM e GROUP BY algorithm), p AS (SELECT algorithm, k, s, 0.05 * k / (k + 1) * (len(s) - 1) AS lo, (1 - 0.05 * k / (k + 1)) * (len(s) - 1) AS hi FROM k) "
    "SELECT algorithm, k, round(s[CAST(floor(lo) AS INT) + 1] + (lo - floor(lo)) * (coalesce(s[CAST(floor(lo) AS INT) + 2], s[CAST(floor(lo) AS INT) + 1]) - s[CAST(floor(lo) AS INT) + 1]), 6) AS lo, "
    "round(s[CAST(floor(hi) AS INT) + 1] + (hi - floor(hi)) * (coalesce(s[CAST(floor(hi) AS INT) + 2], s[CAST(floor(hi) AS INT) + 1]) - s[CAST(floor(hi) AS INT) + 1]), 6) AS hi FROM p"
)
Q["cdf_pool_interval"] = lambda spark, d: _r(runs.pooled_interval(_residuals(spark, d), "dataset", "algorithm"))
_POOL = (
    ", w AS (SELECT algorithm, r, sum(1.0 / n) AS w FROM (SELECT *, count(*) OVER (PARTITION BY algorithm, dataset) AS n FROM e) GROUP BY algorithm, r), q AS (SELECT algorithm, r, sum(w) OVER (PARTITION BY algorithm ORDER BY r) AS c, sum(w) OVER (PARTITION BY algorithm) AS t FROM w), "
    "iv AS (SELECT algorithm, min(r) FILTER (c >= 0.05 * t - 1e-9) AS lo, min(r) FILTER (c >= 0.95 * t - 1e-9) AS hi FROM q GROUP BY algorithm) "
)
S["cdf_pool_interval"] = BASE + _RES + _POOL + f"SELECT algorithm, {_round('lo hi')} FROM iv"
Q["interval_coverage"] = lambda spark, d: _r(runs.coverage(_residuals(spark, d), runs.pooled_interval(_residuals(spark, d), "dataset", "algorithm"), "dataset", "algorithm"))
S["interval_coverage"] = BASE + _RES + _POOL + "SELECT algorithm, round(avg(c), 6) AS coverage FROM (SELECT algorithm, dataset, avg(CASE WHEN r BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS c FROM e JOIN iv USING (algorithm) GROUP BY ALL) GROUP BY algorithm"
Q["count_agreement"] = lambda spark, d: runs.count_agreement(_runs(spark, d), ["Gr_growth"])
S["count_agreement"] = BASE + "SELECT dataset, param_name, param_value, count(DISTINCT algorithm) AS algorithms, count(DISTINCT generator_count - CASE WHEN algorithm = 'Gr_growth' THEN 1 ELSE 0 END) AS counts FROM x WHERE ok AND generator_count IS NOT NULL GROUP BY ALL"


def _points(spark, d):
    s = runs.algorithm_summary(_runs(spark, d))
    return s.select("algorithm", F.round("mean_runtime", 6).alias("mean_runtime"), F.round("mean_memory", 6).alias("mean_memory"))


_PTS = BASE + ", pt AS (SELECT algorithm, round(avg(runtime_s), 6) AS mean_runtime, round(avg(peak_memory_mb), 6) AS mean_memory FROM x WHERE ok GROUP BY algorithm) "
Q["pareto_front"] = lambda spark, d: runs.pareto_front(_points(spark, d), "mean_runtime", "mean_memory")
S["pareto_front"] = _PTS + "SELECT * FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt q WHERE q.mean_runtime <= p.mean_runtime AND q.mean_memory <= p.mean_memory AND (q.mean_runtime < p.mean_runtime OR q.mean_memory < p.mean_memory))"
Q["best_pick"] = lambda spark, d: runs.best_and_second(runs.costs(_runs(spark, d))).select(*runs.CONFIG, "winner", "best")
S["best_pick"] = BASE + "SELECT dataset, param_name, param_value, winner, best FROM b"
Q["mean_ranks"] = lambda spark, d: _r(runs.mean_ranks(_runs(spark, d)))
S["mean_ranks"] = BASE + "SELECT algorithm, round(avg(lo + (k - 1) / 2.0), 6) AS mean_rank FROM (SELECT algorithm, rank() OVER (PARTITION BY dataset, param_name, param_value ORDER BY cost) AS lo, count(*) OVER (PARTITION BY dataset, param_name, param_value, cost) AS k FROM c) GROUP BY algorithm"
Q["km_restricted_mean"] = lambda spark, d: _r(runs.restricted_mean(runs.kaplan_meier(_runs(spark, d))), 4)
S["km_restricted_mean"] = (
    BASE + ", e AS (SELECT algorithm, CASE WHEN ok THEN least(runtime_s, 3600.0) ELSE 3600.0 END AS t, CAST(ok AS INT) AS d FROM x), h AS (SELECT algorithm, t, sum(d) AS d, count(*) AS k FROM e GROUP BY ALL), "
    "a AS (SELECT *, sum(k) OVER (PARTITION BY algorithm ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM h), "
    "s AS (SELECT algorithm, t, exp(sum(CASE WHEN d >= risk THEN -700.0 ELSE ln(1 - d / risk) END) OVER (PARTITION BY algorithm ORDER BY t)) AS s, coalesce(lead(t) OVER (PARTITION BY algorithm ORDER BY t), 3600.0) AS nx FROM a WHERE d > 0), "
    "z AS (SELECT algorithm, min(t) + sum(s * (nx - t)) AS rmst, min(s) AS s_end, coalesce(min(t) FILTER (s <= 0.5), 3600.0) AS median FROM s GROUP BY algorithm) SELECT algorithm, round(rmst, 4) AS rmst, round(s_end, 4) AS s_end, round(rmst + 32400.0 * s_end, 4) AS e_par10, round(median, 4) AS median FROM z"
)


def _knn(spark, d):
    x = _runs(spark, d).where(runs.completed() & (F.col("runtime_s") > 0) & (F.col("peak_memory_mb") > 0))
    f = [F.avg(F.log10("runtime_s")).alias("rt"), F.avg(F.log10("peak_memory_mb")).alias("mem")]
    return _r(runs.nearest(x.groupBy(F.col("dataset").alias("point")).agg(*f), x.groupBy(F.col("algorithm").alias("query")).agg(*f), ["rt", "mem"], 16), 5)


Q["knn_sunny"] = _knn
S["knn_sunny"] = (
    BASE + ", l AS (SELECT * FROM x WHERE ok AND runtime_s > 0 AND peak_memory_mb > 0), p AS (SELECT dataset AS point, avg(log10(runtime_s)) AS rt, avg(log10(peak_memory_mb)) AS mem FROM l GROUP BY 1), q AS (SELECT algorithm AS query, avg(log10(runtime_s)) AS rt, avg(log10(peak_memory_mb)) AS mem FROM l GROUP BY 1), "
    "s AS (SELECT greatest(stddev_pop(rt), 1e-12) AS srt, greatest(stddev_pop(mem), 1e-12) AS smem FROM p), n AS (SELECT query, point, sqrt(((p.rt - q.rt) / srt) ** 2 + ((p.mem - q.mem) / smem) ** 2) AS distance FROM p, q, s) "
    "SELECT query, point, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, point) AS rn FROM n) WHERE rn <= 16"
)
Q["resume_missing_runs"] = lambda spark, d: _runs(spark, d).select("run_id").join(load(spark, d, "published_linux_copy"), "run_id", "left_anti")
S["resume_missing_runs"] = BASE + "SELECT run_id FROM r WHERE run_id NOT IN (SELECT run_id FROM published_linux_copy)"
Q["bootstrap_regret"] = lambda spark, d: runs.bootstrap_means(_residuals(spark, d), "dataset", "r")
Q["capability_filter"] = lambda spark, d: cap.all_requests(spark)
_IMPL = "impl(algorithm, input_type, emits, boundary, empty_rule, sound) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{s}', '{e}', {str(ok).lower()})" for a, b, c, s, e, ok in cap.IMPLEMENTATIONS) + ")"
_SAT = "sat(emits, requested, how) AS (VALUES " + ", ".join(str(x) for x in cap.SATISFIES) + ")"
S["capability_filter"] = f"WITH {_IMPL}, {_SAT} SELECT requested AS family, algorithm, how FROM impl JOIN sat USING (emits) WHERE sound"


def _semantic(spark, d):
    """Share of configurations whose cheapest implementation violates a request, by threshold side and empty-set demand."""
    c = runs.costs(_runs(spark, d)).join(F.broadcast(cap.implementations(spark)), "algorithm")  # 17 rows
    profiles = spark.createDataFrame([("ceil", True), ("ceil", False), ("round", True), ("floor", True), ("round", False)], "side string, want_empty boolean")
    pick = c.groupBy(*runs.CONFIG).agg(F.min_by(F.struct("boundary", "empty_rule", "sound"), F.struct("cost", "algorithm")).alias("p"))
    j = pick.crossJoin(F.broadcast(profiles))  # 5 rows
    bad = (F.col("p.boundary") != F.col("side")) | (F.col("want_empty") & (F.col("p.empty_rule") == "never")) | (~F.col("want_empty") & (F.col("p.empty_rule") == "always")) | ~F.col("p.sound")
    return j.groupBy("side", "want_empty").agg(F.count("*").alias("queries"), F.sum(bad.cast("int")).alias("violations"))


Q["semantic_error_rate"] = _semantic
S["semantic_error_rate"] = (
    BASE + f", {_IMPL}, pr(side, want_empty) AS (VALUES ('ceil', true), ('ceil', false), ('round', true), ('floor', true), ('round', false)), pk AS (SELECT dataset, param_name, param_value, arg_min(algorithm, (cost, algorithm)) AS algorithm FROM c JOIN impl USING (algorithm) GROUP BY ALL) "
    "SELECT side, want_empty, count(*) AS queries, CAST(sum(CASE WHEN boundary <> side OR (want_empty AND empty_rule = 'never') OR (NOT want_empty AND empty_rule = 'always') OR NOT sound THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM pk JOIN impl USING (algorithm), pr GROUP BY ALL"
)

# ------------------------------------------------------------------ conventions and formats


def _sides(spark, d):
    n = itemsets.sizes(itemsets.as_database(fx.customers(spark, d)))
    rows = [n.select(F.lit(s).alias("sigma"), F.lit(side).alias("side"), threshold_column(s, F.col("n"), side).alias("m")) for s in ("0.0053", "0.01", "0.25", "0.001") for side in ("floor", "ceil", "round")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def _sides_sql() -> str:
    from .queries_mining import T1, m_sql

    parts = [f"SELECT '{s}' AS sigma, '{side}' AS side, CAST({m_sql(s, side)} AS BIGINT) AS m" for s in ("0.0053", "0.01", "0.25", "0.001") for side in ("floor", "ceil", "round")]
    return f"WITH tx AS ({T1}) " + " UNION ALL ".join(parts)


Q["threshold_sides"] = _sides
S["threshold_sides"] = _sides_sql()
Q["flatten_sequences"] = lambda spark, d: formats.flatten_sequences(fx.event_sequences(spark, d))
S["flatten_sequences"] = "SELECT DISTINCT user_id * 100000 + datediff('day', DATE '1970-01-01', CAST(ts AT TIME ZONE 'UTC' AS DATE)) AS tid, event_type AS item FROM events"


def _onehot(spark, d):
    wide = fx.order_types(spark, d).groupBy("tid").agg(*(F.max(F.when(F.col("item") == v, "x")).alias(v) for v in ("ECONOMY", "PROMO", "STANDARD"))).drop("tid")
    return formats.onehot_items(wide).groupBy("item").agg(F.count("*").alias("support"))


Q["onehot_to_tx"] = _onehot
S["onehot_to_tx"] = "SELECT item, count(*) AS support FROM (SELECT DISTINCT l_orderkey, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE item IN ('ECONOMY', 'PROMO', 'STANDARD') GROUP BY item"
Q["tx_from_equal_frequency"] = lambda spark, d: formats.equal_frequency_items(load(spark, d, "part"), "p_partkey", ["p_brand", "p_size", "p_retailprice"])
S["tx_from_equal_frequency"] = (
    "WITH e AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS q, quantile_cont(p_size, [0.2, 0.4, 0.6, 0.8]) AS z FROM part) SELECT DISTINCT p_partkey AS tid, unnest(['p_brand=' || p_brand, 'p_size=q' || len(list_filter(list_distinct(z), lambda x: p_size > x)), "
    "'p_retailprice=q' || len(list_filter(list_distinct(q), lambda x: p_retailprice > x))]) AS item FROM part, e"
)
Q["synthetic_transactions"] = lambda spark, d: formats.synthetic_transactions(spark, 2000, 60, 6.0)
Q["pattern_lines"] = lambda spark, d: formats.pattern_lines(itemsets.minimal_generators(itemsets.mine(itemsets.as_database(fx.customers(spark, d)), "0.02")))
QUERIES, ORACLE = Q, S
