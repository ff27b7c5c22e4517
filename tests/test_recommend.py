"""Rank tests, probes, scores and tiers against values worked out by hand or by plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from latticequarry.operators import recommend, runs, statistics


def test_rank_tests(spark):
    rows = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 1.0), ("g", 3.0, 9.0), ("g", 3.0, 7.0), ("g", None, 1.0), ("h", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["n"], r["rho"]) for r in statistics.spearman(rows, "k", "x", "y").collect()}
    assert got["g"][0] == 4 and abs(got["g"][1] - 0.737865) < 1e-5 and got["h"] == (1, None)
    w = statistics.wilcoxon(rows.where("x IS NOT NULL"), ["k"], "x", "y").where("k = 'g'").first()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (4, 1.5, 8.5) and 0 < w["p"] < 1
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "t string, p double")
    assert {r["t"]: round(r["adjusted"], 6) for r in statistics.holm(p, ["t"]).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    c = spark.createDataFrame([(i, a, float(v)) for i, x in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (2, 1, 3)]) for a, v in zip("xyz", x)] + [(9, "x", 1.0)], "b int, t string, v double")
    f = statistics.friedman(c, ["b"], "t", "v").first()
    assert (f["blocks"], f["treatments"]) == (4, 3) and abs(f["chi2"] - 4.5) < 1e-9 and abs(f["critical_difference"] - 2.343 * math.sqrt(12 / 24)) < 1e-9
    m = spark.createDataFrame([(1, True, False)] * 5 + [(1, False, True)] + [(2, True, True)], "k int, a boolean, b boolean")
    assert {r["k"]: r["chi2"] for r in statistics.mcnemar(m, ["k"], "a", "b").collect()} == {1: 1.5, 2: None}
    assert statistics.spearman(rows.limit(0), "k", "x", "y").collect() == []


def test_probe(spark):
    assert recommend.probe_sizes(10_000, 0.1) == ("direct", [10_000]) and recommend.probe_sizes(1_000_000, 0.001) == ("sampled", [10_000, 40_000, 160_000])
    pts = spark.createDataFrame([("a", 10, 100.0, 100), ("a", 20, 200.0, 100), ("a", 5, 1.0, 100), ("b", 10, 5.0, 100)], "algorithm string, size long, value double, n long")
    r = recommend.extrapolate(pts).collect()
    assert len(r) == 1 and abs(r[0]["affine"] - 1000) < 1e-6 and abs(r[0]["loglog"] - 1000) < 1e-6 and abs(r[0]["power"] - (13.816 + (200 - 13.816) * 5)) < 1e-6
    m = spark.createDataFrame([("x", 10.0, 1.0), ("x", 1.0, 1.0), ("x", 1000.0, 1.0), ("y", 10.0, 1.0)], "d string, measured double, modelled double")
    assert {r["d"]: round(r["scale"], 6) for r in recommend.probe_scale(m, ["d"]).collect()} == {"x": 1.0, "y": 0.0}
    b = spark.createDataFrame([(i, ["a"]) for i in range(100)], "tid long, items array<string>")
    small, large = ({r["tid"] for r in recommend.sample_transactions(b, k).collect()} for k in (10, 40))
    assert len(small) == 10 and small < large


def test_scores_and_tiers(spark):
    rnd = random.Random(1)
    rows = [(q, f"m{i}", rt := rnd.uniform(1, 20), rt * 0.8, rt * 1.2, mem := rnd.uniform(10, 99), mem * 0.9, mem * 1.1, rnd.choice([1.0, 0.9, 0.5]), i == 3) for q in "ab" for i in range(7)]
    df = spark.createDataFrame(rows, "request string, algorithm string, runtime double, runtime_lo double, runtime_hi double, memory double, memory_lo double, memory_hi double, p_complete double, lagging boolean")
    got = sorted(recommend.recommend(df, "runtime", max_memory=60.0).collect(), key=lambda r: (r["request"], r["place"]))
    for q in "ab":
        mine, mine_in = [r for r in got if r["request"] == q], [r for r in rows if r[0] == q]
        low = min(r[2] for r in mine_in)
        score = {r[1]: r[2] / low / max(r[8], 0.01) * (1e6 if r[5] > 60 else 1) * (1e3 if r[9] else 1) for r in mine_in}
        assert [r["algorithm"] for r in mine] == sorted(score, key=score.get)
        tier, lead, want = 1, None, []
        for r in mine:
            if lead is None:
                lead = r
            elif r["runtime_lo"] > lead["runtime_hi"] or r["runtime_hi"] < lead["runtime_lo"]:
                tier, lead = tier + 1, r
            want.append(tier)
        assert [r["tier"] for r in mine] == want
        front = {r[1] for r in mine_in if not any(o[2] <= r[2] and o[5] <= r[5] and (o[2] < r[2] or o[5] < r[5]) for o in mine_in)}
        assert {r["algorithm"] for r in mine if r["on_front"]} == front
    assert recommend.recommend(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        recommend.scores(df, "speed")


def test_cost_model_learns_and_falls_back(spark):
    rnd = random.Random(2)
    rows = [(f"d{i}", "fast" if i % 2 else "slow", float(x := i % 10), 10 ** (0.2 * x + (0 if i % 2 else 1)), 10.0 * (1 + x) * rnd.uniform(0.95, 1.05), False, None) for i in range(80)] + [("d1", "rare", 1.0, 7.0, 70.0, False, None), ("d2", "rare", 2.0, None, None, True, None)]
    df = spark.createDataFrame(rows, "dataset string, algorithm string, f double, runtime_s double, peak_memory_mb double, timed_out boolean, error string")
    m = recommend.CostModel(df, ["f"])
    ask = spark.createDataFrame([("q", a, 5.0) for a in ("fast", "slow", "rare")], "request string, algorithm string, f double")
    got = {r["algorithm"]: r for r in m.predict(ask).collect()}
    assert 3 < got["slow"]["runtime"] / got["fast"]["runtime"] < 30 and abs(got["rare"]["runtime"] - 7) < 1e-6
    assert all(r["runtime_lo"] <= r["runtime"] * 1.000001 and r["runtime"] <= r["runtime_hi"] * 1.000001 and 0 <= r["p_complete"] <= 1 for r in got.values())
    dom = recommend.domains(df, ["f"])
    far = ask.withColumn("f", F.lit(50.0)).select("request", "f")
    assert {r["algorithm"] for r in recommend.outside(far.distinct(), dom, ["f"]).collect()} == {"fast", "slow", "rare"}
    assert runs.completed() is not None
