"""Queries against their SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from latticequarry import queries_core, queries_problems

SAMPLE = ["minimal_generators", "minimal_generators_round", "pascal_tagged", "generator_closure_pairs", "exact_rules", "disjunction_free", "kfree_3", "positive_border", "negative_border", "recover_frequent", "high_utility_generators", "ghui", "utility_minimal", "sequential_generators",
          "windowed_generators_sliding", "audit_generators", "meta_features", "landmarks_sigma_grid", "sigma_for_pairs", "par10_vbs_sbs", "marginal_contribution", "geo_regret", "conformal_interval", "km_restricted_mean", "pareto_front", "semantic_error_rate", "threshold_sides", "onehot_to_tx", "p4_found"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as from '{sf}/{f}'")
    return c


def norm(rows, cols):
    o = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(float(r[i]), 6)) if isinstance(r[i], float) or type(r[i]).__name__ == "Decimal" else repr(r[i]) for i in o) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, duck, name):
    q, s = {**queries_core.QUERIES, **queries_problems.QUERIES}[name], {**queries_core.ORACLE, **queries_problems.ORACLE}[name]
    df = q(spark, sf)
    cur = duck.execute(s)
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), cols)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
