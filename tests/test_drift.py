import numpy as np
import pandas as pd

from latticequarry.operators import drift

SCHEMA = "feed_id int, file_id int, file_name string, written_at timestamp, line_no int, raw_line string"


def rows(spark, files):
    from datetime import datetime, timedelta

    out = [(1, f, n, datetime(2025, 1, 1) + timedelta(days=k), i, x) for k, (f, n, lines) in enumerate(files) for i, x in enumerate(lines)]
    return spark.createDataFrame(out, SCHEMA)


A = ["run,mem,ok,old", "alpha1,11.5,True,x1", "beta22,22.5,False,x2", "gamma3,33.5,True,x3", "", "# note"]
B = ['run;peak;ok;n', 'alpha1;"~11.5";True;5', "beta22;~22.5;False;6", "gamma3;33.5 MB;True;7"]
C = ['{"run": "alpha1", "peak": 11.5, "ok": "done", "n": null, "costs": {"X": {"rt": 1.25}}}', '{"run": "beta22", "peak": 22.5, "ok": "cut", "n": 6, "costs": {"X": {"rt": 2.25}}}', '{"broken": ']


def test_changes(spark):
    d = rows(spark, [(7, "a.csv", A), (3, "b.csv", B), (5, "c.jsonl", C)])
    got = {tuple(r) for r in drift.changes(d).collect()}
    assert got == {(3, "renamed", "peak", "mem"), (3, "added", "n", ""), (3, "removed", "old", ""), (5, "retyped", "peak", ""), (5, "retyped", "ok", ""), (5, "added", "costs.*.rt", "")}
    assert drift.changes(d.limit(0)).collect() == []
    assert {tuple(r) for r in drift.changes(d.unionAll(d)).collect()} == got


def test_table(spark):
    d = rows(spark, [(7, "a.csv", A), (3, "b.csv", B), (5, "c.jsonl", C)])
    t = drift.consistent_table(d)
    assert {"run", "ok", "n", "rt", "entry_algorithm"} <= {c.removeprefix("costs.*.") for c in t.columns} and t.where("run = 'alpha1'").count() == 3
    name = "mem" if "mem" in t.columns else "peak"
    assert {r[name] for r in t.where("run = 'alpha1'").collect()} == {11.5}


def test_flooding_decides():
    """The seed alone takes (x, q), whose values agree a little more often; flooding brings types and containers to bear."""
    old, new = {"k": "number", "l": "text", "x": "number", "y": "text"}, {"k": "number", "l": "text", "p": "number", "q": "text"}
    rows = [(1, "old", f, None, t, 0, 0) for f, t in old.items()] + [(1, "new", f, None, t, 0, 0) for f, t in new.items()]
    rows += [(1, "pair", "x", "q", None, 5, 8), (1, "pair", "x", "p", None, 5, 8), (1, "pair", "y", "q", None, 5, 8)]
    pdf = pd.DataFrame(rows, columns=["file_id", "side", "a", "b", "type", "agree", "n"])
    seeds = np.zeros((4, 4))
    seeds[0, 0] = seeds[1, 1] = 1
    seeds[2, 2] = seeds[3, 3] = 5 / 8.25
    seeds[2, 3] = 5.1 / 8.25
    score = drift.flood(old, new, seeds, np.eye(4) * (np.arange(4) < 2))
    assert seeds[2].argmax() == 3 and score[2].argmax() == 2
    assert {(r.old_name, r.new_name) for r in drift._select(pdf, drift.ACCEPT).itertuples()} == {("x", "p"), ("y", "q")}
    assert len(drift._select(pdf[pdf["side"] != "pair"], drift.ACCEPT)) == 0


def test_without_flooding_nothing_is_renamed(spark, monkeypatch):
    pdf = pd.DataFrame([(1, "old", "a", None, "number", 0, 0), (1, "new", "b", None, "number", 0, 0), (1, "pair", "a", "b", None, 5, 5)], columns=["file_id", "side", "a", "b", "type", "agree", "n"])
    assert len(drift._select(pdf, drift.ACCEPT)) == 1
    monkeypatch.setattr(drift, "flood", lambda old, new, values, names: np.zeros((len(old), len(new))))
    assert len(drift._select(pdf, drift.ACCEPT)) == 0


def test_short_values_and_fields_side_by_side(spark):
    """Runs of short values are aligned too; a name that stands beside its former name elsewhere isn't united with it."""
    a = ["n,m,o,p,q"] + [f"{i},{i + 30},{i + 60},lane{i},{i + 200}" for i in range(1, 8)]
    b = ["n,m,o,z,q"] + [f"{i},{i + 30},{i + 60},lane{i},{i + 400}" for i in range(1, 8)]
    c = ["n,m,o,z,q,p"] + [f"{i},{i + 30},{i + 60},lane{i},{i + 600},turn{i}" for i in range(1, 8)]
    d = rows(spark, [(1, "a.csv", a), (2, "b.csv", b), (3, "c.csv", c)])
    got = {tuple(r) for r in drift.changes(d).collect()}
    assert got == {(2, "renamed", "z", "p"), (3, "added", "p", "")}
    t = drift.consistent_table(d).where("file_id = 3 AND n = 1").collect()
    assert len(t) == 1 and t[0]["z"] == "lane1" and t[0]["p"] == "turn1"
