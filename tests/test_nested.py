import json

from latticequarry.operators import nested


def flat(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    return {tuple(r)[:5] for r in nested.flatten_children(nested.canonical_records(df)).collect()}


def test_shapes(spark):
    cost = {"memory_mb": 1, "attempts": [{"seed": 1, "trace": [{"t": 0}, None, {"t": 1}]}, None, {"seed": 2}]}
    want = {("size", "", 0, -1), ("size", "", 2, -1), ("cost", "A", -1, -1), ("attempt", "A", 0, -1), ("attempt", "A", 2, -1), ("trace", "A", 0, 0), ("trace", "A", 0, 2), ("point", "A", 1, -1)}
    rec = {"sizes": [3, None, "4"], "costs": {"A": cost, "B": None}, "points": {"A": [None, [3, [1.5, 2]]], "B": None}}
    as_list = rec | {"costs": [dict(cost, algorithm="A"), None], "points": [{"algorithm": "A", "runs": rec["points"]["A"]}]}
    for line in (json.dumps(rec), "﻿" + json.dumps(as_list), json.dumps({"meta": {}, "probe": rec}), json.dumps(rec | {"costs": json.dumps(rec["costs"])})):
        assert {r[1:] for r in flat(spark, [line])} == want, line


def test_odd_lines(spark):
    lines = [None, "", "  ", '{"sizes": [1', "[1, 2]", '"x"', '{"sizes": 7}', '{"sizes": null, "costs": {}}', '{"costs": {"A": {"memory_mb": NaN}}}', '{"sizes": []}' + " " * 5]
    assert flat(spark, lines) == {(6, "size", "", 0, -1), (8, "cost", "A", -1, -1)}
    assert flat(spark, []) == set()


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, '{"dataset": "d", "n": "x", "points": {"A": [[5, [1.5, 2]], {"size": 6, "memory_mb": 3}]}, "costs": {"A": {"mode": "failed", "memory_lb": 4}}}')], "line_id long, raw_line string")
    rec = nested.canonical_records(df)
    ch = nested.flatten_children(rec)
    assert [tuple(r) for r in nested.point_table(ch).orderBy("pos").collect()] == [(1, "A", 0, 5.0, 1.5, 2.0), (1, "A", 1, 6.0, 3.0, None)]
    assert tuple(nested.cost_table(ch).first()) == (1, "A", "failed", None, None, 4.0, None)
    assert tuple(nested.line_table(rec).first()) == (1, "d", None, None, None, None)
