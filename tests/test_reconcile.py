from datetime import datetime

from pyspark.sql import functions as F

from latticequarry.operators import reconcile as R

KINDS = {"a": R.NUMBER, "b": R.FLAG, "c": R.TEXT, "t": R.STAMP}


def test_hashes_equal_sparks(spark):
    ks = [0, 1, -1, 5, 2**40, -(2**62)]
    df = spark.createDataFrame([(k, h) for k in ks for h in (0, -7, 2**60)], "key long, h long")
    s = R.Sketch()
    part = s.cells // s.hashes
    got = df.select("key", "h", F.xxhash64("key", "h", F.lit(7)), *(F.pmod(F.xxhash64(F.lit(101 + i), "key", "h"), F.lit(part)) + i * part for i in range(s.hashes))).collect()
    for r in got:
        assert R._check(r[0], r[1]) == r[2] and R._places(r[0], r[1], s) == list(r[3:])


def tables(spark):
    d = datetime
    left = [(1, 1.0, True, "x", "20250101_000000", d(2025, 1, 1)), (2, 2.0, None, "", None, d(2025, 1, 1)), (3, 3.0, False, "z", None, d(2025, 1, 1)), (3, 4.0, False, "z", None, d(2025, 1, 2)), (None, 9.0, None, None, None, None), (5, float("nan"), True, "q", None, None)]
    right = [(1, " 1.0e0", "T", "x ", d(2025, 1, 1), d(2025, 2, 1)), (2, "2.0000000001", "", None, None, d(2025, 2, 1)), (3, "3", "0", "z", None, d(2025, 2, 1)), (4, "4", "0", "z", None, None), (5, "", "no", "q", None, d(2025, 1, 1))]
    a = spark.createDataFrame(left, "id long, a double, b boolean, c string, t string, at timestamp")
    b = spark.createDataFrame(right, "id long, a string, b string, c string, t timestamp, at timestamp")
    return a, b


def test_differences(spark):
    a, b = tables(spark)
    for sketch in (R.Sketch(), R.Sketch(keys_per_bucket=100, cells=3)):  # the second can't be peeled: compared row by row
        got = {tuple(r)[:3] for r in R.differences(a, b, "id", KINDS, "at", ("left", "right"), sketch).collect()}
        assert got == {(3, "differs", "a"), (4, "right", ""), (5, "differs", "b")}, sketch
    got = {tuple(r)[:3] for r in R.differences(a.unionAll(a), b, "id", KINDS, "at", ("left", "right")).collect()}
    assert len(got) == 3
    assert {tuple(r)[1] for r in R.differences(a, b.limit(0), "id", KINDS, "at", ("left", "right")).collect()} == {"left"}
    assert R.differences(a.limit(0), b.limit(0), "id", KINDS, "at", ("left", "right")).collect() == []


def test_peeling_reveals_many_keys(spark):
    base = spark.range(3000).select(F.col("id"), F.col("id").cast("double").alias("a"), F.lit("2025").cast("timestamp").alias("at"))
    other = base.withColumn("a", F.when(F.col("id") % 37 == 0, F.col("a") + 1).otherwise(F.col("a"))).where("id % 41 <> 0")
    got = {(r[0], r[1]) for r in R.differences(base, other, "id", {"a": R.NUMBER}, "at", ("left", "right")).collect()}
    assert got == {(i, "left") for i in range(0, 3000, 41)} | {(i, "differs") for i in range(0, 3000, 37) if i % 41}
