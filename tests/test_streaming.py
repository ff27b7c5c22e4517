from latticequarry.operators import itemsets
from latticequarry.streaming import generators as g


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"2025-01-0{d} {h:02d}:00:00", u, e) for d in (1, 2, 3) for u in (1, 2, 3) for h, e in enumerate("abc"[: u + (d == 2) - (u == 3)])]
    df = spark.createDataFrame(rows + [("2025-01-09 00:00:00", 1, "a")], "t string, user_id long, event_type string").selectExpr("cast(t as timestamp) as ts", "user_id", "event_type")
    df.coalesce(1).write.parquet(src)
    events = spark.readStream.schema(df.schema).parquet(src)
    q = g.start(events, str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    q.awaitTermination(120)
    got = {(str(r["window_start"].date()), r["items"], r["support"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = set()
    for d in (1, 2, 3):
        tx = df.where(f"day(ts) = {d}").selectExpr("user_id as tid", "event_type as item")
        for r in itemsets.minimal_generators(itemsets.mine(itemsets.as_database(tx), absolute=1), "never").collect():
            want.add((f"2025-01-0{d}", r["items"], r["support"]))
    assert got == want and want
