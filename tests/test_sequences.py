from latticequarry.operators import sequences


def test_generators_are_not_downward_closed(spark):
    d = spark.createDataFrame([(1, [["a"], ["b"]]), (2, [["a"], ["b"]]), (3, [["b"], ["a"]]), (4, [])], "sid long, sequence array<array<string>>")
    got = {r["pattern"]: r["support"] for r in sequences.sequential_generators(d, 1).collect()}
    assert got == {"a > b": 2, "b > a": 1}
    assert sequences.sequential_generators(d.limit(0), 1).collect() == []


def test_itemsets_and_support(spark):
    d = spark.createDataFrame([(1, [["a", "b"], ["c"]]), (2, [["a"], ["b"], ["c"]])], "sid long, sequence array<array<string>>")
    p = spark.createDataFrame([([["a", "b"]],), ([["a"], ["c"]],), ([["c"], ["a"]],), ([],)], "sequence array<array<string>>")
    got = {r["pattern"]: r["support"] for r in sequences.sequence_support(d, p).collect()}
    assert got == {"a b": 1, "a > c": 2, "c > a": 0, "": 2}
