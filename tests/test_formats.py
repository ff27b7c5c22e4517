import pytest

from latticequarry.sources import formats as f


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_transactions_sequences_utilities(spark, tmp_path):
    t = f.parse_transactions(f.text_lines(spark, put(tmp_path, "t", "# c\n1 2 2\n\n@x\n3 1")))
    assert sorted(r["item"] for r in t.collect()) == ["1", "1", "2", "3"]
    s = f.parse_sequences(f.text_lines(spark, put(tmp_path, "s", "<1> 3 1 -1 2 -1 -2\n4 -1 -2"))).collect()
    assert [r["sequence"] for r in s] == [[["1", "3"], ["2"]], [["4"]]]
    u = f.parse_utilities(f.text_lines(spark, put(tmp_path, "u", "1 2 1: 9 :3 4 2\n1 2:3:1"))).collect()
    assert {(r["item"], r["util"]) for r in u} == {("1", 5), ("2", 4)}


def test_sniff_and_csv(spark, tmp_path):
    assert f.sniff(["1 2", "3"]) == "transactional" and f.sniff(["1 -1 2 -1 -2"]) == "sequential" and f.sniff(["1:2:2"]) == "utility"
    basket = put(tmp_path, "b.csv", "\n".join(["milk;bread;tea", "eggs;milk"] * 6))
    assert f.read_csv(spark, basket).count() == 30
    long = put(tmp_path, "l.csv", "order_id,product\n" + "\n".join(f"{i // 2},p{i % 3}" for i in range(40)))
    assert f.read_csv(spark, long).select("tid").distinct().count() == 20
    hot = put(tmp_path, "h.csv", "a,b\n" + "1,0\nyes,x\n" * 6)
    assert {r["item"] for r in f.read_csv(spark, hot).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        f.read_csv(spark, put(tmp_path, "few.csv", "a,b\nc,d"))


def test_patterns_round_trip_and_append(spark, tmp_path):
    p = spark.createDataFrame([("", 0, 9), ("a|b", 2, 3)], "items string, size int, support long")
    for style in ("counted", "spmf"):
        back = f.parse_patterns(f.pattern_lines(p, style), style)
        assert {tuple(r) for r in back.collect()} == {("", 0, 9), ("a|b", 2, 3)}, style
    tag = f.parse_patterns(spark.createDataFrame([("2 1 #SUP: 4 #IS_GENERATOR: true",)], "value string"), "pascal").first()
    assert tuple(tag) == ("1|2", 2, 4, True)
    path = str(tmp_path / "out")
    assert f.append_missing(p, path, ["items"]) == 2 and f.append_missing(p, path, ["items"]) == 0
    assert spark.read.parquet(path).count() == 2


def test_synthetic_is_deterministic(spark):
    a = {tuple(r) for r in f.synthetic_transactions(spark, 50, 20, 4.0, partitions=2).collect()}
    assert a == {tuple(r) for r in f.synthetic_transactions(spark, 50, 20, 4.0, partitions=5).collect()} and len({t for t, _ in a}) == 50
