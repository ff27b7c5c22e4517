"""Micro databases with answers worked out by hand, and random ones against the definitions."""

import random
from itertools import combinations

import pytest

from latticequarry.operators import audit, itemsets, utility
from latticequarry.plans.conventions import absolute_threshold, emits_empty


def db(spark, rows):
    return itemsets.as_database(spark.createDataFrame([(t, i) for t, x in enumerate(rows) for i in x], "tid long, item string"))


def as_dict(df, key="items", value="support"):
    return {r[key]: r[value] for r in df.collect()}


def test_generators_closures_and_borders(spark):
    m = itemsets.mine(db(spark, ["ab", "ab", "abc", "c"]), absolute=1, closures=True)
    assert as_dict(itemsets.minimal_generators(m)) == {"": 4, "a": 3, "b": 3, "c": 2, "a|c": 1, "b|c": 1}
    pairs = as_dict(itemsets.generator_closures(m), "generator", "closure")
    assert pairs == {"": "", "a": "a|b", "b": "a|b", "c": "c", "a|c": "a|b|c", "b|c": "a|b|c"}
    assert as_dict(itemsets.closed_itemsets(m)) == {"": 4, "a|b": 3, "c": 2, "a|b|c": 1}
    assert as_dict(itemsets.exact_rules(m), "antecedent", "consequent") == {"a": "b", "b": "a", "a|c": "b", "b|c": "a"}
    assert [(r["items"], r["redundant_item"]) for r in itemsets.positive_border(m).collect()] == [("a|b", "a")]
    rare = itemsets.minimal_rare(itemsets.mine(db(spark, ["ab", "ab", "abc", "c"]), absolute=2))
    assert as_dict(rare) == {"a|c": 1, "b|c": 1}


def test_full_support_item(spark):
    m = itemsets.mine(db(spark, ["ax", "bx", "x"]), absolute=1, closures=True)
    assert as_dict(itemsets.minimal_generators(m)) == {"": 3, "a": 1, "b": 1}
    assert as_dict(itemsets.generator_closures(m), "generator", "closure") == {"": "x", "a": "a|x", "b": "b|x"}
    assert as_dict(itemsets.positive_border(m)) == {"x": 3}
    assert as_dict(itemsets.negative_border(m)) == {"a|b": 0}
    assert [r["item"] for r in itemsets.cover_items(m).collect()] == ["x"]
    assert "" not in as_dict(itemsets.minimal_generators(m, "no_full_support_item"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_databases_follow_the_definitions(spark, seed):
    rnd = random.Random(seed)
    rows = ["".join(x for x in "abcde" if rnd.random() < 0.6) for _ in range(9)]
    rows = [r for r in rows if r]
    n, m = len(rows), 2
    sup = {c: sum(set(c) <= set(r) for r in rows) for k in range(6) for c in combinations("abcde", k)}
    subs = lambda c: [c[:i] + c[i + 1 :] for i in range(len(c))]
    gens = {c for c in sup if sup[c] >= m and all(sup[s] > sup[c] for s in subs(c))} | {()}
    freq = {c: s for c, s in sup.items() if s >= m and c}
    text = lambda d: {"|".join(c): s for c, s in d.items()}
    run = itemsets.mine(db(spark, rows), absolute=m)
    assert as_dict(itemsets.minimal_generators(run)) == text({c: sup[c] for c in gens})
    assert as_dict(itemsets.recover_frequent(run)) == text(freq)
    assert as_dict(itemsets.recover_frequent_positive(run)) == text(freq)
    ask = spark.createDataFrame([(0, "|".join(c)) for c in sup] + [(0, "a|zz")], "g long, items string")
    assert as_dict(itemsets.lookup_support(run, ask)) == {**text({c: s if s >= m else None for c, s in sup.items()}), "a|zz": None}
    assert as_dict(itemsets.itemset_support(db(spark, rows), ask)) == {**text(sup), "a|zz": 0}
    close = {c: "|".join(i for i in "abcde" if all(i in r for r in rows if set(c) <= set(r))) for c in gens}
    assert as_dict(itemsets.generator_closures(itemsets.mine(db(spark, rows), absolute=m, closures=True)), "generator", "closure") == text(close)
    assert as_dict(itemsets.frequent_itemsets(itemsets.mine(db(spark, rows), absolute=m, generators=False))) == text(freq)
    neg = {c: sup[c] for c in sup if c and sup[c] < m and all(s in gens for s in subs(c)) and (len(c) > 1 or sup[c] > 0)}
    assert as_dict(itemsets.negative_border(run)) == text(neg)
    pos = {c: sup[c] for c in freq if c not in gens and all(s in gens for s in subs(c))}
    assert as_dict(itemsets.positive_border(run)) == text(pos)

    def delta(x, y):
        mid = [z for k in range(len(y), len(x)) for z in combinations(x, k) if set(y) <= set(z)]
        return sum((-1) ** (len(x) - len(z) + 1) * sup[z] for z in mid)

    for k in (1, 2, 3):
        free = {()}
        for c in sorted(freq, key=len):
            ys = [y for j in range(max(0, len(c) - k), len(c)) for y in combinations(c, j) if y or k >= len(c)]
            if all(s in free for j in range(len(c)) for s in combinations(c, j)) and all(delta(c, y) != sup[c] for y in ys):
                free.add(c)
        assert as_dict(itemsets.k_free(run, k)) == text({c: sup[c] for c in free}), k
    assert n == sup[()]


def test_nulls_empty_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (None, "b", 2), (2, None, 3), (2, "", 4), (3, "a", 5)], "tid long, item string, g int")
    d = itemsets.as_database(rows)
    assert as_dict(itemsets.minimal_generators(itemsets.mine(d, absolute=1))) == {"": 2}
    none = itemsets.mine(itemsets.as_database(rows.limit(0)), absolute=1)
    assert itemsets.minimal_generators(none).collect() == [] and itemsets.negative_border(none).collect() == []


def test_utilities(spark):
    u = utility.utility_database(spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, "b", 2), (2, "a", 1), (2, "c", 9), (3, None, 4)], "tid long, item string, util long"))
    m = utility.mine_utilities(u, 0, closures=True)
    assert as_dict(utility.high_utility_generators(m, 0), value="utility") == {"b": 2, "c": 9}
    assert as_dict(utility.ghui(m, 7), value="closure_utility") == {"b": 7, "c": 10}
    assert as_dict(utility.high_utility_generators(m, 7), value="utility") == {"c": 9}
    f = utility.mine_utilities(u, 7, generators=False)
    assert as_dict(utility.utility_minimal(f, 7), value="utility") == {"c": 9, "a|b": 7}


def test_random_utilities(spark):
    rnd = random.Random(5)
    rows = [{x: rnd.randint(0, 9) for x in "abcdef" if rnd.random() < 0.7} for _ in range(12)]
    rows = [r for r in rows if r]
    u = utility.utility_database(spark.createDataFrame([(t, i, v) for t, r in enumerate(rows) for i, v in r.items()], "tid long, item string, util long"))
    sets = [c for k in range(1, 7) for c in combinations("abcdef", k)]
    cov = {c: [r for r in rows if set(c) <= set(r)] for c in [(), *sets]}
    util = lambda c: sum(r[i] for r in cov[c] for i in c)
    subs = lambda c: [c[:i] + c[i + 1 :] for i in range(len(c))]
    gens = [c for c in sets if cov[c] and all(len(cov[s]) > len(cov[c]) for s in subs(c))]
    close = {c: tuple(i for i in "abcdef" if all(i in r for r in cov[c])) for c in gens}
    theta = sum(sum(r.values()) for r in rows) // 5
    text = lambda d: {"|".join(c): s for c, s in d.items()}
    m = utility.mine_utilities(u, theta, closures=True)
    assert as_dict(utility.high_utility_generators(m, theta), value="utility") == text({c: util(c) for c in gens if util(c) >= theta})
    uc = {c: sum(r[i] for r in cov[c] for i in close[c]) for c in gens}
    assert as_dict(utility.ghui(m, theta), value="closure_utility") == text({c: v for c, v in uc.items() if v >= theta})
    f = utility.mine_utilities(u, theta, generators=False)
    low = {c: util(c) for c in sets if cov[c] and util(c) >= theta and not any(s and util(s) >= theta for s in subs(c))}
    assert as_dict(utility.utility_minimal(f, theta), value="utility") == text(low)
    assert max(map(len, gens)) > 3


def test_thresholds():
    assert [absolute_threshold("0.25", 10, s) for s in ("floor", "ceil", "round")] == [2, 3, 2]
    assert [absolute_threshold("0.25", 14, s) for s in ("floor", "ceil", "round")] == [3, 4, 4]
    assert absolute_threshold(0.1, 340) == 34 and absolute_threshold(0.0001, 3, "floor") == 1
    assert emits_empty("always", True, False) and not emits_empty("never", False, True) and emits_empty("no_full_support_item", False, False) and not emits_empty("some_item_frequent", False, False)
    with pytest.raises(ValueError):
        absolute_threshold(0.1, 10, "up")


def test_audit_and_difference(spark):
    d = db(spark, ["ab", "ab", "abc", "c"])
    truth = itemsets.minimal_generators(itemsets.mine(d, absolute=1), "never").drop("g")
    given = spark.createDataFrame([("a", 3), ("b", 2), ("a|b", 3)], "items string, support long")
    found = {(r["items"], r["finding"]) for r in audit.audit_generators(d, given, truth).collect()}
    assert found == {("b", "bad_support"), ("a|b", "not_minimal"), ("a|b", "extra"), ("c", "missing"), ("a|c", "missing"), ("b|c", "missing")}
    diff = {(r["items"], r["side"]) for r in audit.pattern_set_difference(given, truth).collect()}
    assert ("b", "support") in diff and ("a|b", "only_left") in diff and ("c", "only_right") in diff


def test_all_sizes_by_brute_force(spark):
    baskets = ["abcde", "abcd", "abce", "abde", "acde", "bcde", "abcdf", "f"]
    sup = {c: sum(set(c) <= set(b) for b in baskets) for k in range(1, 7) for c in combinations("abcdef", k)}
    low = {c: [sup[c[:i] + c[i + 1 :]] if len(c) > 1 else len(baskets) for i in range(len(c))] for c in sup}
    gens = {()}
    for c in sorted(sup, key=len):
        if sup[c] >= 1 and all(sup[c] < x for x in low[c]) and all(c[:i] + c[i + 1 :] in gens for i in range(len(c))):
            gens.add(c)
    run = itemsets.mine(db(spark, baskets), absolute=1, max_size=None)
    assert max(map(len, gens)) > 3
    assert as_dict(itemsets.minimal_generators(run, "never")) == {"|".join(c): sup[c] for c in gens if c}
    rare = {c: s for c, s in sup.items() if s < 2 and all(x >= 2 for x in low[c])}
    rare = {c: s for c, s in rare.items() if all(c[:i] + c[i + 1 :] in gens for i in range(len(c)))}
    assert as_dict(itemsets.minimal_rare(itemsets.mine(db(spark, baskets), absolute=2, max_size=None))) == {"|".join(c): s for c, s in rare.items()}
    assert max(map(len, rare)) > 3
