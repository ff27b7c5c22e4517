"""Operators for language-model data against brute force, invariants and odd inputs."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("latticequarry.llm.queries")

from latticequarry.llm import components, language, lookalike, matching, mixing, packing, survivor, tokens  # noqa: E402


def groups(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("levels", [24, 1])
def test_components(spark, levels):
    rnd = random.Random(levels)
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(500, x) for x in range(1, 20)] + [(19, 600), (600, 601), (601, 602)]
    pairs = chain + star + [(rnd.randrange(1000, 1060), rnd.randrange(1000, 1060)) for _ in range(40)] + [(7, 7), (None, 3), (3, None), (2, 500), (500, 2)]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "l long, r long, group_id string")
    got = components.consolidate(df, "l", "r", max_levels=levels).collect()
    assert {r[0]: r[1] for r in got} == groups(pairs) and len(got) == len({r[0] for r in got})
    assert components.consolidate(df.limit(0), "l", "r").collect() == []


def test_lookalikes(spark):
    forms = {t: None for t in ["fine Еdge‑case", "ﬁne Edge-case", "fine Edge-case", "fi​ne Edge­case", "ｆｉｎｅ Edge-case", "café", "café", "саfе́", "cafe", "Fine Edge-case", ""]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*forms, *["fine Edge-case café cafe"] * 5, None])], "id long, title string")
    got = {r["title"]: r["form"] for r in lookalike.distinct_forms([(df, "title")]).collect()}
    assert len({got[t] for t in list(forms)[:3]} | {got[list(forms)[4]]}) == 1
    assert got["café"] == got["café"] == got["саfе́"] != got["cafe"] and got["Fine Edge-case"] != got["ﬁne Edge-case"]
    assert got["fi​ne Edge­case"] == "fine Edgecase" and got[""] == ""
    left = spark.createDataFrame([(1, "café"), (2, None), (3, "")], "b long, title string")
    right = spark.createDataFrame([(10, "café"), (11, "café"), (12, "cafe"), (13, None)], "h long, title string")
    assert [tuple(r) for r in lookalike.same_look_pairs(left, "b", right, "h", "title").collect()] == [(1, 10)]


def test_rewriting_is_stable():
    to = lookalike.rewriting(lookalike.classes_of(sorted("eеéé́ﬁf i ​")), {"e": 9, "é": 5, "f": 3, "i": 3, "fi": 2, " ": 4})
    rw = lookalike.rewriter(to)
    for t in ["е́", "ﬁ​ е", "é"]:
        assert rw(rw(t)) == rw(t)
    assert rw("е́") == "é" and rw("ﬁ​") == "fi" and rw(None) is None


def test_survivors(spark):
    at = datetime
    rows = [(1, 10, "Full title of it", "TBD", 2001, "A whole one.", "good", at(2025, 1, 1)), (1, 11, "FULL TITLE", "Venue X", 1900, "Cut off…", "best", None), (1, 12, "n/a", "Venue Y", 2002, "Another whole one.", "good", at(2025, 2, 1)), (1, 13, None, None, None, None, None, None), (2, 20, "", "-", None, "no end", "x", None)]
    df = spark.createDataFrame(rows, "group_id long, hit_id long, title string, venue string, year int, abstract string, source string, retrieved_at timestamp")
    trust = spark.createDataFrame([("best", 1), ("good", 2)], "source string, trust_rank int")
    won = survivor.winners(df, trust)
    assert {(r["group_id"], r["field_name"], r["hit_id"]) for r in won.collect()} == {(1, "title", 10), (1, "venue", 11), (1, "year", 12), (1, "abstract", 12)}
    one = survivor.survivors(won).first()
    assert one["title"] == "Full title of it" and one["abstract_from"] == 12
    assert survivor.winners(df.limit(0), trust).collect() == []


def test_cut_titles_by_brute_force(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(4)
    base = ["miningfreesetsfrommultirelationaldatawithboundedmemoryandtime", "memoryboundedclosedpatternsfordatastreams", "keys"]
    rows = {(1, "miningfreesetsfrommulttirelationaldatawithboundedmemoryandtimes"), (1, "miningfreesetsfrommultirela"), (1, base[0]), (2, "")}
    for g in (1, 2, 3):
        for _ in range(60):
            w = list(rnd.choice(base))[: rnd.randrange(2, 70)]
            for _ in range(rnd.randrange(4)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice("abc"))
                if rnd.random() < 0.5:
                    del w[rnd.randrange(len(w))]
            rows.add((g, "".join(w)))
    want = {(g, a) for g, a in rows for h, b in rows if g == h and len(b) >= len(a) + 4 and edits(a, b[: len(a)]) <= len(a) // 20}
    assert (1, "miningfreesetsfrommultirela") in want
    assert {tuple(r) for r in survivor.cut_titles(spark.createDataFrame(sorted(rows), "group_id long, norm string")).collect()} == want


@pytest.mark.parametrize("a,b,kind", [
    ("free sets | anytime ranking over logs", "fre sets anytime rankingover logs", "equal"),
    ("mining of key sets in web logs | first results", "mining of key sets in web logs", "short"),
    ("mining of key sets in web logs | first results | part two", "mining of key sets in web logs | first results", None),
    ("mining of key sets in web logs | first results revisited", "mining of key sets in web logs | first results", None),
    ("mining of key sets in web logs", "mining of free sets in web logs", None),
    ("pibasa | enumeration de cles", "pibasa", "name"),
    ("mining of key sets in web logs | part 1", "mining of key sets in web logs | part 2", None),
    ("mining of key sets in web logs | volume 3", "mining of key sets in web logs | volume 4", None),
    ("mining of key sets in web logs in 2019", "mining of key sets in web logs in 2018", None),
    ("mining of key sets in web logs | class a", "mining of key sets in web logs | class b", None),
    ("mining of key sets in web logs", "mining of key sets in web logs ii", None),
    ("mining of key sets in dense web logs", "mining o key sets in dense web logs", "dropped"),
    ("two pass mining of key sets", "twopass mining of key sets", "equal"),
    ("mining of key sets in dense web l", "mining of key sets in dense web logs from many shops", "cut"),
])
def test_relate(a, b, kind):
    got = matching.relate(a, b)
    assert (got[0] if got else None) == kind


def test_matching_pairs(spark):
    h = [(1, "Mining of key sets in dense web logs: first results", 2001, "Journal of Logs", None), (2, "Mining of key sets in dense web logs: first results, part two", 2003, "Journal of Logs", None), (3, None, 2005, None, "https://doi.example/10.5555%2Fabc.1."), (4, "Erratum", 2001, "A", None), (5, "", None, None, "10.5555/vol.1")]
    r = [(11, "MINING OF KEY SETS IN DENSE WEB LOGS", 2002, "J. of Logs", None), (12, "Something else entirely about trees", 1990, None, "DOI 10.5555/ABC.1"), (13, "Minnig of key sets in dense web logs: frist results, part two", 2003, None, None), (14, "Erratum", 1999, "B", "10.5555/vol.1")]
    hits = spark.createDataFrame(h, "hit_id long, title string, year int, venue string, doi string")
    recs = spark.createDataFrame(r, "rec_id long, title string, year int, venue string, doi string")
    got = matching.matches(hits, recs, matching.Settings(meet=0.999)).collect()
    assert {(x["hit_id"], x["rec_id"]) for x in got} == {(1, 11), (2, 13), (3, 12)} and all(0 < x["confidence"] <= 1 for x in got)
    assert matching.matches(hits.limit(0), recs).collect() == [] == matching.matches(hits, recs.limit(0)).collect()


def test_kinds_of_dois_are_learned(spark):
    rows = [(i, f"10.1/w.{i}") for i in range(8)] + [(i, f"10.1/draft.{i}") for i in range(6)] + [(50, "10.9/vol.7"), (51, "10.9/paper.7"), (None, None)]
    got = {r["doi"]: r["work"] for r in matching.work_dois(spark.createDataFrame(rows + [(i, f"10.1/w.{i}") for i in range(100, 120)], "cid long, doi string")).collect()}
    assert got["10.1/w.3"] == "10.1/w.3" and got["10.1/draft.3"] is None and got["10.9/vol.7"] is None and got["10.9/paper.7"] == "10.9/paper.7"


def test_training_moves_the_blocking():
    """Titles with a mistyped word stay near after training on walks; the untrained start doesn't bring them together."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)]
    titles = [" ".join(rnd.sample(words, 6)) for _ in range(1500)]
    rows = pd.DataFrame({"norm": titles, "venue": None, "year": None, "doi": None})
    size = matching.TITLE_TOKENS + matching.OTHER_TOKENS
    df = np.zeros(size)
    for t in titles:
        df[matching.title_tokens(t)] += 1
    rng = np.random.default_rng(1)
    v = matching.whitened(matching.skip_gram(matching._walks(rows, np.maximum(df, 1e-9), rng), size, 32, rng), df)
    start = matching.whitened(rng.standard_normal((size, 32)), df)

    def near(x):
        """How much nearer the trigrams of one word are than those of two words."""
        both = [[matching.title_tokens(w) for w in words[i : i + 2]] for i in range(50)]
        return float(np.mean([np.mean([x[p] @ x[q] for p in a for q in a if p != q]) - np.mean(x[a] @ x[b].T) for a, b in both]))

    assert near(v) > 0.1 and abs(near(start)) < 0.02


def test_many_mistyped_words_are_related(spark):
    a = "nuremlo | zahlung von verdichteten basen uber mehrere ebenen oohne kandidaten"
    b = "nuremlo | zhalung von verdichteten baasen uberm ehrere ebenen ohne kandidaten"
    assert matching.relate(a, b)[0] == "equal"
    rows = [("h", 1, a), ("r", 2, b), ("r", 3, "trees of other kinds for people with much time")]
    df = spark.createDataFrame([(s, i, n, None, None) for s, i, n in rows], "side string, cid long, norm string, venue string, year int").withColumn("doi", F.lit(None).cast("string"))
    assert [(r["h"], r["r"]) for r in matching.title_pairs(df, matching.Settings(meet=0.999))[0].collect()] == [(1, 2)]


def test_hopeless_pairs_are_told_without_edits():
    """hopeless() never refuses what relate() accepts, and spares relate() most pairs of titles that share half of their words."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(1, 13))) for _ in range(80)] + ["part", "two", "7", "ii"]

    def mistyped(title):
        for _ in range(rnd.randrange(6)):
            i = rnd.randrange(len(title))
            title = "x" + title if len(title) < 4 else rnd.choice([title[:i] + title[i + 1 :], title[:i] + rnd.choice("abc x") + title[i:], title[:i] + title[i + 1 : i + 2] + title[i : i + 1] + title[i + 2 :], title[: max(3, i)] if rnd.random() < 0.3 else title])
        return " ".join(title.split()) or "x"

    def some():
        w = rnd.choices(words, k=rnd.randrange(1, 11))
        return " ".join(w[: len(w) // 2] + ["|"] * (len(w) > 3) + w[len(w) // 2 :])

    a = [some() for _ in range(6000)]
    b = [mistyped(x) if rnd.random() < 0.7 else " ".join(x.split()[: len(x.split()) // 2] + some().split()) for x in a]
    got, related = matching.hopeless(a, b), np.array([matching.relate(x, y) is not None for x, y in zip(a, b, strict=True)])
    assert not (got & related).any() and related.sum() > 2000
    assert got[~related].mean() > 0.4 and len(matching.hopeless([], [])) == 0


def test_few_unlike_titles_pass_the_sketch():
    """Of titles at a trigram cosine of about 0.6 a tenth pass the cut at most, of those at 0.85 all."""
    rng = np.random.default_rng(2)
    size = matching.TITLE_TOKENS + matching.OTHER_TOKENS
    m = matching.Model(np.zeros((size, 1), np.float32), np.ones(size, np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), rng.choice(np.array([-1, 1], np.int8), (matching.TITLE_TOKENS, matching.SKETCH)), 1, 1)

    def passing(same):
        sets = [rng.choice(matching.TITLE_TOKENS, 200 - same, replace=False) for _ in range(400)]
        x, y = (m.sketches(s).view(np.uint64) for s in ([t[:100] for t in sets], [np.r_[t[:same], t[100:]] for t in sets]))
        return float((np.bitwise_count(x ^ y).sum(axis=1) <= matching.APART).mean())

    assert passing(60) < 0.1 and passing(85) > 0.99


def test_variants_are_the_same_on_both_sides():
    whole = "mining of key sets in dense web logs | first results from shops | part two"
    cut_off = "mining of key sets in dense web logs fi"
    got = matching.variants(whole)
    assert "mining of key sets in dense web logs" in got and "mining of key sets in dense web logs first results from shops" in got
    assert " ".join(whole.replace("|", " ").split()[:9]) in got and " ".join(cut_off.split()[:6]) in matching.variants(cut_off)


def test_titles_meet_as_often_at_any_size():
    s = matching.Settings()
    meet = [1 - (1 - s.side**b) ** matching.table_count(b, s) for b in (8, 11, 15, 19)]
    assert max(meet) - min(meet) < 0.01 and meet[0] > 0.95


def test_sum_of_squares_by_brute_force():
    rnd = random.Random(3)
    sizes, cap = [rnd.randrange(1, 11) for _ in range(60)], 10
    gaps: list[int] = []
    for s in sizes:
        def total(g):
            return sum(g.count(x) ** 2 for x in set(g) if x)

        best = min([(total(gaps[:i] + [g - s] + gaps[i + 1 :]), 0, g - s, i) for i, g in enumerate(gaps) if g >= s] + [(total([*gaps, cap - s]), 1, 0, -1)])
        if best[3] < 0:
            gaps.append(cap - s)
        else:
            gaps[best[3]] -= s
    box = packing.sum_of_squares(np.array(sizes), cap)
    used = np.bincount(box, weights=sizes)
    assert sorted(cap - used) == sorted(gaps) and used.max() <= cap


def test_packing(spark):
    rnd = random.Random(1)
    items = [(i, rnd.randrange(1, 60)) for i in range(300)] + [(900, 250), (901, 100), (902, 0), (None, 5), (5, 7)]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, 0)], "capacity_id int, capacity_tokens int")
    got = packing.contents(df, caps)
    rows = got.collect()
    for c, size in ((1, 100), (2, 64)):
        mine = [r for r in rows if r["capacity_id"] == c]
        assert sum(r["tokens"] for r in mine) == sum(t for d, t in items if d is not None)
        assert all(len([r for r in mine if r["doc_id"] == d and r["doc_id"] != 5]) == -(-t // size) for d, t in items if d is not None and d != 5)
    boxes = packing.containers(got, caps).collect()
    assert min(b["unused"] for b in boxes) >= 0
    assert sum(b["unused"] for b in boxes if b["capacity_id"] == 1) < 0.05 * 100 * sum(b["capacity_id"] == 1 for b in boxes)
    assert packing.contents(df.limit(0), caps).collect() == []


def test_mixture(spark):
    rnd = random.Random(2)
    docs = [(i, "big", rnd.randrange(1, 20)) for i in range(2000)] + [(5000 + i, "Small Set ", rnd.randrange(1, 20)) for i in range(100)] + [(9000, None, 5), (9001, "other", 5), (9002, "big", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("big", 0.75, 1), ("small_set", 0.25, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(df, t).cache()
    s = {r["source"]: r for r in mixing.shares(mix, df, t).collect()}
    assert abs(s["big"]["actual_share"] - 0.75) < 0.02 and s["small_set"]["repeats"] <= 3 and s["gone"]["tokens"] == 0
    rows = mix.collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows) and len({(r["doc_id"], r["repeat"]) for r in rows}) == len(rows)
    first = [r["doc_id"] for r in rows if r["source"] == "small_set" and r["repeat"] == 1]
    assert len(first) == 100
    half = mixing.shares(mixing.mixture(df, t, budget=1000.0), df, t).collect()
    assert abs(sum(r["tokens"] for r in half) - 1000) < 60
    assert mixing.mixture(df.limit(0), t).collect() == []


def test_mixture_passes_over_what_does_not_fit(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", n) for i, n in enumerate([70, 60, 55, 40, 9, 8, 7, 3, 2])]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        s = {r["source"]: r for r in mixing.shares(mixing.mixture(df, t, budget=500.0, seed=seed), df, t).collect()}
        assert s["a"]["tokens"] == 400 and s["b"]["tokens"] <= 100
        assert s["b"]["smallest_left"] is None or s["b"]["tokens"] + s["b"]["smallest_left"] > 100


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 20000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100


EN = ["The miner keeps the empty set in every run.", "This threshold was checked against the definition of the window.", "Please run the program again with more memory."]
DE = ["Der Lauf behält die leere Menge in jedem Fenster.", "Diese Schwelle wurde gegen die Definition des Fensters geprüft.", "Bitte das Programm noch einmal mit mehr Speicher starten."]


def test_language():
    data = pd.DataFrame({"text": [" ".join(EN), " ".join(DE)] * 6 + [" ".join(DE)], "code": ["en", "de"] * 6 + ["en"]})
    table = language.train(data, epochs=5, dim=512)
    seg = language.segment("[2025-01-01] x=1 rc=0\n" + " ".join(EN[:2]) + "\n\n" + " ".join(DE) + " “in jedem Fenster”", table)
    assert [s[3] for s in seg] == ["en", "de"] and seg[1][2] == 3
    for text in (None, "", "  ", "no end mark here", "$ ./run -s 0.1", "3.5 4.5."):
        assert language.segment(text, table) == []


def test_language_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", "en-US", "English", "eng", None, "und", "xx", "pt_BR", "Turkish"]], "lang string")
    assert [r[0] for r in df.select(language.label_code(df["lang"])).collect()] == ["en"] * 4 + [None, None, "xx", "pt", "tr"]
    segs = spark.createDataFrame([(1, "en", "en"), (2, None, "de"), (3, "en", "de"), (4, "en", "en"), (4, "en", "fr"), (5, "zxx", "en")], "doc_id long, label string, lang string")
    assert {tuple(r) for r in language.wrong_labels(segs).collect()} == {(2, "de"), (3, "de"), (4, "en"), (4, "fr")}
