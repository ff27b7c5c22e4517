"""Itemset families by prefix projection: frequent sets, generators, borders, closures, rules.

A database is long: (g, tid, item), distinct; g is a group such as a window, 0 for a whole
database. Baskets are reduced to ranks of frequent items and equal baskets are merged with
a weight. A level holds one row per (pattern, remaining items) and is extended by exploding
the remaining items and counting, which combines before the shuffle; transactions are never
joined with transactions. Only generators are extended where the family allows it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.conventions import threshold_column
from ..session import cut, cut_counted

#: Candidates of one level beyond which mining stops with an error instead of filling the disks.
MAX_CANDIDATES = 200_000_000
#: Patterns with one shared beginning that meet in one task.
CROWD = 1000


def as_database(tx: DataFrame, group: str | None = None) -> DataFrame:
    """(g, tid, item) distinct, without null ids and null or empty items."""
    g = F.col(group) if group else F.lit(0)
    return tx.select(g.cast("long").alias("g"), F.col("tid").cast("long").alias("tid"), F.col("item").cast("string").alias("item")).where("tid IS NOT NULL AND item <> ''").distinct()


def sizes(db: DataFrame) -> DataFrame:
    """(g, n): non-empty transactions of each group."""
    return db.groupBy("g", "tid").agg(F.lit(1).alias("x")).groupBy("g").agg(F.count("*").alias("n"))


@dataclass
class Mined:
    """Levels of a mining run; patterns are sorted arrays of item ranks."""

    ranks: DataFrame
    groups: DataFrame
    baskets: DataFrame
    singles: DataFrame
    kept: list[DataFrame] = field(default_factory=list)
    counted: list[DataFrame] = field(default_factory=list)
    closed: list[DataFrame] = field(default_factory=list)


def subsets_of(key: Column) -> Column:
    """All immediate subsets of a pattern (one item dropped), in the order of the dropped items."""
    return F.transform(key, lambda _, i: F.filter(key, lambda __, j: j != i))


def _check(level: DataFrame, before: DataFrame, k: int, strict: bool) -> DataFrame:
    """(g, key, sup, below, lost): smallest support of the immediate subsets, and the dropped item of the first equal one.

    Only candidates whose immediate subsets are all in `before` remain; strict also asks for a smaller support than each.
    """
    each = level.select(*level.columns, F.posexplode(subsets_of(F.col("key"))).alias("at", "sub"))
    low = before.select("g", F.col("key").alias("sub"), F.col("sup").alias("low"))
    met = each.join(low, ["g", "sub"]).groupBy("g", "key", "sup").agg(F.count("*").alias("n"), F.min("low").alias("below"), *([F.max("u").alias("u")] if "u" in level.columns else []), F.min(F.when(F.col("low") == F.col("sup"), F.element_at("key", F.col("at") + 1))).alias("lost"))
    out = met.where(F.col("n") == k)
    return (out.where("sup < below") if strict else out).drop("n")


def mine(
    db: DataFrame,
    sigma: float | str | None = None,
    side: str = "ceil",
    absolute: int | None = None,
    max_size: int | None = None,
    generators: bool = True,
    groups: DataFrame | None = None,
    closures: bool = False,
    theta: int = 0,
) -> Mined:
    """Run the levels until one is empty, or up to the caller's max_size. Threshold: sigma with its side, or an absolute count (the same for every group).

    counted[k] holds every counted candidate of size k + 1 whose prefix was kept, kept[k] what remains. With closures,
    the items before a pattern's last one travel along and closed[k] holds the closure of each kept pattern: counting
    one item more tells which items all its transactions hold. If db has a column util, patterns carry their summed
    utility u and closures uc, and patterns whose transaction-weighted utility is below theta aren't kept.
    """
    value = "util" in db.columns
    if groups is None:
        m = F.lit(max(1, absolute)).cast("long") if absolute is not None else threshold_column(sigma, F.col("n"), side)
        groups = sizes(db).withColumn("m", m)
    groups = cut(groups)
    if value:
        db = db.join(db.groupBy("g", "tid").agg(F.sum("util").alias("tu")), ["g", "tid"])
    sums = [F.sum("util").alias("u"), F.sum("tu").alias("twu")] if value else []
    money = ["u"] if value else []
    singles = db.groupBy("g", "item").agg(F.count("*").alias("sup"), *sums).join(groups, "g")
    enough = F.col("twu") >= theta if value else F.lit(True)
    # frequent items only; their number is bounded by total items / threshold. A rank need not be dense, only in order
    frequent = singles.where(F.col("sup") >= F.col("m")).where(enough)
    order = frequent.groupBy("item").agg(F.sum("sup").alias("s")).orderBy(F.desc("s"), "item")
    ranks = cut(order.select("item", F.monotonically_increasing_id().alias("rank")))
    singles = cut(singles.join(ranks, "item", "left"))
    usable = singles.where("sup >= m").where(enough)
    first = usable.select("g", F.array("rank").alias("key"), "sup", *money, "n", "m")
    out = Mined(ranks, groups, _baskets(db, usable.select("g", "item", "rank"), value), singles)
    kept = first.where("sup < n") if generators else first
    out.kept.append(kept.select("g", "key", "sup", *money))
    out.counted.append(first.select("g", "key", "sup"))
    part = out.baskets.select("g", "w", *(["tu"] if value else []), F.posexplode("items").alias("p", "e"), "items")
    part = part.select("g", F.array(_x("e", value)).alias("key"), *([F.col("e.v").alias("u"), "tu"] if value else []), F.expr("slice(items, p + 2, size(items))").alias("rest"), *([F.expr("slice(items, 1, p)").alias("skip")] if closures else []), "w")
    part = part.join(kept.select("g", "key"), ["g", "key"], "left_semi")
    for k in count(2):
        if max_size is not None and k > max_size + closures:
            break
        # equal remainders of a pattern are merged; with utilities they are left apart, as their arrays would have to be added
        if k > 2:
            part = cut(part if value else part.groupBy(*[c for c in part.columns if c != "w"]).agg(F.sum("w").alias("w")))
        tag = lambda c, ahead: F.transform(c, lambda e: F.struct(e.alias("e"), F.lit(ahead).alias("ahead")))
        both = F.concat(tag("rest", True), tag("skip", False)) if closures else tag("rest", True)
        seen = part.select("g", "key", "w", *(["u", "tu"] if value else []), F.explode(both).alias("t")).select("*", F.col("t.ahead").alias("ahead"), F.col("t.e.x" if value else "t.e").alias("x"))
        sums = [F.sum(F.col("u") + F.col("t.e.v")).alias("u"), F.sum("t.e.v").alias("xv"), F.sum("tu").alias("twu")] if value else []
        met = seen.groupBy("g", "key", "x", "ahead").agg(F.sum("w").alias("sup"), *sums)
        met, n = cut_counted(met)
        if n > MAX_CANDIDATES:
            raise RuntimeError(f"more than {MAX_CANDIDATES} candidates of size {k}; raise the threshold or lower max_size")
        if closures:
            own = out.kept[-1]
            all_ = met.select("g", "key", "x", F.col("sup").alias("c"), *(["xv"] if value else [])).join(own.select("g", "key", "sup"), ["g", "key"]).where("c = sup")
            more = all_.groupBy("g", "key").agg(F.collect_list("x").alias("more"), *([F.sum("xv").alias("mu")] if value else []))
            uc = [F.col("u"), (F.col("u") + F.coalesce("mu", F.lit(0))).alias("uc")] if value else []
            whole = F.array_sort(F.concat("key", F.coalesce("more", F.array().cast("array<bigint>")))).alias("closure")
            out.closed.append(cut(own.join(more, ["g", "key"], "left").select("g", "key", "sup", whole, *uc)))
            if max_size is not None and k > max_size:
                break
        counts = met.where("ahead").select("g", F.concat("key", F.array("x")).alias("key"), "sup", *(["u", "twu"] if value else []))
        out.counted.append(counts.select("g", "key", "sup"))
        level = counts.join(groups, "g").where("sup >= m").where(enough).select("g", "key", "sup", *money)
        kept, n = cut_counted(_check(level, out.kept[-1], k, True).select("g", "key", "sup", *money) if generators else level)
        out.kept.append(kept)
        if not n:
            break
        ext = part.select("*", F.posexplode("rest").alias("p", "e"))
        key = F.concat("key", F.array(_x("e", value))).alias("key")
        part = ext.select("g", key, *([(F.col("u") + F.col("e.v")).alias("u"), "tu"] if value else []), F.expr("slice(rest, p + 2, size(rest))").alias("rest"), *([F.expr("concat(skip, slice(rest, 1, p))").alias("skip")] if closures else []), "w")
        # a pattern without remaining items is at its end, but its closure still has to be counted
        part = (part if closures else part.where(F.size("rest") > 0)).join(kept.select("g", "key"), ["g", "key"], "left_semi")
    return out


def _x(e: str, value: bool) -> Column:
    return F.col(e + ".x") if value else F.col(e)


def _baskets(db: DataFrame, usable: DataFrame, value: bool) -> DataFrame:
    """(g, items, w) of merged baskets; with utilities items are (x, v) and tu is the summed utility of the merged transactions."""
    rows = db.join(usable, ["g", "item"])
    if not value:
        return cut(rows.groupBy("g", "tid").agg(F.array_sort(F.collect_set("rank")).alias("items")).groupBy("g", "items").agg(F.count("*").alias("w")))
    one = rows.groupBy("g", "tid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("x"), F.col("util").alias("v")))).alias("s"), F.max("tu").alias("tu"))
    one = one.withColumn("names", F.col("s.x"))
    long = one.select("g", "names", "tu", F.explode("s").alias("e")).groupBy("g", "names", F.col("e.x").alias("x")).agg(F.sum("e.v").alias("v"), F.count("*").alias("w"), F.sum("tu").alias("tu"))
    return cut(long.groupBy("g", "names").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("items"), F.max("w").alias("w"), F.max("tu").alias("tu")).drop("names"))


def named(rows: DataFrame, ranks: DataFrame, key: str = "key", to: str = "items") -> DataFrame:
    """Rank arrays as sorted `|`-joined item names; patterns are short, so they are exploded and joined with the names."""
    other = [c for c in rows.columns if c != key]
    long = rows.select(*other, F.col(key).alias("_k"), F.explode_outer(key).alias("rank")).join(ranks.select("rank", "item"), "rank", "left")
    return long.groupBy(*other, "_k").agg(F.concat_ws("|", F.array_sort(F.collect_list("item"))).alias(to)).drop("_k")


def _stack(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].select("g", "key", "sup")
    for x in levels[1:]:
        out = out.unionAll(x.select("g", "key", "sup"))
    return out


def empty_set(m: Mined) -> DataFrame:
    """The empty pattern of each group, with support |D|."""
    return m.groups.select("g", F.array().cast("array<bigint>").alias("key"), F.col("n").alias("sup"))


def _finish(rows: DataFrame, ranks: DataFrame, *extra: str) -> DataFrame:
    rows = rows.withColumn("size", F.size("key"))
    return named(rows, ranks).select("g", "items", "size", F.col("sup").alias("support"), *extra)


def frequent_itemsets(m: Mined) -> DataFrame:
    """(g, items, size, support) of a run with generators=False."""
    return _finish(_all(m.kept), m.ranks)


def tagged_itemsets(m: Mined) -> DataFrame:
    """Frequent itemsets with is_generator (a run with generators=False)."""
    low = _all([empty_set(m), *m.kept])
    flags = []
    for k, level in enumerate(m.kept, 1):
        flags.append(_check(level, low, k, False).select("g", "key", "sup", (F.col("sup") < F.col("below")).alias("is_generator")))
    return _finish(_stack(flags), m.ranks, "is_generator")


def with_empty(m: Mined, rule: str) -> DataFrame:
    """Generators with the empty set by the given rule, as rank rows."""
    gens = _all(m.kept)
    if rule == "never":
        return gens
    if rule == "always":
        return gens.unionAll(empty_set(m))
    some = m.singles.where("sup >= m").groupBy("g").agg(F.max(F.col("sup") == F.col("n")).alias("full"))
    e = empty_set(m).join(some.where("NOT full") if rule == "no_full_support_item" else some, "g", "left_semi")
    return gens.unionAll(e)


def minimal_generators(m: Mined, empty: str = "always") -> DataFrame:
    """(g, items, size, support) of the minimal generators."""
    return _finish(with_empty(m, empty), m.ranks)


def closures(m: Mined, empty: str = "never") -> DataFrame:
    """(g, key, sup, closure) of the kept patterns of a run with closures: all items of every transaction that holds the pattern."""
    if not m.closed:
        raise ValueError("closures need a run with closures=True")
    rows = _stack([c.select("g", "key", "sup", "closure") for c in m.closed])
    if empty == "never":
        return rows
    full = m.singles.where("sup = n AND sup >= m").groupBy("g").agg(F.array_sort(F.collect_list("rank")).alias("closure"))
    none = with_empty(m, empty).where(F.size("key") == 0)
    return rows.unionAll(none.join(full, "g", "left").select("g", "key", "sup", F.coalesce("closure", F.array().cast("array<bigint>")).alias("closure")))


def generator_closures(m: Mined, empty: str = "always") -> DataFrame:
    """(g, generator, closure, support) pairs."""
    rows = closures(m, empty)
    return named(named(rows, m.ranks, "key", "generator"), m.ranks, "closure", "closed").select("g", "generator", F.col("closed").alias("closure"), F.col("sup").alias("support"))


def closed_itemsets(m: Mined, empty: str = "always") -> DataFrame:
    """(g, items, support): distinct closures of the generators."""
    rows = closures(m, empty).select("g", F.col("closure").alias("key"), "sup").distinct()
    return named(rows, m.ranks).select("g", "items", F.col("sup").alias("support"))


def equivalence_classes(m: Mined, empty: str = "always") -> DataFrame:
    """(g, closure, support, n_generators, generators): generators of each class, joined by ' ; ' in order."""
    return generator_closures(m, empty).groupBy("g", "closure", "support").agg(F.count("*").alias("n_generators"), F.concat_ws(" ; ", F.array_sort(F.collect_list("generator"))).alias("generators"))


def exact_rules(m: Mined) -> DataFrame:
    """(g, antecedent, consequent, support): generator => closure without it, confidence 1; empty consequents dropped."""
    rows = closures(m, "always").select("g", "key", "sup", F.array_except("closure", "key").alias("rest")).where(F.size("rest") > 0)
    return named(named(rows, m.ranks, "key", "antecedent"), m.ranks, "rest", "consequent").select("g", "antecedent", "consequent", F.col("sup").alias("support"))


def k_free(m: Mined, k: int) -> DataFrame:
    """(g, items, size, support) of the k-free sets (k = 2: disjunction-free), the empty set included.

    For every Y below X with at most k items less, the support of X must differ from the signed sum over the sets
    between them; all subsets must be k-free themselves. Y = {} counts only if k >= |X|.
    """
    known = empty_set(m)
    out = [known]
    for s, level in enumerate(m.kept, 1):
        full = (1 << s) - 1
        z = level.select("g", "key", "sup", F.explode(F.sequence(F.lit(0), F.lit(full - 1))).alias("z"))
        z = z.withColumn("sub", F.expr("filter(key, (e, i) -> (shiftright(z, i) & 1) = 1)"))
        z = z.join(known.select("g", F.col("key").alias("sub"), F.col("sup").alias("zs")), ["g", "sub"])
        whole = z.groupBy("g", "key").agg(F.count("*").alias("n")).where(F.col("n") == full).select("g", "key")
        y = z.select("g", "key", "sup", "z", "zs", F.explode(F.expr("filter(sequence(0, z), y -> (y & z) = y)")).alias("y"))
        gap = F.lit(s) - F.bit_count("y")
        y = y.where((gap <= k) & ((F.col("y") > 0) | (F.lit(k) >= s)))
        sign = F.when((F.lit(s) - F.bit_count("z")) % 2 == 1, 1).otherwise(-1)
        bad = y.groupBy("g", "key", "sup", "y").agg(F.sum(sign * F.col("zs")).alias("d")).where("d = sup").select("g", "key").distinct()
        ok = cut(level.join(whole, ["g", "key"], "left_semi").join(bad, ["g", "key"], "left_anti"))
        out.append(ok)
        known = known.unionAll(ok)
        if ok.isEmpty():
            break
    return _finish(_all(out), m.ranks)


def _positive(m: Mined) -> tuple[DataFrame, list[DataFrame]]:
    """Full-support items (g, key, sup), and by size the border sets (g, key, sup, red); red: the redundant item of the smallest rank."""
    single = m.singles.where("sup = n AND sup >= m").select("g", F.array("rank").alias("key"), "sup")
    more = []
    for k in range(2, len(m.counted) + 1):
        level = m.counted[k - 1].join(m.groups, "g").where("sup >= m").select("g", "key", "sup")
        more.append(_check(level, m.kept[k - 2], k, False).where("sup = below").select("g", "key", "sup", F.col("lost").alias("red")))
    return single, more


def positive_border(m: Mined) -> DataFrame:
    """(g, items, size, support, redundant_item): frequent sets that aren't generators though all immediate subsets are.

    Items of full support belong to it. Of several redundant items the first in name order is given.
    """
    single, more = _positive(m)
    border = _all([single, *more])
    low = _all([empty_set(m), *m.kept])
    each = border.select("g", "key", "sup", F.posexplode(subsets_of(F.col("key"))).alias("at", "sub")).withColumn("rank", F.element_at("key", F.col("at") + 1))
    lost = each.join(low.select("g", F.col("key").alias("sub"), F.col("sup").alias("low")), ["g", "sub"]).where("low = sup").join(m.ranks.select("rank", "item"), "rank")
    red = lost.groupBy("g", "key").agg(F.min("item").alias("redundant_item"))
    return _finish(border.join(red, ["g", "key"]), m.ranks, "redundant_item")


def _joined(level: DataFrame) -> DataFrame:
    """Candidates (g, key) of the next size: two kept sets that share all but their last item; large shared parts are salted by their own size."""
    split = level.select("g", F.expr("slice(key, 1, size(key) - 1)").alias("pre"), F.try_element_at("key", F.lit(-1)).alias("x"))
    split = split.join(split.groupBy("g", "pre").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("many")), ["g", "pre"])
    a = split.withColumn("salt", F.pmod(F.xxhash64("x"), F.col("many")).cast("int")).drop("many")
    b = split.withColumnRenamed("x", "y").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).drop("many")
    return a.join(b, ["g", "pre", "salt"]).where("x < y").select("g", F.concat("pre", F.array("x", "y")).alias("key"))


def border_ranks(m: Mined, zero: bool = True) -> list[DataFrame]:
    """Infrequent sets of size >= 2 all of whose immediate subsets are frequent generators, by size."""
    rows = []
    for k in range(2, len(m.kept) + 1):
        cand = _joined(m.kept[k - 2]).join(m.counted[k - 1], ["g", "key"], "left").select("g", "key", F.coalesce("sup", F.lit(0)).alias("sup"))
        low = cand.join(m.groups, "g").where("sup < m").select("g", "key", "sup")
        rows.append(_check(low, m.kept[k - 2], k, False).select("g", "key", "sup"))
    return rows


def negative_border(m: Mined) -> DataFrame:
    """(g, items, size, support): infrequent sets, of support 0 too, all of whose immediate subsets are frequent generators."""
    single = m.singles.where("sup < m").select("g", F.col("item").alias("items"), F.lit(1).alias("size"), F.col("sup").alias("support"))
    rows = border_ranks(m)
    return single.unionAll(_finish(_all(rows), m.ranks)) if rows else single


def minimal_rare(m: Mined) -> DataFrame:
    """Minimal rare itemsets at maxsup = the run's threshold: the same sets as the negative border."""
    return negative_border(m)


def cover_items(m: Mined) -> DataFrame:
    """(g, item) of the items that every transaction holds."""
    return m.singles.where("sup = n").select("g", "item")


def recover_frequent(m: Mined) -> DataFrame:
    """(g, items, size, support) of all frequent sets, rebuilt from generators, negative border and cover items only.

    A set is frequent if its immediate subsets are and it is no border set; its support is the smallest of theirs
    and of its own, if it is a generator. Goes on until a level is empty, beyond the longest generator.
    """
    border = border_ranks(m)
    full = m.singles.where("sup = n AND sup >= m").select("g", F.array("rank").alias("key"), "sup")
    levels = [cut(m.kept[0].select("g", "key", "sup").unionAll(full))]
    for k in count(2):
        cand = _joined(levels[-1])
        if k - 2 < len(border):
            cand = cand.join(border[k - 2].select("g", "key"), ["g", "key"], "left_anti")
        sub = cand.select("g", "key", F.explode(subsets_of(F.col("key"))).alias("sub")).join(levels[-1].select("g", F.col("key").alias("sub"), "sup"), ["g", "sub"])
        all_ = sub.groupBy("g", "key").agg(F.count("*").alias("c"), F.min("sup").alias("low")).where(F.col("c") == k)
        if k <= len(m.kept):
            all_ = all_.join(m.kept[k - 1].select("g", "key", F.col("sup").alias("own")), ["g", "key"], "left").withColumn("low", F.least("low", "own"))
        levels.append(cut(all_.select("g", "key", F.col("low").alias("sup"))))
        if levels[-1].isEmpty():
            return _finish(_all(levels), m.ranks)


def recover_frequent_positive(m: Mined) -> DataFrame:
    """(g, items, size, support) of all frequent sets, rebuilt from generators and positive border only.

    Every frequent set that is no generator holds a border set, whose redundant item it can lose without a change of
    support; a set without one that is no generator is infrequent. Goes on until a level is empty.
    """
    single, more = _positive(m)
    levels = [cut(m.kept[0].select("g", "key", "sup", F.lit(None).cast("long").alias("red")).unionAll(single.select("g", "key", "sup", F.col("key")[0])))]
    for k in count(2):
        cand = _joined(levels[-1])
        sub = cand.select("g", "key", F.posexplode(subsets_of(F.col("key"))).alias("at", "sub")).join(levels[-1].withColumnRenamed("key", "sub"), ["g", "sub"])
        lost = F.element_at("key", F.col("at") + 1)
        all_ = sub.groupBy("g", "key").agg(F.count("*").alias("c"), F.min("red").alias("below"), F.map_from_entries(F.collect_list(F.struct(lost.alias("k"), F.col("sup").alias("v")))).alias("sups")).where(F.col("c") == k)
        if k <= len(m.kept):
            all_ = all_.join(m.kept[k - 1].select("g", "key", F.col("sup").alias("own")), ["g", "key"], "left")
            all_ = all_.join(more[k - 2].select("g", "key", F.col("red").alias("at_border")), ["g", "key"], "left")
        else:
            all_ = all_.withColumns({"own": F.lit(None).cast("long"), "at_border": F.lit(None).cast("long")})
        red = F.when(F.col("own").isNull(), F.coalesce("at_border", "below"))
        rows = all_.withColumn("red", red).withColumn("sup", F.coalesce("own", F.try_element_at("sups", "red"))).where("sup IS NOT NULL")
        levels.append(cut(rows.select("g", "key", "sup", "red")))
        if levels[-1].isEmpty():
            return _finish(_all(levels), m.ranks)


def contained(rows: DataFrame, keys: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """The columns of rows but `items`, with each key (a sorted array that isn't empty) all of whose elements `items` holds.

    Rows step down the prefix tree of the keys, one join a level, so a row meets only keys whose beginning it holds.
    """
    longest = keys.agg(F.max(F.size("key"))).first()[0] or 0
    keep = [c for c in rows.columns if c != "items"]
    kind = keys.schema["key"].dataType
    part = rows.select(*keep, F.array().cast(kind).alias("key"), F.col("items").alias("rest"))
    out = []
    for k in range(1, longest + 1):
        nodes = keys.where(F.size("key") >= k).groupBy(*on, F.expr(f"slice(key, 1, {k})").alias("key")).agg(F.max(F.size("key") == k).alias("whole"))
        step = part.select(*keep, "key", "rest", F.posexplode("rest").alias("p", "x")).select(*keep, F.concat("key", F.array("x")).alias("key"), F.expr("slice(rest, p + 2, size(rest))").alias("rest"))
        part = cut(step.join(nodes, [*on, "key"]))
        out.append(part.where("whole").select(*keep, "key"))
        part = part.drop("whole")
    return _stack(out) if out else part.select(*keep, "key").limit(0)


def _split(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\|"), lambda x: x != "")))


def itemset_support(db: DataFrame, patterns: DataFrame) -> DataFrame:
    """(items, support) of given patterns (column items, `|`-joined), 0 for those no transaction holds; {} holds everywhere.

    Equal baskets are merged, then step down the prefix tree of the patterns; only (basket, prefix it holds) rows arise.
    """
    p = patterns.select("items").distinct().withColumn("key", _split(F.col("items")))
    named_ = p.select(F.explode("key").alias("item")).distinct()
    baskets = db.join(named_, "item").groupBy("g", "tid").agg(F.array_sort(F.collect_set("item")).alias("items")).groupBy("items").agg(F.count("*").alias("w"))
    hit = contained(baskets, p.where(F.size("key") > 0).select("key").distinct()).groupBy("key").agg(F.sum("w").alias("support"))
    n = sizes(db).agg(F.sum("n").alias("n"))
    return p.join(hit, "key", "left").crossJoin(F.broadcast(n)).select("items", F.when(F.size("key") == 0, F.col("n")).otherwise(F.coalesce("support", F.lit(0))).alias("support"))


def lookup_support(m: Mined, patterns: DataFrame) -> DataFrame:
    """(g, items, support) of given patterns (g, items) from generators and negative border alone; null where the pattern is infrequent.

    The support is the smallest of the generators a pattern holds ({} among them), unless it holds a border set.
    """
    border = named(_all([*border_ranks(m), m.singles.where("sup < m AND rank IS NOT NULL").select("g", F.array("rank").alias("key"), "sup")]), m.ranks).select("g", F.lit(-1).cast("long").alias("sup"), "items")
    border = border.unionAll(m.singles.where("sup < m").select("g", F.lit(-1).cast("long"), F.col("item")))
    known = named(_all(m.kept), m.ranks).select("g", "sup", "items").unionAll(border).select("g", _split(F.col("items")).alias("key"), "sup").distinct()
    p = patterns.select("g", F.col("items").alias("name")).distinct()
    rows = p.withColumn("items", _split(F.col("name")))
    low = contained(rows, known.select("g", "key"), ("g",)).join(known, ["g", "key"]).groupBy("g", "name").agg(F.min("sup").alias("low"))
    # an item of no transaction makes a pattern infrequent too
    odd = rows.select("g", "name", F.explode("items").alias("item")).join(m.singles.select("g", "item"), ["g", "item"], "left_anti").select("g", "name", F.lit(True).alias("odd")).distinct()
    out = p.join(low, ["g", "name"], "left").join(odd, ["g", "name"], "left").join(m.groups.select("g", "n"), "g")
    return out.select("g", F.col("name").alias("items"), F.when(F.col("odd") | (F.col("low") < 0), None).otherwise(F.coalesce("low", "n")).alias("support"))
