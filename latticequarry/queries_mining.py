"""Mining and profiling queries with their SQL."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import functions as F

from .operators import audit, itemsets, profile, sequences, utility, windows
from .session import checkpoint_dir, cut, load
from .sources import fixtures as fx
from .streaming import generators as streams

# ------------------------------------------------------------------ SQL building blocks

T1 = (
    "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS tid, unnest(['nation=' || n_name, 'region=' || r_name, 'seg=' || c_mktsegment, 'bal=' || CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR)]) AS item "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
T4 = "SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
T5 = "SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
K1 = (
    "SELECT DISTINCT tid, item FROM (SELECT doc_id AS tid, unnest(list_distinct(string_split(lower(text), ' '))) AS item FROM documents) WHERE item IN (SELECT item FROM "
    "(SELECT item, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS item FROM documents) WHERE item <> '' GROUP BY item ORDER BY n DESC, item LIMIT 40))"
)
U2 = "SELECT l_orderkey AS tid, p_brand AS item, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS util FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def m_sql(sigma: str, side: str = "ceil") -> str:
    f = Fraction(sigma)
    p, q = f.numerator, f.denominator
    x = f"n * {p}"
    whole = {"floor": f"{x} // {q}", "ceil": f"({x} + {q - 1}) // {q}", "round": f"CASE WHEN 2 * (({x}) % {q}) > {q} OR (2 * (({x}) % {q}) = {q} AND (({x}) // {q}) % 2 = 1) THEN ({x}) // {q} + 1 ELSE ({x}) // {q} END"}[side]
    return f"greatest(1, {whole})"


def levels_sql(tx: str, m: str, g: str = "0") -> str:
    """CTEs of all sizes: tx, p (g, n, m), f1 frequent items, cov frequent pattern x transaction, fr frequent sets, lo their smallest and
    equal immediate subsets, gn generators. Patterns are sorted lists; the recursion ends with the first empty size."""
    src = f"SELECT {g} AS g, tid, item FROM ({tx})"
    return (
        f"WITH RECURSIVE tx AS ({src}), p AS (SELECT g, n, {m} AS m FROM (SELECT g, count(DISTINCT tid) AS n FROM tx GROUP BY g)), "
        "i1 AS (SELECT g, item, count(*) AS s FROM tx GROUP BY ALL), f1 AS (SELECT g, item, s, n, m FROM i1 JOIN p USING (g) WHERE s >= m), ft AS (SELECT tx.g, tid, tx.item, m FROM tx JOIN f1 ON f1.g = tx.g AND f1.item = tx.item), "
        "cov(g, k, items, item, tid, m) AS (SELECT g, 1, [item], item, tid, m FROM ft UNION ALL SELECT * FROM (SELECT cov.g, k + 1, list_append(cov.items, y.item), y.item, cov.tid, cov.m FROM cov JOIN ft y ON y.g = cov.g AND y.tid = cov.tid AND y.item > cov.item) "
        "t(g, k, items, item, tid, m) QUALIFY count(*) OVER (PARTITION BY g, items) >= m), "
        "fr AS (SELECT g, k, items, count(*) AS s FROM cov GROUP BY ALL), su AS (SELECT g, k, items, s, i, list_filter(items, lambda x, j: j <> i) AS less FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM fr)), "
        "lo AS (SELECT su.g, su.k, su.items, su.s, su.i, su.less, coalesce(f.s, p.n) AS low FROM su JOIN p USING (g) LEFT JOIN fr f ON f.g = su.g AND f.items = su.less), "
        "gn AS (SELECT g, k, items, s FROM lo GROUP BY ALL HAVING min(low) > s) "
    )


def rows_sql(table: str, extra: str = "", where: str = "") -> str:
    return f"SELECT array_to_string(items, '|') AS items, k AS size, s AS support{extra} FROM {table}{where}"


EMPTY = " UNION ALL SELECT '' AS items, 0 AS size, n AS support FROM p"
#: Generators with their closures: the items that all their transactions hold.
CLOSE = (
    ", ge AS (SELECT g, items, s FROM gn UNION ALL SELECT g, CAST([] AS VARCHAR[]), n FROM p), "
    "ct AS (SELECT gn.g, gn.items, gn.s, cov.tid FROM gn JOIN cov ON cov.g = gn.g AND cov.items = gn.items UNION ALL SELECT p.g, CAST([] AS VARCHAR[]), p.n, t.tid FROM p JOIN (SELECT DISTINCT g, tid FROM tx) t ON t.g = p.g), "
    "ci AS (SELECT ct.g, ct.items, ct.s, tx.item FROM ct JOIN tx ON tx.g = ct.g AND tx.tid = ct.tid GROUP BY ALL HAVING count(*) = ct.s), "
    "cl AS (SELECT ge.g, array_to_string(ge.items, '|') AS gen, ge.s, coalesce(string_agg(ci.item, '|' ORDER BY ci.item), '') AS closure FROM ge LEFT JOIN ci ON ci.g = ge.g AND ci.items = ge.items GROUP BY ALL) "
)

Q: dict = {}
S: dict = {}


def _t1(spark, d):
    return itemsets.as_database(fx.customers(spark, d))


def _mine1(spark, d, side="ceil", sigma="0.01", **kw):
    return itemsets.mine(_t1(spark, d), sigma, side, **kw)


def _drop(df):
    return df.drop("g")


def _triples(spark, d):
    """All triples of brands, as patterns to be counted."""
    b = load(spark, d, "part").select("p_brand").distinct()
    x, y, z = (b.withColumnRenamed("p_brand", c) for c in "xyz")
    return x.join(y, F.col("x") < F.col("y")).join(z, F.col("y") < F.col("z")).select(F.concat_ws("|", "x", "y", "z").alias("items"))


L1 = levels_sql(T1, m_sql("0.01"))
Q["minimal_generators"] = lambda spark, d: _drop(itemsets.minimal_generators(_mine1(spark, d)))
S["minimal_generators"] = L1 + rows_sql("gn") + EMPTY
for _side in ("floor", "ceil", "round"):
    Q[f"minimal_generators_{_side}"] = lambda spark, d, side=_side: _drop(itemsets.minimal_generators(_mine1(spark, d, side, "0.0053"), "never"))
    S[f"minimal_generators_{_side}"] = levels_sql(T1, m_sql("0.0053", _side)) + rows_sql("gn")
Q["minimal_generators_words"] = lambda spark, d: _drop(itemsets.minimal_generators(itemsets.mine(itemsets.as_database(fx.document_words(spark, d)), "0.3"), "no_full_support_item"))
S["minimal_generators_words"] = levels_sql(K1, m_sql("0.3")) + rows_sql("gn") + " UNION ALL SELECT '', 0, n FROM p WHERE n > (SELECT max(s) FROM i1)"
Q["frequent_itemsets"] = lambda spark, d: _drop(itemsets.frequent_itemsets(_mine1(spark, d, generators=False)))
S["frequent_itemsets"] = L1 + rows_sql("fr")
Q["pascal_tagged"] = lambda spark, d: _drop(itemsets.tagged_itemsets(_mine1(spark, d, generators=False)))
S["pascal_tagged"] = L1 + rows_sql("fr", ", (g, items) IN (SELECT (g, items) FROM gn) AS is_generator")
Q["closures"] = lambda spark, d: _drop(itemsets.generator_closures(_mine1(spark, d, closures=True)))
S["closures"] = L1 + CLOSE + "SELECT gen AS generator, closure, s AS support FROM cl"
Q["closed_itemsets"] = lambda spark, d: _drop(itemsets.closed_itemsets(_mine1(spark, d, closures=True)))
S["closed_itemsets"] = L1 + CLOSE + "SELECT DISTINCT closure AS items, s AS support FROM cl"
Q["generator_closure_pairs"] = lambda spark, d: _drop(itemsets.equivalence_classes(_mine1(spark, d, closures=True)))
S["generator_closure_pairs"] = L1 + CLOSE + "SELECT closure, s AS support, count(*) AS n_generators, string_agg(gen, ' ; ' ORDER BY gen) AS generators FROM cl GROUP BY closure, s"
Q["exact_rules"] = lambda spark, d: _drop(itemsets.exact_rules(_mine1(spark, d, closures=True)))
S["exact_rules"] = L1 + CLOSE + "SELECT array_to_string(items, '|') AS antecedent, string_agg(item, '|' ORDER BY item) AS consequent, s AS support FROM ci WHERE NOT list_contains(items, item) GROUP BY items, s"


def _kfree_sql(tx: str, m: str, k: int) -> str:
    """A set is k-free if each way to leave out 1 to k of its items is the exact trace of some transaction on it."""
    return (
        levels_sql(tx, m) + ", ba AS (SELECT g, tid, list(item) AS b FROM tx GROUP BY g, tid), tr AS (SELECT DISTINCT fr.g, fr.items, fr.k, fr.s, list_filter(fr.items, lambda x: list_contains(ba.b, x)) AS trace FROM fr JOIN ba USING (g)), "
        f"va AS (SELECT fr.*, coalesce(list_sum([list_product([(fr.k - i)::DOUBLE / (i + 1) for i in range(j)]) for j in range(1, least(fr.k, {k}) + 1)]), 0) AS want FROM fr), "
        f"kf AS (SELECT va.g, va.items, va.k, va.s FROM va LEFT JOIN tr ON tr.g = va.g AND tr.items = va.items AND va.k - len(tr.trace) BETWEEN 1 AND {k} GROUP BY va.g, va.items, va.k, va.s, va.want HAVING count(tr.trace) = round(va.want)) "
        + rows_sql("kf") + EMPTY
    )


def _types(spark, d, sigma="0.3", **kw):
    return itemsets.mine(itemsets.as_database(fx.order_types(spark, d)), sigma, **kw)


Q["disjunction_free"] = lambda spark, d: _drop(itemsets.k_free(_mine1(spark, d), 2))
S["disjunction_free"] = _kfree_sql(T1, m_sql("0.01"), 2)
Q["kfree_3"] = lambda spark, d: _drop(itemsets.k_free(_mine1(spark, d), 3))
S["kfree_3"] = _kfree_sql(T1, m_sql("0.01"), 3)
Q["positive_border"] = lambda spark, d: _drop(itemsets.positive_border(_mine1(spark, d)))
S["positive_border"] = L1 + (
    ", bo AS (SELECT g, k, items, s, min(items[i]) FILTER (low = s) AS r, bool_and(less = [] OR (g, less) IN (SELECT (g, items) FROM gn)) AS ok FROM lo GROUP BY g, k, items, s) " + rows_sql("bo", ", r AS redundant_item", " WHERE ok AND r IS NOT NULL")
)
# infrequent items, and infrequent sets (of support 0 too) all of whose immediate subsets are frequent generators
_NEG = (
    ", ca AS (SELECT gn.g, gn.k + 1 AS k, gn.items AS head, f1.item, list_append(gn.items, f1.item) AS items FROM gn JOIN f1 ON f1.g = gn.g AND f1.item > gn.items[-1] WHERE (gn.g, list_append(gn.items, f1.item)) NOT IN (SELECT (g, items) FROM fr)), "
    "cs AS (SELECT * FROM (SELECT *, list_filter(items, lambda x, j: j <> i) AS less FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM ca))), "
    "cg AS (SELECT cs.g, cs.k, cs.head, cs.item, cs.items FROM cs JOIN gn ON gn.g = cs.g AND gn.items = cs.less GROUP BY ALL HAVING count(*) = cs.k), "
    "nb AS (SELECT g, 1 AS k, [item] AS items, s FROM i1 JOIN p USING (g) WHERE s < m UNION ALL SELECT cg.g, cg.k, cg.items, count(tx.tid) FROM cg LEFT JOIN cov ON cov.g = cg.g AND cov.items = cg.head LEFT JOIN tx ON tx.g = cov.g AND tx.tid = cov.tid AND tx.item = cg.item GROUP BY ALL) "
)
Q["negative_border"] = lambda spark, d: _drop(itemsets.negative_border(_mine1(spark, d)))
S["negative_border"] = L1 + _NEG + rows_sql("nb")
Q["minimal_rare"] = lambda spark, d: _drop(itemsets.minimal_rare(itemsets.mine(itemsets.as_database(fx.order_brands(spark, d)), "0.02")))
S["minimal_rare"] = levels_sql(T5, m_sql("0.02")) + _NEG + rows_sql("nb")
Q["minimal_rare_both_sides"] = lambda spark, d: (
    _drop(itemsets.minimal_rare(_mine1(spark, d, "floor", "0.0053"))).withColumn("side", F.lit("floor")).unionAll(_drop(itemsets.minimal_rare(_mine1(spark, d, "ceil", "0.0053"))).withColumn("side", F.lit("ceil")))
)
S["minimal_rare_both_sides"] = " UNION ALL ".join("SELECT *, '" + s + "' AS side FROM (" + levels_sql(T1, m_sql("0.0053", s)) + _NEG + rows_sql("nb") + ")" for s in ("floor", "ceil"))
Q["cover_items"] = lambda spark, d: _drop(itemsets.cover_items(_types(spark, d, max_size=1)))
S["cover_items"] = f"WITH tx AS ({T4}) SELECT item FROM tx GROUP BY item HAVING count(*) = (SELECT count(DISTINCT tid) FROM tx)"
Q["recover_frequent"] = lambda spark, d: _drop(itemsets.recover_frequent(_mine1(spark, d)))
S["recover_frequent"] = S["frequent_itemsets"]
Q["recover_frequent_positive"] = lambda spark, d: _drop(itemsets.recover_frequent_positive(_mine1(spark, d)))
S["recover_frequent_positive"] = S["frequent_itemsets"]


def _lookup(spark, d):
    """Supports of all pairs of items of the database, read off generators and negative border."""
    m = _mine1(spark, d)
    one = m.singles.select("g", "item")
    pairs = one.join(one.withColumnRenamed("item", "other"), "g").where("item < other").select("g", F.concat_ws("|", "item", "other").alias("items"))
    return _drop(itemsets.lookup_support(m, pairs))


Q["lookup_support"] = _lookup
S["lookup_support"] = L1 + "SELECT x.item || '|' || y.item AS items, fr.s AS support FROM i1 x JOIN i1 y ON x.g = y.g AND x.item < y.item LEFT JOIN fr ON fr.g = x.g AND fr.items = [x.item, y.item]"
Q["itemset_support"] = lambda spark, d: itemsets.itemset_support(itemsets.as_database(fx.order_brands(spark, d)), _triples(spark, d))
S["itemset_support"] = (
    f"WITH tx AS ({T5}), b AS (SELECT DISTINCT p_brand AS x FROM part), q AS (SELECT u.x AS a, v.x AS b, w.x AS c FROM b u JOIN b v ON u.x < v.x JOIN b w ON v.x < w.x) "
    "SELECT a || '|' || b || '|' || c AS items, count(x.tid) AS support FROM q LEFT JOIN (SELECT x.tid, x.item AS i, y.item AS j, z.item AS k FROM tx x JOIN tx y ON x.tid = y.tid AND x.item < y.item JOIN tx z ON z.tid = x.tid AND y.item < z.item) x ON x.i = a AND x.j = b AND x.k = c GROUP BY ALL"
)

# ------------------------------------------------------------------ utilities


def _theta(util, share: int) -> int:
    return (util.agg(F.sum("util")).first()[0] or 0) // share


def _hug(spark, d, share, fun, **kw):
    u = cut(utility.utility_database(fx.order_utilities(spark, d, "p_brand")))
    theta = _theta(u, share)
    return fun(utility.mine_utilities(u, theta, **kw), theta)


_UL = levels_sql("SELECT tid, item FROM u", "1").replace("WITH RECURSIVE tx AS", f"WITH RECURSIVE u AS ({U2}), tx AS", 1)
_TH = "(SELECT CAST(sum(util) AS BIGINT) // {} FROM u)"
_UT = (
    ", ut AS (SELECT array_to_string({p}.items, '|') AS items, {p}.k, {p}.items AS l, {p}.s AS support, CAST(sum(u.util) AS BIGINT) AS utility FROM {p} JOIN cov ON cov.items = {p}.items "
    "JOIN u ON u.tid = cov.tid AND list_contains({p}.items, u.item) GROUP BY ALL) "
)
Q["high_utility_generators"] = lambda spark, d: _hug(spark, d, 150, utility.high_utility_generators)
S["high_utility_generators"] = _UL + _UT.format(p="gn") + f"SELECT items, support, utility FROM ut WHERE utility >= {_TH.format(150)}"
Q["itemset_utility"] = lambda spark, d: _hug(spark, d, 10**15, utility.high_utility_generators)
S["itemset_utility"] = _UL + _UT.format(p="gn") + "SELECT items, support, utility FROM ut"
Q["utility_minimal"] = lambda spark, d: _hug(spark, d, 60, utility.utility_minimal, generators=False)
S["utility_minimal"] = (
    _UL + _UT.format(p="fr") + f", hi AS (SELECT * FROM ut WHERE utility >= {_TH.format(60)}), ha AS (SELECT DISTINCT h.items FROM (SELECT items, l, unnest(range(1, k + 1)) AS i FROM hi) h JOIN hi o ON o.l = list_filter(h.l, lambda x, j: j <> h.i)) "
    "SELECT items, support, utility FROM hi WHERE items NOT IN (SELECT items FROM ha)"
)
_GH = (
    _UL + CLOSE + ", gh AS (SELECT ci.items, ci.s AS support, CAST(sum(u.util) FILTER (list_contains(ci.items, ci.item)) AS BIGINT) AS utility, CAST(sum(u.util) AS BIGINT) AS closure_utility FROM ci JOIN cov ON cov.items = ci.items JOIN u ON u.tid = cov.tid AND u.item = ci.item GROUP BY ci.items, ci.s) "
)
Q["ghui"] = lambda spark, d: _hug(spark, d, 150, utility.ghui, closures=True)
S["ghui"] = _GH + f"SELECT array_to_string(items, '|') AS items, support, utility, closure_utility FROM gh WHERE closure_utility >= {_TH.format(150)}"


def _ghui_to_hug(spark, d):
    u = cut(utility.utility_database(fx.order_utilities(spark, d, "p_brand")))
    theta = _theta(u, 150)
    return utility.ghui(utility.mine_utilities(u, theta, closures=True), theta).where(F.col("utility") >= theta).select("items", "support", "utility")


Q["ghui_postfilter_hug"] = _ghui_to_hug
S["ghui_postfilter_hug"] = S["high_utility_generators"]
Q["pairs_to_generators"] = lambda spark, d: itemsets.generator_closures(_mine1(spark, d, closures=True)).select(F.col("generator").alias("items"), "support")
S["pairs_to_generators"] = L1 + "SELECT items, support FROM (" + rows_sql("gn") + EMPTY + ")"
Q["pairs_to_closed"] = lambda spark, d: itemsets.generator_closures(_mine1(spark, d, closures=True)).select(F.col("closure").alias("items"), "support").distinct()
S["pairs_to_closed"] = L1 + CLOSE + "SELECT DISTINCT closure AS items, s AS support FROM cl"
Q["transaction_weighted_utility"] = lambda spark, d: utility.transaction_weighted_utility(utility.utility_database(fx.order_utilities(spark, d, "p_brand")))
S["transaction_weighted_utility"] = f"WITH u AS ({U2}), t AS (SELECT tid, sum(util) AS tu FROM u GROUP BY tid) SELECT item, CAST(sum(tu) AS BIGINT) AS twu FROM u JOIN t USING (tid) GROUP BY item"

# ------------------------------------------------------------------ sequences

_EV = "ev AS (SELECT user_id * 100000 + datediff('day', DATE '1970-01-01', CAST(ts AT TIME ZONE 'UTC' AS DATE)) AS sid, event_type AS e, row_number() OVER (PARTITION BY user_id, CAST(ts AT TIME ZONE 'UTC' AS DATE) ORDER BY ts, event_id) AS pos FROM events)"
# earliest end of each frequent pattern in each sequence, of all lengths
_SQ = (
    f"WITH RECURSIVE {_EV}, n AS (SELECT count(DISTINCT sid) AS n, greatest(1, (count(DISTINCT sid) + 49) // 50) AS m FROM ev), "
    "st AS (SELECT e, sid, min(pos) AS pos, m FROM ev, n GROUP BY e, sid, m), cov(k, items, sid, pos, m) AS (SELECT 1, [e], sid, pos, m FROM st QUALIFY count(*) OVER (PARTITION BY e) >= m UNION ALL SELECT * FROM (SELECT k + 1, list_append(items, y.e), cov.sid, min(y.pos), m FROM cov JOIN ev y ON y.sid = cov.sid AND y.pos > cov.pos GROUP BY ALL) "
    "t(k, items, sid, pos, m) QUALIFY count(*) OVER (PARTITION BY items) >= m), fr AS (SELECT k, items, count(*) AS s FROM cov GROUP BY ALL) "
)
_S2 = (
    f"WITH {_EV}, s1 AS (SELECT e AS a, count(DISTINCT sid) AS s FROM ev GROUP BY e), s2 AS (SELECT x.e AS a, y.e AS b, count(DISTINCT x.sid) AS s FROM ev x JOIN ev y ON x.sid = y.sid AND x.pos < y.pos GROUP BY ALL) "
)


def _seq_min(data):
    return max(1, -(-data.count() // 50))


def _patterns(spark, d):
    s = cut(fx.event_sequences(spark, d))
    return sequences.sequential_patterns(s, _seq_min(s)).select("pattern", "length", "support")


def _seq_gens(spark, d):
    s = cut(fx.event_sequences(spark, d))
    return sequences.sequential_generators(s, _seq_min(s))


def _seq_support(spark, d):
    s = cut(fx.event_sequences(spark, d))
    types = s.select(F.explode(F.flatten("sequence")).alias("e")).distinct()
    two = types.select(F.col("e").alias("a")).join(types.select(F.col("e").alias("b")), F.col("a") <= F.col("b"))  # the few event types
    return sequences.sequence_support(s, two.select(F.array(F.array("a"), F.array("b")).alias("sequence")))


Q["sequential_patterns"] = _patterns
S["sequential_patterns"] = _SQ + "SELECT array_to_string(items, ' > ') AS pattern, k AS length, s AS support FROM fr"
Q["sequential_generators"] = _seq_gens
S["sequential_generators"] = (
    _SQ + ", su AS (SELECT fr.items, fr.k, fr.s, list_filter(fr.items, lambda x, j: j <> i) AS less FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM fr) fr), "
    "lo AS (SELECT su.items, su.k, su.s, coalesce(f.s, n.n) AS low FROM su CROSS JOIN n LEFT JOIN fr f ON f.items = su.less) SELECT array_to_string(items, ' > ') AS pattern, k AS length, s AS support FROM lo GROUP BY items, k, s HAVING min(low) > s"
)
Q["sequence_support"] = _seq_support
S["sequence_support"] = _S2 + "SELECT x.a || ' > ' || y.a AS pattern, coalesce(s2.s, 0) AS support FROM s1 x JOIN s1 y ON x.a <= y.a LEFT JOIN s2 ON s2.a = x.a AND s2.b = y.a"

# ------------------------------------------------------------------ windows

_WD = "SELECT DISTINCT user_id * 100000 + datediff('day', DATE '1970-01-01', CAST(ts AT TIME ZONE 'UTC' AS DATE)) AS tid, datediff('day', DATE '1970-01-01', CAST(ts AT TIME ZONE 'UTC' AS DATE)) AS day, event_type AS item FROM events"


def _window_tx(size: int, slide: int) -> str:
    return f"SELECT tid, item, unnest(generate_series((day - {size} - (((day - {size}) % {slide}) + {slide}) % {slide}) + {slide}, day - day % {slide}, {slide})) AS w FROM ({_WD})"


def _window_sql(size: int, slide: int, m: int) -> str:
    return levels_sql(_window_tx(size, slide), str(m), "w") + "SELECT g AS window_id, array_to_string(items, '|') AS items, k AS size, s AS support FROM gn"


Q["windowed_generators_tumbling"] = lambda spark, d: windows.windowed_generators(fx.user_days(spark, d), "day", 7, 7, 5)
S["windowed_generators_tumbling"] = _window_sql(7, 7, 5)
Q["windowed_generators_sliding"] = lambda spark, d: windows.windowed_generators(fx.user_days(spark, d), "day", 6, 2, 8)
S["windowed_generators_sliding"] = _window_sql(6, 2, 8)
Q["windowed_closures"] = lambda spark, d: windows.windowed_closures(fx.user_days(spark, d), "day", 7, 7, 5)
S["windowed_closures"] = levels_sql(_window_tx(7, 7), "5", "w") + CLOSE + "SELECT g AS window_id, gen AS generator, closure, s AS support FROM cl"


def _streamed(spark, d):
    """Generators of event-time days from a finished stream over the events table, late rows included up to the watermark."""
    # a pattern, as a stream's path may be a folder or a pattern but no single file
    events = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    streams.start(events, f"{out}/rows", f"{out}/state", 5, tid="user_id", item="event_type", size="7 days", slide="7 days", once=True).awaitTermination()
    return spark.read.schema("window_start timestamp, items string, size int, support long").option("recursiveFileLookup", "true").parquet(f"{out}/rows").select(F.datediff(F.col("window_start").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("window_day"), "items", "size", "support")


Q["streamed_generators"] = _streamed
S["streamed_generators"] = levels_sql("SELECT DISTINCT user_id AS tid, event_type AS item, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7 * 7 AS w FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL", "5", "w") + (
    "SELECT g AS window_day, array_to_string(items, '|') AS items, k AS size, s AS support FROM gn WHERE DATE '1970-01-01' + CAST(g + 7 AS INTEGER) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
)

# ------------------------------------------------------------------ audit


def _audit(spark, d):
    m = _mine1(spark, d)
    gens = cut(_drop(itemsets.minimal_generators(m, "never")))
    freq = _drop(itemsets.frequent_itemsets(_mine1(spark, d, generators=False)))
    return audit.audit_generators(_t1(spark, d), freq.select("items", "support"), gens)


Q["audit_generators"] = _audit
S["audit_generators"] = L1 + "SELECT array_to_string(items, '|') AS items, unnest(['not_minimal', 'extra']) AS finding FROM fr WHERE items NOT IN (SELECT items FROM gn)"


def _audit_pairs(spark, d):
    """Pairs of which each generator is claimed to be its own closure: those with a larger closure are found."""
    m = _mine1(spark, d, closures=True)
    given = _drop(itemsets.minimal_generators(m, "never")).select(F.col("items").alias("generator"), F.col("items").alias("closure"))
    return audit.audit_closures(m, given)


Q["audit_closures"] = _audit_pairs
S["audit_closures"] = L1 + CLOSE + "SELECT gen AS generator, CASE WHEN gen = '' THEN closure ELSE gen END AS closure, CASE WHEN gen = '' THEN 'missing' ELSE 'bad_closure' END AS finding FROM cl WHERE gen = '' OR gen <> closure"
Q["pattern_set_diff"] = lambda spark, d: audit.pattern_set_difference(_drop(itemsets.minimal_generators(_mine1(spark, d, "floor", "0.0053"), "never")), _drop(itemsets.minimal_generators(_mine1(spark, d, "ceil", "0.0053"), "never")))
S["pattern_set_diff"] = (
    f"WITH a AS ({S['minimal_generators_floor']}), b AS ({S['minimal_generators_ceil']}) SELECT items, CASE WHEN b.items IS NULL THEN 'only_left' WHEN a.items IS NULL THEN 'only_right' ELSE 'support' END AS side, "
    "a.support AS left_support, b.support AS right_support FROM a FULL JOIN b USING (items) WHERE a.support IS DISTINCT FROM b.support"
)

# ------------------------------------------------------------------ profiling


def _r(df, skip=()):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


def _order_db(spark, d):
    return itemsets.as_database(fx.order_brands(spark, d))


Q["tx_from_attributes"] = lambda spark, d: fx.customers(spark, d)
S["tx_from_attributes"] = T1
Q["tx_from_long"] = lambda spark, d: fx.order_brands(spark, d)
S["tx_from_long"] = T5
Q["item_dictionary"] = lambda spark, d: fx.frequency_order(fx.customers(spark, d))
S["item_dictionary"] = f"WITH tx AS ({T1}) SELECT item, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, item) AS id FROM tx GROUP BY item"
Q["item_support"] = lambda spark, d: profile.item_supports(_order_db(spark, d))
S["item_support"] = f"SELECT item, count(*) AS support FROM ({T5}) GROUP BY item"
Q["pair_support"] = lambda spark, d: profile.pair_supports(_order_db(spark, d))
S["pair_support"] = f"WITH tx AS ({T5}) SELECT x.item AS a, y.item AS b, count(*) AS support FROM tx x JOIN tx y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL"
Q["itemset_support_bitmap"] = lambda spark, d: profile.bitmap_support(itemsets.as_database(fx.order_types(spark, d)), ["ECONOMY", "PROMO"], F.col("tid") + 1)
S["itemset_support_bitmap"] = f"SELECT count(*) AS support FROM (SELECT tid FROM ({T4}) WHERE item IN ('ECONOMY', 'PROMO') GROUP BY tid HAVING count(*) = 2)"
Q["dataset_stats"] = lambda spark, d: _r(profile.dataset_stats(_order_db(spark, d)))
S["dataset_stats"] = f"WITH tx AS ({T5}) SELECT count(DISTINCT tid) AS n_tx, count(DISTINCT item) AS n_items, round(count(*) / count(DISTINCT tid), 6) AS avg_len, (SELECT max(k) FROM (SELECT count(*) AS k FROM tx GROUP BY tid)) AS max_len FROM tx"
Q["meta_features"] = lambda spark, d: _r(profile.meta_features(_order_db(spark, d)))
S["meta_features"] = (
    f"WITH tx AS ({T5}), l AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM tx GROUP BY tid), o AS (SELECT count(*) AS n, avg(k) AS al, max(k) AS ml, avg(k * k) AS sq FROM l), i AS (SELECT count(*) AS s FROM tx GROUP BY item), "
    "t AS (SELECT CAST(sum(s) AS BIGINT) AS al2, count(*) AS ni, max(s) AS top FROM i), g AS (SELECT CAST(sum((2 * r - ni + 1) * s) AS BIGINT) AS num FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM i), t), e AS (SELECT sum(-(s / al2) * ln(s / al2)) AS ent FROM i, t) "
    "SELECT n AS n_tx, ni AS n_items, round(log10(n), 6) AS log_n_tx, round(log10(ni), 6) AS log_n_items, round(al, 6) AS avg_len, ml AS max_len, round(sqrt(greatest(sq - al * al, 0)) / al, 6) AS len_cv, round(al / ni, 6) AS density, "
    "round(log10(greatest(al / ni, 1e-9)), 6) AS log_density, round(num / (ni * al2), 6) AS sup_gini, round(ent / ln(ni), 6) AS sup_entropy, round(top / n, 6) AS max_sup_ratio FROM o, t, g, e"
)
_GRID = "(VALUES (0.01), (0.02), (0.05), (0.2))"
_LM = (
    f"WITH tx AS ({T1}), n AS (SELECT count(DISTINCT tid) AS n FROM tx), mu AS (SELECT CAST(col0 AS DOUBLE) AS sigma, n, greatest(CAST(col0 AS DOUBLE) * n, 1.0) AS mu FROM GRID, n), i AS (SELECT item, count(*) AS s FROM tx GROUP BY item), "
    "p AS (SELECT x.item AS a, y.item AS b, count(*) AS s FROM tx x JOIN tx y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL), pg AS (SELECT p.s, p.s < least(u.s, v.s) AS gen FROM p JOIN i u ON u.item = a JOIN i v ON v.item = b), "
    "k AS (SELECT sigma, n, mu, count(*) AS ni, count(*) FILTER (s < mu) AS below, count(*) FILTER (s >= mu) AS f1, coalesce(sum(s) FILTER (s >= mu), 0) AS mass, sum(s) AS al, max(s) AS top, count(*) FILTER (s >= mu AND s < 2 * mu) AS edge FROM i, mu GROUP BY sigma, n, mu), "
    "q AS (SELECT sigma, count(*) FILTER (s >= mu) AS f2, count(*) FILTER (s >= mu AND gen) AS g2 FROM pg, mu GROUP BY sigma) "
)
Q["landmarks_sigma_grid"] = lambda spark, d: _r(profile.landmarks(_t1(spark, d), [0.01, 0.02, 0.05, 0.2]), skip=("sigma",))
S["landmarks_sigma_grid"] = (
    _LM.replace("GRID", f"{_GRID} v(col0)") + "SELECT sigma, round(below / ni, 6) AS thr_pctile, round(log10(mu / greatest(top, 1)), 6) AS log_thr_rel, round(log10(mu), 6) AS log_thr_abs, round(log10(1 + f1), 6) AS log_n_freq1, round(f1 / ni, 6) AS frac_freq1, "
    "round(mass / greatest(al, 1), 6) AS freq_sup_mass, round(edge / ni, 6) AS boundary_frac, round(mass / n, 6) AS avg_len_freq, round(CASE WHEN f1 <> 0 THEN mass / n / f1 ELSE 0 END, 6) AS density_freq, round(log10(1 + f2), 6) AS log_n_freq2, "
    "round(CASE WHEN f1 * (f1 - 1) <> 0 THEN f2 / (f1 * (f1 - 1) / 2) ELSE 0 END, 6) AS pair_density, round(CASE WHEN f2 > 0 THEN g2 / f2 ELSE 0 END, 6) AS n_gen2_frac, round(CASE WHEN f2 > 0 THEN 1 - g2 / f2 ELSE 0 END, 6) AS collapse_frac, "
    "round(log10((1 + f2) / (1 + f1)), 6) AS log_lattice_ratio FROM k JOIN q USING (sigma)"
)
_PF = _LM.replace("GRID", "(VALUES (0.5), (0.2), (0.1), (0.05), (0.02), (0.01)) v(col0)")
_PF_ROWS = "SELECT sigma, f1 AS frequent_items, f2 AS frequent_pairs, round(CASE WHEN f2 > 0 THEN 100 * g2 / f2 ELSE 0 END, 6) AS generator_pair_pct FROM k JOIN q USING (sigma)"
Q["support_profile"] = lambda spark, d: _r(profile.support_profile(_t1(spark, d)), skip=("sigma",))
S["support_profile"] = _PF + _PF_ROWS
Q["suggest_threshold"] = lambda spark, d: profile.suggest_threshold(profile.support_profile(_t1(spark, d)), 100)
S["suggest_threshold"] = _PF + f", f AS ({_PF_ROWS}) SELECT sigma, frequent_pairs FROM f WHERE sigma = coalesce((SELECT max(sigma) FROM f WHERE frequent_pairs >= 100), (SELECT min(sigma) FROM f))"
Q["kth_support_threshold"] = lambda spark, d: _r(profile.kth_support_threshold(_order_db(spark, d), 10))
S["kth_support_threshold"] = f"WITH tx AS ({T5}), i AS (SELECT count(*) AS s FROM tx GROUP BY item), k AS (SELECT min(s) AS sup_k FROM (SELECT s FROM i ORDER BY s DESC LIMIT 10)) SELECT sup_k, round(0.999 * sup_k / (SELECT count(DISTINCT tid) FROM tx), 6) AS sigma FROM k"
Q["sigma_for_pairs"] = lambda spark, d: _r(profile.sigma_for_pairs(_order_db(spark, d), 100))
S["sigma_for_pairs"] = (
    f"WITH tx AS ({T5}), p AS (SELECT count(*) AS s FROM tx x JOIN tx y ON x.tid = y.tid AND x.item < y.item GROUP BY x.item, y.item), k AS (SELECT greatest(min(s), 10) AS sup_abs FROM (SELECT s FROM p ORDER BY s DESC LIMIT 100)) "
    "SELECT sup_abs, round((sup_abs - 0.25) / (SELECT count(DISTINCT tid) FROM tx), 6) AS sigma FROM k"
)
QUERIES, ORACLE = Q, S
