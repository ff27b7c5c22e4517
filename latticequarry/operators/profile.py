"""Dataset analytics: statistics, meta-features, landmarks and threshold calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def item_supports(db: DataFrame) -> DataFrame:
    """(item, support)."""
    return db.groupBy("item").agg(F.count("*").alias("support"))


def pair_supports(db: DataFrame) -> DataFrame:
    """(a, b, support) of all item pairs a < b that occur together.

    Pairs are made within each basket and combined before the shuffle; transactions aren't joined.
    """
    baskets = db.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("s")).groupBy("s").agg(F.count("*").alias("w"))
    left = baskets.select("w", F.posexplode("s").alias("p", "a"), "s").select("w", "a", F.expr("slice(s, p + 2, size(s))").alias("rest"))
    return left.select("w", "a", F.explode("rest").alias("b")).groupBy("a", "b").agg(F.sum("w").alias("support"))


def dataset_stats(db: DataFrame) -> DataFrame:
    """(n_tx, n_items, avg_len, max_len), one row."""
    per = db.groupBy("tid").agg(F.count("*").alias("len")).agg(F.count("*").alias("n_tx"), F.avg("len").alias("avg_len"), F.max("len").alias("max_len"))
    items = db.agg(F.countDistinct("item").alias("n_items"))
    return per.crossJoin(F.broadcast(items)).select("n_tx", "n_items", "avg_len", "max_len")  # one row each


def meta_features(db: DataFrame) -> DataFrame:
    """The 12 dataset features, one row; an empty database has n_tx 0 and nulls."""
    lens = db.groupBy("tid").agg(F.count("*").cast("double").alias("len"))
    one = lens.agg(F.count("*").alias("n_tx"), F.avg("len").alias("avg_len"), F.max("len").alias("max_len"), F.avg(F.col("len") * F.col("len")).alias("sq"))
    sup = item_supports(db)
    total = sup.agg(F.sum("support").alias("all"), F.count("*").alias("n_items"), F.max("support").alias("top"))
    # rank by support over distinct supports with their number of items, so the sort holds few rows
    by = sup.groupBy("support").agg(F.count("*").alias("k"))
    w = Window.orderBy("support").rowsBetween(Window.unboundedPreceding, -1)
    place = by.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    # sum over the k equal items of (2 i - I + 1) for i = before .. before + k - 1
    g = place.crossJoin(F.broadcast(total)).agg(
        F.sum(F.col("support") * (F.col("k") * (2 * F.col("before") + F.col("k") - 1) - F.col("k") * (F.col("n_items") - 1))).alias("num"),
        F.sum(-F.col("k") * (F.col("support") / F.col("all")) * F.log(F.col("support") / F.col("all"))).alias("ent"),
    )
    r = one.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(g))
    n_items = F.greatest(F.col("n_items"), F.lit(1))
    density = F.col("avg_len") / n_items
    return r.select(
        "n_tx", n_items.alias("n_items"), F.log10("n_tx").alias("log_n_tx"), F.log10(n_items).alias("log_n_items"), "avg_len", "max_len",
        (F.sqrt(F.greatest(F.col("sq") - F.col("avg_len") * F.col("avg_len"), F.lit(0.0))) / F.col("avg_len")).alias("len_cv"), density.alias("density"), F.log10(F.greatest(density, F.lit(1e-9))).alias("log_density"),
        (F.col("num") / (n_items * F.col("all"))).alias("sup_gini"), F.when(n_items > 1, F.col("ent") / F.log(n_items)).otherwise(0.0).alias("sup_entropy"), (F.col("top") / F.col("n_tx")).alias("max_sup_ratio"),
    )


def _sigmas(db: DataFrame, sigmas: list[float]) -> DataFrame:
    return db.sparkSession.createDataFrame([(float(s),) for s in sigmas], "sigma double")


def landmarks(db: DataFrame, sigmas: list[float]) -> DataFrame:
    """One row of landmarks per sigma; the threshold is max(sigma n, 1) as a real number.

    Items and pairs are counted once; the few sigmas are joined to their counts.
    """
    n = db.select("tid").distinct().agg(F.count("*").alias("n"))
    mu = _sigmas(db, sigmas).crossJoin(F.broadcast(n)).withColumn("mu", F.greatest(F.col("sigma") * F.col("n"), F.lit(1.0)))
    sup = item_supports(db)
    s, f = F.col("support"), F.col("support") >= F.col("mu")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by = sup.groupBy("support").agg(F.count("*").alias("k"))  # distinct supports only
    cnt = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    items = by.crossJoin(F.broadcast(mu)).groupBy("sigma", "n", "mu").agg(
        F.sum("k").alias("I"), cnt(~f).alias("below"), cnt(f).alias("f1"), F.sum(F.when(f, s * F.col("k")).otherwise(0)).alias("mass"), F.sum(s * F.col("k")).alias("all"), F.max(s).alias("top"), cnt(f & (s < 2 * F.col("mu"))).alias("edge")
    )
    pairs = pair_supports(db).join(sup.select(F.col("item").alias("a"), F.col("support").alias("sa")), "a").join(sup.select(F.col("item").alias("b"), F.col("support").alias("sb")), "b")
    gen = F.col("support") < F.least("sa", "sb")
    pk = pairs.groupBy("support", gen.alias("gen")).agg(F.count("*").alias("k"))
    p = pk.crossJoin(F.broadcast(mu.select("sigma", "mu"))).groupBy("sigma").agg(cnt(f).alias("f2"), cnt(f & F.col("gen")).alias("g2"))
    r = items.join(p, "sigma", "left").withColumns({"f2": F.coalesce("f2", F.lit(0)), "g2": F.coalesce("g2", F.lit(0))})
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    c = F.col
    return r.select(
        "sigma", (c("below") / c("I")).alias("thr_pctile"), F.log10(c("mu") / F.greatest(c("top"), F.lit(1))).alias("log_thr_rel"), F.log10("mu").alias("log_thr_abs"), F.log10(1 + c("f1")).alias("log_n_freq1"), (c("f1") / c("I")).alias("frac_freq1"),
        (c("mass") / F.greatest(c("all"), F.lit(1))).alias("freq_sup_mass"), (c("edge") / c("I")).alias("boundary_frac"), (c("mass") / c("n")).alias("avg_len_freq"), ratio(c("mass") / c("n"), c("f1")).alias("density_freq"), F.log10(1 + c("f2")).alias("log_n_freq2"),
        ratio(c("f2").cast("double"), c("f1") * (c("f1") - 1) / 2).alias("pair_density"), ratio(c("g2").cast("double"), c("f2")).alias("n_gen2_frac"), F.when(c("f2") > 0, 1 - c("g2") / c("f2")).otherwise(0.0).alias("collapse_frac"), F.log10((1 + c("f2")) / (1 + c("f1"))).alias("log_lattice_ratio"),
    )


PROFILE = [0.5, 0.2, 0.1, 0.05, 0.02, 0.01]


def support_profile(db: DataFrame, sigmas: list[float] | None = None) -> DataFrame:
    """(sigma, frequent_items, frequent_pairs, generator_pair_pct) over a list of thresholds."""
    r = landmarks(db, sigmas or PROFILE)
    back = lambda c: F.round(F.pow(F.lit(10.0), F.col(c)) - 1).cast("long")
    return r.select("sigma", back("log_n_freq1").alias("frequent_items"), back("log_n_freq2").alias("frequent_pairs"), (100 * F.col("n_gen2_frac")).alias("generator_pair_pct"))


def suggest_threshold(profile: DataFrame, least_pairs: int = 100) -> DataFrame:
    """(sigma, frequent_pairs): the largest sigma with enough frequent pairs, else the smallest of all."""
    enough = F.when(F.col("frequent_pairs") >= least_pairs, F.col("sigma"))
    one = profile.agg(F.max(enough).alias("a"), F.min("sigma").alias("b")).select(F.coalesce("a", "b").alias("sigma"))
    return profile.join(F.broadcast(one), "sigma").select("sigma", "frequent_pairs")  # one row


def _kth(supports: DataFrame, k: int) -> DataFrame:
    """The k-th largest support (the smallest if there are fewer), from counts of equal supports."""
    by = supports.groupBy("support").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.orderBy(F.desc("support")))
    return by.withColumn("run", run).agg(F.coalesce(F.max(F.when(F.col("run") >= k, F.col("support"))), F.min("support")).alias("sup_k"))


def kth_support_threshold(db: DataFrame, k: int) -> DataFrame:
    """(sup_k, sigma): sigma = 0.999 sup_k / n keeps the k most frequent items."""
    n = db.select("tid").distinct().agg(F.count("*").alias("n"))
    return _kth(item_supports(db), k).crossJoin(F.broadcast(n)).select("sup_k", (0.999 * F.col("sup_k") / F.col("n")).alias("sigma"))


def sigma_for_pairs(db: DataFrame, pairs: int, least: int = 10) -> DataFrame:
    """(sup_abs, sigma): threshold that leaves about `pairs` frequent pairs: the k-th largest pair support, at least `least`."""
    n = db.select("tid").distinct().agg(F.count("*").alias("n"))
    s = F.greatest(F.col("sup_k"), F.lit(least))
    return _kth(pair_supports(db), pairs).crossJoin(F.broadcast(n)).select(s.alias("sup_abs"), ((s - 0.25) / F.col("n")).alias("sigma"))


def bitmap_support(db: DataFrame, items: list[str], positions: Column) -> DataFrame:
    """(support) of one itemset by bitmaps: OR-ed per item and bucket, then ANDed by counting; positions start at 1."""
    few = db.where(F.col("item").isin(*items)).withColumn("p", positions)
    per = few.groupBy(F.expr("bitmap_bucket_number(p)").alias("b"), "item").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    if len(items) == 1:
        return per.agg(F.coalesce(F.sum(F.expr("bitmap_count(m)")), F.lit(0)).alias("support"))
    both = per.groupBy("b").agg(F.expr("bitmap_and_agg(m)").alias("m"), F.count("*").alias("k")).where(F.col("k") == len(set(items)))
    return both.agg(F.coalesce(F.sum(F.expr("bitmap_count(m)")), F.lit(0)).alias("support"))


def top_items(db: DataFrame, k: int) -> DataFrame:
    """(item, support, percent) of the k most frequent items, ties by name."""
    n = db.agg(F.countDistinct("tid").alias("n"))
    best = item_supports(db).orderBy(F.desc("support"), "item").limit(k)
    return best.crossJoin(F.broadcast(n)).select("item", "support", (100 * F.col("support") / F.col("n")).alias("percent"))  # one row
