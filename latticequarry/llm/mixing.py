"""Mixing sources to target weights.

Method: weighted fair queueing. Each shuffled document gets a virtual finish time, the
cumulative tokens of its source divided by the source's weight; documents of all sources
are range-sorted by it and cut off at the total budget. A document that crosses the end is
passed over and later ones of its source that still fit take its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

PER_BUCKET = 20_000


def source_key(c: Column) -> Column:
    """A source's name without differences of case, blanks and underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def plan(documents: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """(source, weight, max_repeats, total, budget): weights of the sources that have tokens, and the budget of the whole mixture.

    Without a budget the largest one is taken that no source has to exceed its repeats for; a larger
    one is reduced to it. Targets without tokens are left out and the other shares scaled to 1.
    """
    total = documents.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs"))
    t = targets.where("target_share > 0 AND max_repeats >= 1").groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(total.where("total > 0"), "source")
    most = t.agg(F.sum("share").alias("all"), F.min(F.col("max_repeats") * F.col("total") / F.col("share")).alias("b"))
    both = t.crossJoin(F.broadcast(most))  # one row
    weight = F.col("share") / F.col("all")
    limit = F.col("b") * F.col("all")
    return both.select("source", weight.alias("weight"), "max_repeats", "total", "docs", (F.least(limit, F.lit(float(budget))) if budget is not None else limit).alias("budget"))


def _running(rows: DataFrame) -> DataFrame:
    """rows with run: tokens of the source up to and including the row, in order of (repeat, h, doc_id).

    Prefix sums run in two steps, over hash buckets and within them, so a source of any size stays spread out.
    """
    sums = rows.groupBy("source", "repeat", "bucket").agg(F.sum("tokens").alias("t"))
    over = Window.partitionBy("source").orderBy("repeat", "bucket")
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "repeat", "bucket").orderBy("h", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.sum("tokens").over(inside)).join(before, ["source", "repeat", "bucket"]).withColumn("run", F.col("before") + F.col("part")).drop("part", "before")


def mixture(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, repeat, tokens, finish): the mixture in order of virtual finish time.

    documents: (doc_id, source, tokens); a repeated id is a document of its own. A source is repeated only after all its
    documents were used, at most max_repeats times in all. Sources that no target names (null ones too) and documents
    without tokens are left out. No source exceeds its share of the budget; what it lacks is less than its smallest
    document that is left in the last repeat (see shares).
    """
    named = documents.select("doc_id", source_key(F.col("source")).alias("source"), "tokens").where("tokens > 0 AND source IS NOT NULL")
    p = cut(plan(named, targets, budget))
    # one row per target source
    docs = named.join(F.broadcast(p), "source").withColumn("copy", F.monotonically_increasing_id())
    due = F.floor(F.col("budget") * F.col("weight") * (1 + 1e-12)).cast("long")
    uses = F.least(F.col("max_repeats"), F.ceil(due / F.col("total")).cast("int"))
    rows = docs.withColumn("due", due).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), uses))))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "repeat", F.lit(seed)), 1)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / PER_BUCKET)).cast("long")
    rows = rows.withColumn("h", h).withColumn("bucket", F.floor(F.col("h") / (F.lit(float(1 << 63)) / buckets)).cast("long"))
    ran = cut(_running(rows.select("source", "doc_id", "copy", "tokens", "repeat", "h", "bucket", "weight", "due")))
    taken = [ran.where("run <= due")]
    # the rest of the repeat in which the share ends: what fits goes in, in the same order, until nothing does
    ends = ran.where("run > due").groupBy("source").agg(F.min("repeat").alias("last"))
    rest = ran.where("run > due").join(F.broadcast(ends), "source").where("repeat = last").drop("last", "run")  # one row per source
    while True:
        got = taken[-1].groupBy("source").agg(F.max("run").alias("got"))
        if len(taken) > 1:
            got = level.join(got, "source", "left").select("source", F.col("level") + F.coalesce("got", F.lit(0)))
        level = cut(p.select("source").join(got.toDF("source", "got"), "source", "left").select("source", F.coalesce("got", F.lit(0)).alias("level")))
        rest = cut(_running(rest.drop("run", "level").join(F.broadcast(level), "source").where("tokens <= due - level")))  # one row per source
        fits = rest.where("run <= due - level")
        if fits.isEmpty():
            break
        taken.append(fits)
        rest = rest.where("run > due - level")
    cols = ["doc_id", "source", "repeat", "tokens"]
    out = taken[0].select(*cols, (F.col("run") / F.col("weight")).alias("finish"))
    for t in taken[1:]:
        out = out.unionAll(t.select(*cols, ((F.col("level") + F.col("run")) / F.col("weight")).alias("finish")))
    return out.orderBy("finish", "doc_id")


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, repeats, actual_share, smallest_left) of every target source.

    smallest_left: tokens of the source's smallest document that its last repeat didn't use, null if none is left; where a
    source lies below its target, this document didn't fit any more.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    g = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("repeat").alias("repeats"))
    all_ = mixed.agg(F.sum("tokens").alias("all"))
    own = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.col("tokens").alias("size")).where("size > 0")
    used = mixed.join(F.broadcast(g.select("source", F.col("repeats").alias("repeat"))), ["source", "repeat"], "left_semi").select("source", "doc_id")  # one row per source
    left = own.join(used, ["source", "doc_id"], "left_anti").groupBy("source").agg(F.min("size").alias("smallest_left"))
    out = t.join(g, "source", "left").join(left, "source", "left").crossJoin(F.broadcast(all_))  # one row
    return out.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), "smallest_left")
