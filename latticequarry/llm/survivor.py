"""Best representative of each duplicate group, field by field.

Method: fields are unpivoted to long rows, every usable value collects votes of source
trust times recency decay per normalised value, winners are chosen by max_by and pivoted
back. Votes alone can't give a winner that follows a strict order of trust, time and id,
so that order comes first in max_by and the votes are reported as support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "venue", "year", "abstract")
# What stands for a missing value (lower case).
PLACEHOLDERS = [
    "", "-", "--", "?", "??", "???", "n/a", "na", "n.a.", "nan", "null", "none", "nil", "tbd", "tba", "unknown", "untitled", "no title", "[no title]", "(no title)",
    "unknown venue", "no venue", "(no venue)", "[no venue]", "no abstract", "[no abstract]", "(no abstract)", "no abstract available", "no abstract available.",
    "abstract not available", "abstract not available.", "see full text", "see full text.",
]
CUT = r"(\.\.\.|…|\[\.\.\.\]|\[…\]|\(\.\.\.\)|\[truncated\]|\(truncated\)|\[cut\])\s*$"
# A cut-off title lacks LONGER letters at least, may have an edit per EDIT letters; titles of a group that meet in one task.
LONGER, EDIT, CROWD = 4, 20, 1000
HALF_LIFE_DAYS = 365.0
UNTRUSTED = 1_000_000


def plain(c: Column) -> Column:
    """Text without mark-up, invisible characters and wide forms; blanks collapsed."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(x) for x in range(0x21, 0x7F))
    c = F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", "")
    c = F.regexp_replace(c, r"[­​-‏⁠﻿]", "")
    return F.trim(F.regexp_replace(F.translate(c, wide, narrow), r"[\s  -  　]+", " "))


def letters(c: Column) -> Column:
    """Lower-case letters and digits only; Greek and Cyrillic look-alikes as Latin."""
    other, latin = "αАВЕКМНОРСТУХаеорсухіѕјΑΒΕΗΙΚΜΝΟΡΤΥΧοΖ", "aABEKMHOPCTYXaeopcyxisjABEHIKMNOPTYXoZ"
    return F.regexp_replace(F.lower(F.translate(c, other, latin)), r"[^\p{L}\p{N}]+", "")


def cut_titles(titles: DataFrame) -> DataFrame:
    """(group_id, norm) of the titles that were cut off without a mark: the start of a clearly longer one of their group.

    titles: distinct (group_id, norm). One edit per EDIT letters is allowed, so of k edits and k + 1 pieces of the longer
    title's start one piece is whole and stands at most k letters aside: titles meet by such pieces, salted in large groups.
    """
    groups = titles.groupBy("group_id").agg(F.count("*").alias("d"), F.max(F.length("norm")).alias("most")).where("d > 1")
    many = F.ceil(F.col("d") / CROWD).cast("int")
    t = titles.join(groups, "group_id").withColumn("n", F.length("norm")).withColumn("edits", F.floor(F.col("n") / EDIT).cast("int")).withColumn("many", many)
    # with k edits allowed, piece i starts at i * step; the few titles too short for an edit meet all of their group
    step = "CASE WHEN k = 0 THEN 0 ELSE int(EDIT * k / (k + 1)) END".replace("EDIT", str(EDIT))
    piece = "xxhash64(k, i, substring(norm, i * step + move + 1, step))"
    whole = t.where(F.col("n") > LONGER).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - LONGER) / EDIT).cast("int"))))
    whole = whole.withColumn("step", F.expr(step)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("move", F.lit(0))
    whole = whole.select("group_id", F.expr(piece).alias("piece"), F.col("k").alias("edits"), F.pmod(F.xxhash64("norm"), F.col("many")).cast("int").alias("salt"), F.col("norm").alias("long"))
    part = t.where(F.col("n") + LONGER <= F.col("most")).withColumn("k", F.col("edits")).withColumn("step", F.expr(step)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    part = part.withColumn("move", F.explode(F.sequence(-F.col("k"), F.col("k")))).where("i * step + move >= 0 AND i * step + move + step <= n")
    part = part.select("group_id", F.expr(piece).alias("piece"), "edits", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("salt"), "norm", "n")
    met = part.join(whole, ["group_id", "piece", "edits", "salt"]).where(F.col("n") + LONGER <= F.length("long"))
    return met.where(F.expr("levenshtein(norm, left(long, n), edits)") >= 0).select("group_id", "norm").distinct()


def usable_values(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Long rows (group_id, hit_id, field_name, value, source, retrieved_at) of usable values only."""
    entries = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]
    long = rows.select("group_id", "hit_id", "source", "retrieved_at", F.explode(F.array(*entries)).alias("e")).select("group_id", "hit_id", "source", "retrieved_at", "e.*")
    long = long.where("value IS NOT NULL").withColumn("p", plain(F.col("value"))).where(~F.lower("p").isin(*PLACEHOLDERS))
    f = F.col("field_name")
    whole_end = F.col("p").rlike(r"[.?!。][\"'”’»)\]]*$")
    year = F.expr("try_cast(p AS int)")
    fine = F.when(f == "year", year.between(1980, 2030)).when(f == "abstract", whole_end & ~F.col("p").rlike(CUT)).otherwise(~F.col("p").rlike(CUT))
    long = long.where(fine).withColumn("norm", letters(F.col("p")))
    short = cut_titles(long.where(f == "title").select("group_id", "norm").distinct()).withColumn("field_name", F.lit("title"))
    long = long.join(short, ["group_id", "field_name", "norm"], "left_anti")
    cols = ["group_id", "hit_id", "field_name", "value", "norm", "source", "retrieved_at"]
    return long.select(*cols)


def winners(rows: DataFrame, trust: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(group_id, field_name, hit_id, value, votes, support): the hit that supplies each field of the survivor.

    Usable is real content: no null, placeholder or cut-off text, years from 1980 to 2030. The most trusted
    source wins (null and unlisted sources come last), then the latest retrieved_at (null is oldest), then the
    smallest hit_id. votes sums trust times recency decay of the winner's normalised value, support is its share
    of the field's votes. Groups of any size are combined before they are shuffled; a field without a usable
    value gives no row.
    """
    # the trust table is one row per source name; its size is checked by the optimizer, not assumed
    rank = trust.where("source IS NOT NULL").groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    v = usable_values(rows, fields).join(rank, "source", "left").withColumn("rank", F.coalesce("trust_rank", F.lit(UNTRUSTED)))
    now = rows.agg(F.max("retrieved_at").alias("now"))
    v = v.crossJoin(F.broadcast(now))  # one row
    age = F.coalesce((F.unix_timestamp("now") - F.unix_timestamp("retrieved_at")) / 86400, F.lit(3650.0))
    vote = F.exp(-age * F.log(F.lit(2.0)) / HALF_LIFE_DAYS) / F.col("rank")
    order = F.struct(-F.col("rank"), F.coalesce(F.unix_micros("retrieved_at"), F.lit(-(2**62))), -F.col("hit_id"))
    by_value = v.groupBy("group_id", "field_name", "norm").agg(F.sum(vote).alias("votes"), F.max(order).alias("o"), F.max_by(F.struct("hit_id", "value"), order).alias("w"))
    best = by_value.groupBy("group_id", "field_name").agg(F.max_by(F.struct("w", "votes"), "o").alias("b"), F.sum("votes").alias("all"))
    return best.select("group_id", "field_name", F.col("b.w.hit_id").alias("hit_id"), F.col("b.w.value").alias("value"), F.col("b.votes").alias("votes"), (F.col("b.votes") / F.col("all")).alias("support"))


def survivors(won: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One record per group: each field with its value, the hit it came from and its support."""
    aggs = []
    for f in fields:
        here = F.col("field_name") == f
        aggs += [F.max(F.when(here, F.col(c))).alias(f + s) for c, s in (("value", ""), ("hit_id", "_from"), ("support", "_support"))]
    return won.groupBy("group_id").agg(*aggs)
