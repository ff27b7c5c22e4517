"""Transaction, utility, sequence and window databases derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import load


def attribute_items(rows: DataFrame, tid: str, columns: dict[str, Column]) -> DataFrame:
    """(tid, item) with one `name=value` item per attribute; nulls, '' and '?' give none."""
    items = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in columns.items()]
    missing = [v.cast("string").isin("", "?") for v in columns.values()]
    kept = F.array_compact(F.array(*(F.when(~m, i) for m, i in zip(missing, items, strict=True))))
    return rows.select(F.col(tid).cast("long").alias("tid"), F.explode(kept).alias("item")).distinct()


def customers(spark: SparkSession, d: str) -> DataFrame:
    """T1: customers by nation, region, segment and balance; the nation decides the region."""
    r = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return attribute_items(r, "c_custkey", {"nation": F.col("n_name"), "region": F.col("r_name"), "seg": F.col("c_mktsegment"), "bal": F.floor(F.col("c_acctbal") / 2000)})


def order_brands(spark: SparkSession, d: str) -> DataFrame:
    """T5: brands of each order."""
    return load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item")).distinct()


def order_types(spark: SparkSession, d: str) -> DataFrame:
    """T4: part types of each order."""
    return load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_type").alias("item")).distinct()


def order_utilities(spark: SparkSession, d: str, column: str) -> DataFrame:
    """U1/U2: (tid, item, util) with the rounded extended price summed per order and item."""
    li = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_orderkey").alias("tid"), F.col(column).alias("item")).agg(F.sum(F.round("l_extendedprice").cast("long")).alias("util"))


def user_days(spark: SparkSession, d: str) -> DataFrame:
    """WD1: (tid, day, item): event types of each user and day."""
    e = load(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")))
    return e.select((F.col("user_id") * 100000 + F.col("day")).alias("tid"), F.col("day").cast("long").alias("day"), F.col("event_type").alias("item")).distinct()


def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Q1: (sid, sequence) of event types per user and day in time order, one item per itemset."""
    e = load(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    sid = F.col("user_id") * 100000 + F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    s = e.groupBy(sid.alias("sid")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return s.select("sid", F.transform("s", lambda x: F.array(x["event_type"])).alias("sequence"))


def document_words(spark: SparkSession, d: str, top: int = 40) -> DataFrame:
    """K1: the `top` most frequent words (by documents, ties by word) of each document."""
    w = load(spark, d, "documents").select(F.col("doc_id").alias("tid"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("item")).where("item <> ''")
    best = w.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top)
    return w.join(F.broadcast(best.select("item")), "item").select("tid", "item").distinct()  # `top` rows


def frequency_order(tx: DataFrame) -> DataFrame:
    """(item, frequency, id): item dictionary with ids by (-frequency, name), counted from 1."""
    f = tx.distinct().groupBy("item").agg(F.count("*").alias("frequency"))
    return f.select("item", "frequency", F.row_number().over(Window.orderBy(F.desc("frequency"), "item")).alias("id"))
