"""Text formats of transaction, sequence and utility databases and of pattern files; CSV ingest; resumable sinks."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT = r"^\s*[#@%]"
# Cells that mean yes in one-hot tables, and delimiters in the order in which ties are decided.
TRUTHY = ["1", "1.0", "true", "yes", "y", "t", "x"]
DELIMITERS = [",", ";", "\t", "|"]
#: A first cell that names an identifier or what holds items marks a header of (transaction, item) pairs: a rule of our own.
ID_NAME = re.compile(r"(^|[^a-z])t?id$|[a-z]id$|no$|^(order|transaction|invoice|basket|customer|session|visit)s?$")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tid, line) of the lines that are neither blank nor comments; the last line may lack its end."""
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike(COMMENT)).select(F.monotonically_increasing_id().alias("tid"), F.trim("value").alias("line"))


def parse_transactions(lines: DataFrame) -> DataFrame:
    """(tid, item): blank-separated items as a set."""
    return lines.select("tid", F.explode(F.array_distinct(F.split("line", r"\s+"))).alias("item")).where("item <> ''")


def parse_sequences(lines: DataFrame) -> DataFrame:
    """(sid, sequence): itemsets end with -1, sequences with -2; timestamps <t> are dropped, itemsets sorted without repeats."""
    body = F.regexp_replace(F.regexp_replace("line", r"<[^>]*>", " "), r"\s-2\s*$", "")
    sets = F.transform(F.split(F.concat(F.lit(" "), body), r"\s-1(?=\s|$)"), lambda x: F.array_sort(F.array_distinct(F.filter(F.split(F.trim(x), r"\s+"), lambda y: y != ""))))
    return lines.select(F.col("tid").alias("sid"), F.filter(sets, lambda x: F.size(x) > 0).alias("sequence")).where(F.size("sequence") > 0)


def parse_utilities(lines: DataFrame) -> DataFrame:
    """(tid, item, util) from `items:total:utilities`, blanks around colons allowed; rows of unequal lengths are dropped, repeated items summed."""
    p = lines.select("tid", F.split(F.regexp_replace("line", r"\s*:\s*", ":"), ":").alias("p")).where(F.size("p") >= 3)
    p = p.select("tid", F.split(F.trim(F.col("p")[0]), r"\s+").alias("i"), F.split(F.trim(F.col("p")[2]), r"\s+").alias("u")).where(F.size("i") == F.size("u"))
    rows = p.select("tid", F.explode(F.arrays_zip("i", "u")).alias("z")).select("tid", F.col("z.i").alias("item"), F.expr("try_cast(z.u AS bigint)").alias("util"))
    return rows.where("item <> '' AND util IS NOT NULL").groupBy("tid", "item").agg(F.sum("util").alias("util"))


def flatten_sequences(seqs: DataFrame) -> DataFrame:
    """(tid, item): all items of a sequence as one transaction."""
    return seqs.select(F.col("sid").alias("tid"), F.explode(F.array_distinct(F.flatten("sequence"))).alias("item"))


def sniff(lines: list[str]) -> str:
    """transactional, sequential or utility by the majority of the first 200 data lines."""
    rows = [x for x in lines if x.strip() and not re.match(COMMENT, x)][:200]
    utility = sum(x.count(":") >= 2 for x in rows)
    sequential = sum(" -1" in x or "-2" in x.split() for x in rows)
    return "utility" if 2 * utility > len(rows) else "sequential" if 2 * sequential > len(rows) else "transactional"


def sniff_csv(lines: list[str]) -> tuple[str, str, bool]:
    """(shape, delimiter, header): onehot, long or basket, from the head of the file (at most 400 lines)."""
    rows = [x for x in lines[:400] if x.strip() and not re.match(COMMENT, x)]
    if not rows:
        raise ValueError("the file holds no data")
    votes = Counter({d: sum(d in x for x in rows) for d in DELIMITERS})
    d = max(DELIMITERS, key=lambda x: (votes[x], -DELIMITERS.index(x)))
    cells = [[c.strip().strip('"') for c in x.split(d)] for x in rows]
    width = len(cells[0])
    body = cells[1:]
    flat = [c.lower() for r in body for c in r]
    if width >= 2 and body and all(len(r) == width for r in body) and all(c in TRUTHY or c in ("", "0", "0.0", "false", "no", "n", "f") for c in flat):
        return "onehot", d, True
    if width == 2 and all(len(r) == 2 for r in cells):
        head = ID_NAME.search(cells[0][0].strip().lower()) is not None
        keys = [r[0] for r in cells[head:]]
        if keys and len(set(keys)) < 0.9 * len(keys):
            return "long", d, head
    return "basket", d, False


def onehot_items(df: DataFrame) -> DataFrame:
    """(tid, item) of a one-hot table: an item per truthy cell, named after its column."""
    cells = F.array(*(F.struct(F.lit(c).alias("item"), F.lower(F.trim(F.col(f"`{c}`").cast("string"))).alias("v")) for c in df.columns))
    rows = df.select(F.monotonically_increasing_id().alias("tid"), F.explode(cells).alias("c"))
    return rows.where(F.col("c.v").isin(*TRUTHY)).select("tid", F.col("c.item").alias("item"))


def read_csv(spark: SparkSession, path: str, least_tx: int = 10, least_items: int = 2) -> DataFrame:
    """(tid, item) of a CSV of any of the three shapes; an error if it has too few transactions or items.

    The shape is decided on the driver from the first 400 lines; the rows are read by Spark.
    """
    head = [r[0] for r in spark.read.text(path).limit(400).collect()]
    shape, d, header = sniff_csv(head)
    if shape == "onehot":
        tx = onehot_items(spark.read.csv(path, sep=d, header=True))
    elif shape == "long":
        df = spark.read.csv(path, sep=d, header=header)
        a, b = df.columns[:2]
        tx = df.select(F.xxhash64(a).alias("tid"), F.trim(F.col(b)).alias("item")).where("item <> ''").distinct()
    else:
        cell = F.transform(F.split("line", re.escape(d)), lambda x: F.trim(F.regexp_replace(x, '"', "")))
        tx = text_lines(spark, path).select("tid", F.explode(F.array_distinct(cell)).alias("item")).where("item <> ''")
    n = tx.agg(F.countDistinct("tid").alias("t"), F.countDistinct("item").alias("i")).first()
    if n["t"] < least_tx or n["i"] < least_items:
        raise ValueError(f"{n['t']} transactions and {n['i']} items are too few")
    return tx


def equal_frequency_items(df: DataFrame, tid: str, columns: list[str], bins: int = 5, nominal: int = 16) -> DataFrame:
    """(tid, item): `column=value`; numeric columns with more than `nominal` values are cut into equal-frequency bins by exact quantiles."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("int", "bigint", "double", "float") or kinds[c].startswith("decimal")]
    many = df.agg(*(F.countDistinct(c).alias(c) for c in numeric)).first() if numeric else {}
    cut_ = [c for c in numeric if many[c] > nominal]
    edges = df.agg(*(F.percentile(c, [i / bins for i in range(1, bins)]).alias(c) for c in cut_)).first() if cut_ else {}

    def value(c: str) -> Column:
        if c not in cut_:
            return F.col(c).cast("string")
        code = sum((F.col(c) > float(e)).cast("int") for e in sorted(set(edges[c])))
        return F.when(F.col(c).isNotNull(), F.concat(F.lit("q"), code.cast("string")))

    cells = F.array_compact(F.array(*(F.when(~value(c).isin("", "?"), F.concat(F.lit(f"{c}="), value(c))) for c in columns)))
    return df.select(F.col(tid).alias("tid"), F.explode(cells).alias("item")).distinct()


def pattern_lines(patterns: DataFrame, style: str = "counted") -> DataFrame:
    """(value) lines of patterns (items `|`-joined, size, support): `len items support` or `items #SUP: support`."""
    items = F.replace("items", F.lit("|"), F.lit(" "))
    line = F.concat_ws(" ", F.col("size").cast("string"), F.when(F.col("size") > 0, items), F.col("support").cast("string")) if style == "counted" else F.concat(items, F.lit(" #SUP: "), F.col("support").cast("string"))
    return patterns.select(F.trim(line).alias("value"))


def parse_patterns(lines: DataFrame, style: str) -> DataFrame:
    """(items, size, support[, is_generator]) of pattern files: spmf (`a b #SUP: n`), pascal (with #IS_GENERATOR), borgelt (`a b (n)`), counted (`len a b n`)."""
    v = F.col("value")
    if style in ("spmf", "pascal"):
        body, sup = F.regexp_extract(v, r"^(.*?)\s*#SUP:", 1), F.regexp_extract(v, r"#SUP:\s*(\d+)", 1)
    elif style == "borgelt":
        body, sup = F.regexp_extract(v, r"^(.*?)\s*\(", 1), F.regexp_extract(v, r"\((\d+)", 1)
    else:
        body, sup = F.regexp_extract(v, r"^\d+\s+(.*?)\s*\d+$", 1), F.regexp_extract(v, r"(\d+)\s*$", 1)
    k = F.array_sort(F.filter(F.split(F.trim(body), r"\s+"), lambda x: x != ""))
    cols = [F.concat_ws("|", k).alias("items"), F.size(k).alias("size"), sup.cast("long").alias("support")]
    if style == "pascal":
        cols.append((F.regexp_extract(v, r"#IS_GENERATOR:\s*(\w+)", 1) == "true").alias("is_generator"))
    return lines.where(F.trim(v) != "").where(sup != "").select(*cols)


def append_missing(new: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key the parquet table at `path` lacks; the number appended. Calling it again appends nothing."""
    spark = new.sparkSession
    # a read that fails for another reason than a missing table must not append everything again
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.parquet(path).select(*key) if there else None
    rows = new.dropDuplicates(key) if old is None else new.dropDuplicates(key).join(old, key, "left_anti")
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def synthetic_transactions(spark: SparkSession, n_tx: int, n_items: int, avg_len: float, patterns: int = 50, corruption: float = 0.3, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(tid, item): baskets of patterns over Zipf-weighted items with dropped items; deterministic for a seed and any partitioning."""
    import numpy as np
    import pandas as pd

    def make(parts):
        base = np.random.default_rng(seed)
        weight = 1 / np.arange(1, n_items + 1)
        weight /= weight.sum()
        pool = [base.choice(n_items, size=min(n_items, 1 + base.poisson(max(0.0, avg_len / 2 - 1))), replace=False, p=weight) for _ in range(patterns)]
        for pdf in parts:
            rows = []
            for t in pdf["id"]:
                r = np.random.default_rng([seed, int(t)])
                want, got = max(1, r.poisson(avg_len)), set()
                for _ in range(50):
                    if len(got) >= want:
                        break
                    p = pool[int(r.integers(patterns))]
                    got |= set(p[r.random(len(p)) >= corruption].tolist())
                if not got:
                    got = {int(r.choice(n_items, p=weight))}
                rows += [(int(t), f"i{i}") for i in sorted(got)]
            yield pd.DataFrame(rows, columns=["tid", "item"])

    return spark.range(0, n_tx, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(make, "tid long, item string")
