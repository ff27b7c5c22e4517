"""Differences between two copies of a dataset.

Method: per hash bucket both copies build an invertible Bloom lookup table of keys
and row hashes; the tables are subtracted (one signed aggregation) and peeled to
reveal the differing keys; only those rows are fetched and compared field by field.
Buckets that cannot be peeled completely are compared row by row, so the result is
exact whatever the number of differences.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

NUMBER, FLAG, STAMP, TEXT = "number", "flag", "stamp", "text"


@dataclass(frozen=True)
class Sketch:
    """Sizes of the lookup tables: keys a bucket should hold, cells per bucket, hash functions."""

    keys_per_bucket: int = 128
    cells: int = 96
    hashes: int = 3


def meaning(name: str, dtype: str, kind: str) -> Column:
    """What a value says, whatever its notation; null, '' and NaN say nothing.

    Numbers become doubles, flags booleans (true/t/1/yes), stamps `yyyyMMdd_HHmmss`
    text in UTC; other text is trimmed. Text that is no number or flag keeps its own form.
    """
    c = F.col(name)
    if kind == NUMBER:
        x = c.cast("double") if dtype != "string" else F.expr(f"try_cast(trim(`{name}`) AS double)")
        return F.when(F.isnan(x), None).otherwise(x + F.lit(0.0))
    if kind == FLAG:
        if dtype == "boolean":
            return c.cast("string")
        t = F.lower(F.trim(c.cast("string")))
        return F.when(t.isin("true", "t", "1", "1.0", "yes"), "true").when(t.isin("false", "f", "0", "0.0", "no"), "false").when(t.isin("", "nan"), None).otherwise(t)
    if kind == STAMP:
        if dtype.startswith("timestamp"):
            return F.date_format(c, "yyyyMMdd_HHmmss")
        t = F.trim(c)
        return F.when(t == "", None).otherwise(t)
    t = F.trim(c.cast("string"))
    return F.when(t.isin("", "NaN"), None).otherwise(t)


def latest_rows(df: DataFrame, key: str, kinds: dict[str, str], loaded: str) -> DataFrame:
    """One canonical row per key: the one loaded last (nulls are oldest; equal times: the larger values).

    The aggregation combines before the shuffle, so a key that holds a third of all rows costs one row a task.
    """
    types = dict(df.dtypes)
    row = F.struct(F.col(loaded).alias("_at"), *(meaning(c, types[c], k).alias(c) for c, k in kinds.items()))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(row).alias("r")).select("key", *(F.col(f"r.{c}") for c in kinds))


def _cells(rows: DataFrame, sign: int, kinds: dict[str, str], buckets: int, s: Sketch) -> DataFrame:
    row_hash = F.xxhash64(*(F.struct(F.col(c), F.col(c).isNull()) for c in kinds))
    at = rows.select(F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(buckets)).alias("bucket"), "key", row_hash.alias("h"))
    part = s.cells // s.hashes
    places = F.array(*(F.pmod(F.xxhash64(F.lit(101 + i), "key", "h"), F.lit(part)) + F.lit(i * part) for i in range(s.hashes)))
    return at.select("bucket", F.explode(places).alias("cell"), "key", "h", F.xxhash64("key", "h", F.lit(7)).alias("c"), F.lit(sign).alias("s"))


def _peel(s: Sketch):
    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        """Peel one bucket's subtracted table; (key, side) of each pure cell, or the bucket as unpeeled."""
        bucket = int(pdf["bucket"].iloc[0])
        size = pdf.set_index("cell")
        cells = {int(i): [int(n), int(k), int(h), int(c)] for i, n, k, h, c in zip(size.index, size["n"], size["k"], size["h"], size["c"], strict=True)}
        found: list[tuple[int, int]] = []
        todo = list(cells)
        while todo:
            i = todo.pop()
            n, k, h, c = cells[i]
            if abs(n) != 1 or _check(k, h) != c:
                continue
            found.append((k, n))
            for j in _places(k, h, s):
                if j in cells:
                    cells[j] = [cells[j][0] - n, cells[j][1] ^ k, cells[j][2] ^ h, cells[j][3] ^ c]
                    todo.append(j)
        clean = all(not any(v) for v in cells.values())
        if not clean:
            return pd.DataFrame({"bucket": [bucket], "key": pd.array([None], "Int64"), "side": [0]})
        return pd.DataFrame({"bucket": [bucket] * len(found), "key": pd.array([k for k, _ in found], "Int64"), "side": [n for _, n in found]})

    return peel


# xxhash64 of longs as Spark computes it, so that peeling can re-hash an element.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_M = (1 << 64) - 1


def _rot(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _mix(h: int) -> int:
    h = ((h ^ (h >> 33)) * _P2) & _M
    h = ((h ^ (h >> 29)) * _P3) & _M
    return h ^ (h >> 32)


def _hash_long(v: int, seed: int) -> int:
    h = (seed + _P5 + 8) & _M
    h ^= (_rot((v * _P2) & _M, 31) * _P1) & _M
    return _mix((_rot(h, 27) * _P1 + _P4) & _M)


def _hash_int(v: int, seed: int) -> int:
    h = (seed + _P5 + 4) & _M
    h ^= ((v & 0xFFFFFFFF) * _P1) & _M
    return _mix((_rot(h, 23) * _P2 + _P3) & _M)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _check(k: int, h: int) -> int:
    return _signed(_hash_int(7, _hash_long(h & _M, _hash_long(k & _M, 42))))


def _places(k: int, h: int, s: Sketch) -> list[int]:
    part = s.cells // s.hashes
    return [_signed(_hash_long(h & _M, _hash_long(k & _M, _hash_int(101 + i, 42)))) % part + i * part for i in range(s.hashes)]


def differing_keys(left: DataFrame, right: DataFrame, kinds: dict[str, str], sketch: Sketch = Sketch()) -> DataFrame:
    """Distinct keys whose canonical rows differ or that one side lacks, by subtracting and peeling the tables."""
    buckets = max(1, -(-left.count() // sketch.keys_per_bucket))
    cells = _cells(left, 1, kinds, buckets, sketch).unionAll(_cells(right, -1, kinds, buckets, sketch))
    diff = cells.groupBy("bucket", "cell").agg(F.sum("s").alias("n"), F.bit_xor("key").alias("k"), F.bit_xor("h").alias("h"), F.bit_xor("c").alias("c"))
    diff = diff.where("n <> 0 OR k <> 0 OR h <> 0 OR c <> 0").withColumn("bucket", F.col("bucket").cast("long"))
    peeled = cut(diff.groupBy("bucket").applyInPandas(_peel(sketch), "bucket long, key long, side int"))
    keys = peeled.where("key IS NOT NULL").select("key")
    stuck = peeled.where("key IS NULL").select("bucket")
    whole = left.select("key").unionAll(right.select("key")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(buckets)).cast("long"))
    return keys.unionAll(whole.join(stuck, "bucket", "left_semi").select("key")).distinct()


def same(a: Column, b: Column, kind: str, tolerance: float = 1e-9) -> Column:
    """Null-safe sameness; numbers within a relative tolerance."""
    if kind != NUMBER:
        return a.eqNullSafe(b)
    close = F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))
    return a.eqNullSafe(b) | F.coalesce(close, F.lit(False))


def differences(left: DataFrame, right: DataFrame, key: str, kinds: dict[str, str], loaded: str, only: tuple[str, str], sketch: Sketch = Sketch()) -> DataFrame:
    """(key, diff_kind, field_name, left_value, right_value).

    diff_kind is only[0] or only[1] with field_name '' for a key that the other copy
    lacks, `differs` with the field otherwise. Of several rows with one key the one
    loaded last counts; rows without a key are left out; columns outside `kinds`
    are not compared. Empty tables are copies without rows.
    """
    a = cut(latest_rows(left, key, kinds, loaded))
    b = cut(latest_rows(right, key, kinds, loaded))
    keys = cut(differing_keys(a, b, kinds, sketch))
    one = a.join(keys, "key", "left_semi").select("key", F.struct(*kinds).alias("a"))
    two = b.join(keys, "key", "left_semi").select("key", F.struct(*kinds).alias("b"))
    both = one.join(two, "key", "full_outer")

    def row(kind: Column, field: str, c: str | None) -> Column:
        v = [F.col(f"{s}.{c}").cast("string") if c else F.lit(None).cast("string") for s in "ab"]
        return F.struct(kind.alias("diff_kind"), F.lit(field).alias("field_name"), v[0].alias("left_value"), v[1].alias("right_value"))

    fields = [F.when(~same(F.col(f"a.{c}"), F.col(f"b.{c}"), k), row(F.lit("differs"), c, c)) for c, k in kinds.items()]
    rows = F.when(F.col("b").isNull(), F.array(row(F.lit(only[0]), "", None))).when(F.col("a").isNull(), F.array(row(F.lit(only[1]), "", None))).otherwise(F.array_compact(F.array(*fields)))
    return both.select("key", F.explode(rows).alias("d")).select(F.col("key").alias(key), "d.*")
