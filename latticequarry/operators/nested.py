"""Deeply nested semi-structured records into related flat tables.

Spark's JSON expressions bring every variant of a record into one canonical
nested column (no Python). The flattening itself runs on Arrow buffers: child
arrays come from list offsets, their parents from the parent-index kernel, and
keys travel to the children by vectorised take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"
LIST = "array<string>"
#: Bare not-a-number values, which strict JSON lacks; they are read as text.
BARE = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,\]}])"


def _starts(c: Column, char: str) -> Column:
    return F.ltrim(c).startswith(char)


def _listed(c: Column) -> Column:
    """The elements of a JSON array as text; a scalar or object is its only element; null stays null."""
    c = F.regexp_replace(c, BARE, '$1"$2"')
    return F.when(c.isNull(), F.lit(None).cast(LIST)).when(_starts(c, "["), F.from_json(c, LIST)).otherwise(F.array(c))


def _named(c: Column) -> Column:
    """Entries (algorithm, body) of an object keyed by algorithm or of a list of objects that name theirs."""
    c = F.regexp_replace(c, BARE, '$1"$2"')
    keyed = F.transform(F.map_entries(F.from_json(c, MAP)), lambda e: F.struct(e["key"].alias("algorithm"), e["value"].alias("body")))
    listed = F.transform(F.from_json(c, LIST), lambda e: F.struct(F.get_json_object(e, "$.algorithm").alias("algorithm"), e.alias("body")))
    return F.when(c.isNull(), F.lit(None)).when(_starts(c, "{"), keyed).when(_starts(c, "["), listed)


def canonical_records(lines: DataFrame, key: str = "line_id", text: str = "raw_line") -> DataFrame:
    """One canonical nested row per whole JSON object line.

    A leading byte-order mark and blanks don't matter. NaN and Infinity count as values. Lines that are no whole JSON
    object, null and empty lines give no row. Objects may be wrapped in `probe`,
    values may be JSON in a string; both are unwrapped.
    """
    clean = F.regexp_replace(F.col(text), "^[\\s\\uFEFF]+", "")
    whole = lines.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("line_id"), clean.alias("t"))
    whole = whole.where(_starts(F.col("t"), "{") & F.try_parse_json(F.regexp_replace("t", BARE, "$1 0")).isNotNull())
    top = F.from_json("t", MAP)
    rec = whole.select("line_id", F.when(F.get(F.array(top), 0)["probe"].isNotNull(), F.from_json(top["probe"], MAP)).otherwise(top).alias("r"))

    def attempt(a: Column) -> Column:
        return F.when(a.isNotNull(), F.struct(_listed(F.get_json_object(a, "$.trace")).alias("trace"), a.alias("body")))

    def cost(e: Column) -> Column:
        tries = F.transform(_listed(F.get_json_object(e["body"], "$.attempts")), attempt)
        return F.when(e["body"].isNotNull() & e["algorithm"].isNotNull(), F.struct(e["algorithm"].alias("algorithm"), e["body"].alias("body"), tries.alias("attempts")))

    def runs(e: Column) -> Column:
        own = F.when(_starts(e["body"], "{") & F.get_json_object(e["body"], "$.algorithm").isNotNull(), F.get_json_object(e["body"], "$.runs")).otherwise(e["body"])
        return F.when(e["algorithm"].isNotNull(), F.struct(e["algorithm"].alias("algorithm"), _listed(own).alias("runs")))

    r = F.col("r")
    return rec.select(
        "line_id",
        *(r[x].alias(x) for x in ("dataset", "sigma", "n", "mode", "wall_s")),
        _listed(r["sizes"]).alias("sizes"),
        F.transform(_named(r["costs"]), cost).alias("costs"),
        F.transform(_named(r["points"]), runs).alias("points"),
    )


SCHEMA = "line_id long, child string, algorithm string, pos int, sub_pos int, value string"


def _positions(lists: pa.ListArray, parents: pa.Array) -> pa.Array:
    """Place of each flattened element in its own list, from the list offsets."""
    starts = pc.subtract(lists.offsets, lists.offsets[0]).cast(pa.int64())
    return pc.subtract(pa.array(np.arange(len(parents), dtype=np.int64)), pc.take(starts, parents.cast(pa.int64())))


def _explode(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(values, parent indices, positions) of a list array; null elements are counted but dropped."""
    lists = lists.cast(pa.list_(lists.type.value_type))
    if lists.null_count:  # a null list has no elements, whatever lies under its offsets
        lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type))
    values, parents = lists.flatten(), pc.list_parent_indices(lists)
    pos = _positions(lists, parents)
    keep = values.is_valid()
    return values.filter(keep), parents.filter(keep), pos.filter(keep)


def _table(line: pa.Array, child: str, algorithm: pa.Array, pos: pa.Array, sub: pa.Array, value: pa.Array) -> pa.RecordBatch:
    n = len(line)
    return pa.RecordBatch.from_arrays(
        [line, pa.repeat(pa.scalar(child, pa.string()), n), algorithm.cast(pa.string()), pos.cast(pa.int32()), sub.cast(pa.int32()), value.cast(pa.string())],
        ["line_id", "child", "algorithm", "pos", "sub_pos", "value"],
    )


def _const(n: int, v: object, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(v, kind), n)


def flatten_batches(batches):
    """Arrow kernels from canonical records to the child rows of all five child tables."""
    i64, text = pa.int64(), pa.string()
    for b in batches:
        line = b.column("line_id")
        v, p, pos = _explode(b.column("sizes"))
        yield _table(line.take(p), "size", _const(len(v), "", text), pos, _const(len(v), -1, i64), v)
        c, p, _ = _explode(b.column("costs"))
        c_line, name = line.take(p), c.field("algorithm")
        yield _table(c_line, "cost", name, _const(len(c), -1, i64), _const(len(c), -1, i64), c.field("body"))
        a, p, a_pos = _explode(c.field("attempts"))
        a_line, a_name = c_line.take(p), name.take(p)
        yield _table(a_line, "attempt", a_name, a_pos, _const(len(a), -1, i64), a.field("body"))
        t, p, t_pos = _explode(a.field("trace"))
        yield _table(a_line.take(p), "trace", a_name.take(p), a_pos.take(p), t_pos, t)
        e, p, _ = _explode(b.column("points"))
        e_line, e_name = line.take(p), e.field("algorithm")
        m, p, m_pos = _explode(e.field("runs"))
        yield _table(e_line.take(p), "point", e_name.take(p), m_pos, _const(len(m), -1, i64), m)


def flatten_children(records: DataFrame) -> DataFrame:
    """(line_id, child, algorithm, pos, sub_pos, value): every child row with its parent's key and place.

    pos counts from 0 in the array and counts null elements, which give no row.
    Memory is bounded by one Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch).
    """
    return records.select("line_id", "sizes", "costs", "points").mapInArrow(flatten_batches, SCHEMA)


def line_table(records: DataFrame) -> DataFrame:
    """The parent table: one row per record with its scalar fields, numbers as doubles (null where they aren't)."""
    return records.select("line_id", "dataset", "mode", *(F.expr(f"try_cast({x} AS double)").alias(x) for x in ("sigma", "n", "wall_s")))


def cost_table(children: DataFrame) -> DataFrame:
    """Typed costs: (line_id, algorithm, mode, memory_mb, runtime_s, memory_lb, why)."""
    g = lambda f: F.get_json_object("value", f"$.{f}")
    return children.where(F.col("child") == "cost").select(
        "line_id", "algorithm", g("mode").alias("mode"), *(F.expr(f"try_cast(get_json_object(value, '$.{f}') AS double)").alias(f) for f in ("memory_mb", "runtime_s", "memory_lb")), g("why").alias("why")
    )


def point_table(children: DataFrame) -> DataFrame:
    """Typed points, from [size, [memory_mb, runtime_s]] or from objects."""

    def field(name: str, path: str) -> Column:
        return F.expr(f"try_cast(coalesce(get_json_object(value, '$.{name}'), get_json_object(value, '{path}')) AS double)").alias(name)

    return children.where(F.col("child") == "point").select("line_id", "algorithm", "pos", field("size", "$[0]"), field("memory_mb", "$[1][0]"), field("runtime_s", "$[1][1]"))
