"""Schemas that drift between files: one consistent table and a report of every change.

Method: similarity flooding. The schemas of two consecutive files become graphs of
fields, values, names, types and nesting; scores start at the values the
files share, at names and at equal types; scores propagate over the pair graph to convergence, and
consistent correspondences are selected by the flooded scores. Values are then cast and united.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .nested import BARE

NULLS = ("", "n/a", "NaN", "null")
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DELIMITERS = [",", ";", "\t", "|"]
KINDS = ["number", "text", "boolean", "list", "object"]
SALT = 16
#: Shares that edges to values, names, types and containers pass on: equal values say more than equal structure.
FLOW = (1.0, 0.5, 0.25, 0.25)
#: Votes by which two lines are one run, and the share of an unchanged field's flooded score that a renamed one needs.
ENOUGH, ACCEPT = 1.5, 0.25


def _cells_of(header: Column, line: Column, delim: Column) -> Column:
    """The header's fields with the values of a CSV line, quotes removed."""

    def parts(text: Column) -> Column:
        c = F.lit(None)
        for d in DELIMITERS:
            c = F.when(delim == d, F.split(text, f'[{d}](?=(?:[^"]*"[^"]*")*[^"]*$)', -1)).otherwise(c)
        return F.transform(c, lambda x: F.replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))

    return F.arrays_zip(parts(header).alias("field"), parts(line).alias("value"))


def file_cells(lines: DataFrame) -> DataFrame:
    """(feed_id, file_id, written_at, line_no, algorithm, field_name, kind, value), one row per value.

    Blank lines, comment lines, repeated lines and broken JSON lines give no row; kind is
    null for values that mean null. Algorithm is filled for fields within a cost entry.
    """
    key = ["feed_id", "file_id", "written_at", "line_no"]
    text = F.regexp_replace("raw_line", "^[\\s\\uFEFF]+|\\s+$", "")
    base = lines.select("feed_id", "file_id", "written_at", "line_no", "file_name", text.alias("t")).where("t <> '' AND t NOT LIKE '#%' AND file_id IS NOT NULL").distinct()
    is_json = F.lower("file_name").rlike("\\.jsonl?$")

    v = base.where(is_json).select(*key, F.try_parse_json(F.regexp_replace("t", BARE, "$1 null")).alias("v")).where(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"))
    tvf = lines.sparkSession.tvf
    top = v.lateralJoin(tvf.variant_explode(F.col("v").outer()).alias("x")).select(*key, F.col("key").alias("field_name"), F.col("value").alias("v"))
    shape = F.schema_of_variant("v")
    nested = (F.col("field_name") == "costs") & shape.startswith("OBJECT")
    entry = top.where(nested).select(*key, "v").lateralJoin(tvf.variant_explode(F.col("v").outer()).alias("x")).select(*key, F.col("key").alias("algorithm"), F.col("value").alias("v"))
    inner = entry.where(shape.startswith("OBJECT")).lateralJoin(tvf.variant_explode(F.col("v").outer()).alias("x"))
    inner = inner.select(*key, "algorithm", F.concat(F.lit("costs.*."), "key").alias("field_name"), F.col("value").alias("v"))
    json = top.where(~nested).select(*key, F.lit("").alias("algorithm"), "field_name", "v").unionAll(inner)
    said = F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.to_json("v")).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
    kind = F.when(shape == "VOID", None).when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean").otherwise("number")
    json = json.select(*key, "algorithm", "field_name", kind.alias("kind"), said.alias("value"))
    json = json.withColumn("kind", F.when(F.col("value").isin(*NULLS), None).otherwise(F.col("kind")))

    table = base.where(~is_json)
    heads = table.groupBy("file_id").agg(F.min(F.struct("line_no", "t")).alias("h")).select("file_id", F.col("h.line_no").alias("head_no"), F.col("h.t").alias("head"))
    count = {d: F.length("head") - F.length(F.replace("head", F.lit(d), F.lit(""))) for d in DELIMITERS}
    best = F.greatest(*count.values())
    delim = F.lit(DELIMITERS[0])
    for d in reversed(DELIMITERS):
        delim = F.when(count[d] == best, d).otherwise(delim)
    # a file may hold a third of all lines: its lines are salted, the one head row is repeated
    heads = heads.withColumn("delim", delim).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = table.withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(SALT)).cast("int")).join(heads, ["file_id", "salt"])
    # the header gives a row of nulls, so that a field without any line still counts
    blank = F.col("line_no") == F.col("head_no")
    csv = rows.select(*key, blank.alias("blank"), F.explode(_cells_of(F.col("head"), F.col("t"), F.col("delim"))).alias("c")).where("c.field IS NOT NULL AND c.field <> ''")
    x = F.when(F.col("blank"), None).otherwise(F.col("c.value"))
    kind = (
        F.when(x.isNull() | x.isin(*NULLS), None).when(x.isin("True", "False"), "boolean").when(x.rlike(NUMERIC), "number").when(x.startswith("["), "list").when(x.startswith("{"), "object").otherwise("text")
    )
    csv = csv.select(*key, F.lit("").alias("algorithm"), F.col("c.field").alias("field_name"), kind.alias("kind"), x.alias("value"))
    return json.unionAll(csv)


def file_fields(cells: DataFrame) -> DataFrame:
    """(feed_id, file_id, written_at, field_name, type): a field's type is that of most of its non-null values (ties: the first of KINDS)."""
    counts = [F.struct(F.count(F.when(F.col("kind") == k, 1)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)]
    g = cells.groupBy("feed_id", "file_id", "written_at", "field_name").agg(F.array_max(F.array(*counts)).alias("m"))
    return g.select("feed_id", "file_id", "written_at", "field_name", F.when(F.col("m.n") > 0, F.col("m.k")).alias("type"))


def previous_files(fields: DataFrame) -> DataFrame:
    """(feed_id, file_id, prev_id): the file written just before in the feed (equal times: by file_id)."""
    files = fields.select("feed_id", "file_id", "written_at").distinct()
    w = Window.partitionBy("feed_id").orderBy("written_at", "file_id")
    return files.select("feed_id", "file_id", F.lag("file_id").over(w).alias("prev_id")).where("prev_id IS NOT NULL")


#: A number with at most three other characters before it and five after it, such as a unit.
WITH_UNIT = r"^[^0-9.+-]{0,3}([+-]?[0-9]+[.]?[0-9]*(?:[eE][+-]?[0-9]+)?)[^0-9]{0,5}$"


def normal_value() -> Column:
    """A value without its notation: the number in it as a double, else lower-case text."""
    number = F.regexp_extract("value", WITH_UNIT, 1)
    as_double = F.expr(f"try_cast(regexp_extract(value, '{WITH_UNIT}', 1) AS double)")
    plain = F.lower(F.trim("value"))
    return F.when(F.col("kind").isNull(), None).when(F.col("kind") == "number", F.expr("try_cast(value AS double)").cast("string")).when((F.col("kind") == "text") & (number != ""), as_double.cast("string")).otherwise(plain)


def shared_rows(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, prev_id, line_no, prev_line): lines of a file that export a run of the previous file again.

    Two lines are the same run if each is the other's best partner by values that occur in one line only of either
    file, so every join is one to one, whatever the size of the files. A value of four characters or more weighs 1,
    a shorter one, which may agree by chance, a half; ENOUGH is asked for.
    """
    once = cells.where("nv IS NOT NULL").groupBy("file_id", "nv").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last")).where("line_no = last").drop("last")
    old = once.select(F.col("file_id").alias("prev_id"), "nv", F.col("line_no").alias("prev_line"))
    weight = F.when(F.length("nv") >= 4, 1.0).otherwise(0.5)
    votes = once.join(pairs.select("file_id", "prev_id"), "file_id").join(old, ["prev_id", "nv"]).groupBy("file_id", "prev_id", "line_no", "prev_line").agg(F.sum(weight).alias("votes")).where(F.col("votes") >= ENOUGH)
    votes = cut(votes)
    best = votes.groupBy("file_id", "prev_id", "line_no").agg(F.max(F.struct("votes", -F.col("prev_line"))).alias("m")).select("file_id", "prev_id", "line_no", (-F.col("m.col2")).alias("prev_line"))
    back = votes.groupBy("file_id", "prev_id", "prev_line").agg(F.max(F.struct("votes", -F.col("line_no"))).alias("m")).select("file_id", "prev_id", "prev_line", (-F.col("m.col2")).alias("line_no"))
    return best.join(back, ["file_id", "prev_id", "line_no", "prev_line"])


def _bigrams(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(len(s) - 1)}


def flood(old: dict[str, str], new: dict[str, str], values: np.ndarray, names: np.ndarray, eps: float = 1e-6, rounds: int = 500) -> np.ndarray:
    """Similarity flooding between two schemas {field: type}; the score of each pair of fields (old by row, new by column).

    Nodes of a schema graph are its fields with their values, names, types and containers. Field pairs start with nothing:
    scores start at pairs of values (values: agreement of the runs both files hold), of names (names: likeness), of equal
    types and equal containers, and flow along equally named edges in both directions until they settle. What leaves a pair
    of types or containers is shared among its pairs of fields. Scores are scaled by the largest one of each round.
    """
    if not old or not new:
        return np.zeros((len(old), len(new)))

    def ends(a: list[str], b: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        x, y = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        at = np.ix_([x.index(v) for v in a], [y.index(v) for v in b])
        return at, np.array([[float(u == v) for v in y] for u in x])

    def gathered(at: tuple[np.ndarray, np.ndarray], shape: tuple[int, ...], f: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        np.add.at(out, at, f)
        return out

    own = [np.asarray(values, float), np.asarray(names, float)]
    many = [ends(list(old.values()), list(new.values())), ends([f.rpartition(".")[0] for f in old], [f.rpartition(".")[0] for f in new])]
    share = [gathered(at, s.shape, np.ones((len(old), len(new)))) for at, s in many]
    field, leaf, hub = np.zeros((len(old), len(new))), list(own), [s for _, s in many]
    for _ in range(rounds):
        inflow = sum(c * (s + n) for c, s, n in zip(FLOW, own, leaf, strict=False)) + sum(c * ((s + n) / w)[at] for c, (at, s), n, w in zip(FLOW[2:], many, hub, share, strict=True))
        now = [field + inflow, *(s + n + c * field for c, s, n in zip(FLOW, own, leaf, strict=False)), *(s + n + c * gathered(at, s.shape, field) for c, (at, s), n in zip(FLOW[2:], many, hub, strict=True))]
        top = max(x.max() for x in now) or 1.0
        now = [x / top for x in now]
        moved = max(abs(x - y).max() for x, y in zip(now, [field, *leaf, *hub], strict=True))
        field, leaf, hub = now[0], now[1:3], now[3:]
        if moved < eps:
            break
    return field


def _select(pdf: pd.DataFrame, accept: float) -> pd.DataFrame:
    """Correspondences of one file with its predecessor: (file_id, old_name, new_name, score).

    Flooded scores decide: fields of one container are matched stably, best scores first, and accepted from `accept` times the
    median score of the unchanged fields (of the best score, if no field is unchanged); score is that relation, 1 at most.
    """
    old = dict(pdf.loc[pdf["side"] == "old", ["a", "type"]].itertuples(index=False))
    new = dict(pdf.loc[pdf["side"] == "new", ["a", "type"]].itertuples(index=False))
    ev = {(r.a, r.b): (r.agree, r.n) for r in pdf[pdf["side"] == "pair"].itertuples()}
    values, names = np.zeros((len(old), len(new))), np.zeros((len(old), len(new)))
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            if a == b:
                values[i, j] = names[i, j] = 1.0
            elif a not in new and b not in old:
                agree, n = ev.get((a, b), (0, 0))
                # agreement over n shared values, shrunk where they are few; names say nothing against values that differ
                values[i, j] = agree / (n + 0.25)
                x, y = _bigrams(a.rpartition(".")[2]), _bigrams(b.rpartition(".")[2])
                names[i, j] = 0.0 if 2 * agree < n else len(x & y) / max(1, len(x | y))
    score = flood(old, new, values, names)
    at_old, at_new = {f: i for i, f in enumerate(old)}, {f: j for j, f in enumerate(new)}
    firm = [score[at_old[f], at_new[f]] for f in old if f in new]
    unit = float(np.median(firm)) if firm else float(score.max(initial=0.0))
    free = sorted(((float(score[i, j]), a, b) for a, i in at_old.items() if a not in new for b, j in at_new.items() if b not in old and a.rpartition(".")[0] == b.rpartition(".")[0]), key=lambda t: (-t[0], t[1], t[2]))
    rows, used = [], set()
    for s, a, b in free:
        if ("old", a) not in used and ("new", b) not in used and s > 0 and s >= accept * unit:
            used |= {("old", a), ("new", b)}
            rows.append((int(pdf["file_id"].iloc[0]), a, b, min(1.0, s / unit)))
    return pd.DataFrame(rows, columns=["file_id", "old_name", "new_name", "score"])


def correspondences(cells: DataFrame, fields: DataFrame, pairs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(file_id, old_name, new_name, score): fields that carry the same values under a new name.

    A group handed to the flooding holds one schema pair, so its size is bounded by the schema, not by rows.
    """
    now = fields.join(pairs, ["feed_id", "file_id"]).select("file_id", "prev_id", "field_name", "type")
    before = pairs.join(fields.select(F.col("file_id").alias("prev_id"), "field_name", "type"), "prev_id").select("file_id", "prev_id", "field_name", "type")
    come = now.join(before, ["file_id", "field_name"], "left_anti")
    gone = before.join(now, ["file_id", "field_name"], "left_anti")
    both = come.select("file_id", "prev_id").distinct().join(gone.select("file_id").distinct(), "file_id", "left_semi")
    both, come, gone = cut(both), cut(come), cut(gone)
    same = cut(shared_rows(cells, both))
    cell = cells.select("file_id", "line_no", "algorithm", "field_name", "nv")
    new = cell.join(come.select("file_id", "field_name"), ["file_id", "field_name"], "left_semi").join(same, ["file_id", "line_no"])
    old = cell.withColumnsRenamed({"file_id": "prev_id", "line_no": "prev_line", "field_name": "a", "nv": "av"})
    old = old.join(gone.select("prev_id", F.col("field_name").alias("a")).distinct(), ["prev_id", "a"], "left_semi")
    met = new.join(old, ["prev_id", "prev_line", "algorithm"]).where("nv IS NOT NULL OR av IS NOT NULL")
    ev = met.groupBy("file_id", "a", F.col("field_name").alias("b")).agg(F.sum(F.expr("CASE WHEN nv <=> av THEN 1 ELSE 0 END")).alias("agree"), F.count("*").alias("n"))
    none = F.lit(None)
    rows = (
        ev.select("file_id", F.lit("pair").alias("side"), "a", "b", none.cast("string").alias("type"), "agree", "n")
        .unionAll(now.join(both, "file_id", "left_semi").select("file_id", F.lit("new"), "field_name", none.cast("string"), F.coalesce("type", F.lit("null")), F.lit(0), F.lit(0)))
        .unionAll(before.join(both, "file_id", "left_semi").select("file_id", F.lit("old"), "field_name", none.cast("string"), F.coalesce("type", F.lit("null")), F.lit(0), F.lit(0)))
    )
    return rows.groupBy("file_id").applyInPandas(lambda pdf: _select(pdf, accept), "file_id long, old_name string, new_name string, score double")


def prepare(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, fields, file pairs, correspondences) of a table of file lines."""
    cells = cut(file_cells(lines).withColumn("nv", normal_value()))
    fields = cut(file_fields(cells))
    pairs = cut(previous_files(fields))
    return cells, fields, pairs, cut(correspondences(cells, fields, pairs))


def changes(lines: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name, old_name) of every file against the one before it in its feed.

    Kinds are added, removed, renamed and retyped (old_name '' but for renamed). The first file of a
    feed has no change; an empty table has none; a type known on one side only is no change.
    """
    _, fields, pairs, names = prepare(lines)
    now = fields.join(pairs, ["feed_id", "file_id"]).select("file_id", "field_name", "type")
    before = pairs.join(fields.select(F.col("file_id").alias("prev_id"), "field_name", F.col("type").alias("old_type")), "prev_id").select("file_id", "field_name", "old_type", F.lit(True).alias("was"))
    names = names.withColumn("file_id", F.col("file_id").cast(fields.schema["file_id"].dataType))
    both = now.withColumn("is", F.lit(True)).join(before, ["file_id", "field_name"], "full_outer")
    to = names.select("file_id", F.col("new_name").alias("field_name"), F.lit(True).alias("named"))
    gone = names.select("file_id", F.col("old_name").alias("field_name"), F.lit(True).alias("left"))
    kind = F.when(F.col("was").isNull() & F.col("named").isNull(), "added").when(F.col("is").isNull() & F.col("left").isNull(), "removed").when(F.col("is") & F.col("was") & (F.col("type") != F.col("old_type")), "retyped")
    plain = both.join(to, ["file_id", "field_name"], "left").join(gone, ["file_id", "field_name"], "left").select("file_id", kind.alias("change_kind"), "field_name", F.lit("").alias("old_name")).where("change_kind IS NOT NULL")
    return plain.unionAll(names.select("file_id", F.lit("renamed"), F.col("new_name"), F.col("old_name")))


def canonical_names(fields: DataFrame, names: DataFrame) -> dict[str, str]:
    """{field: canonical field} over all files: names linked by renames, the most frequent renames first, named after the most frequent one.

    Two names that one file holds side by side are never united, so that no value is lost; such a rename stays out.
    Works on distinct names, renames and neighbours, whose number is bounded by the schemas, not by the rows.
    """
    freq = {r[0]: r[1] for r in fields.groupBy("field_name").count().collect()}
    other = fields.select("file_id", F.col("field_name").alias("other"))
    beside = {(r[0], r[1]) for r in fields.join(other, "file_id").where("field_name < other").select("field_name", "other").distinct().collect()}
    up = {f: {f} for f in freq}
    links = names.groupBy("old_name", "new_name").count().collect()
    for a, b in ((r[0], r[1]) for r in sorted(links, key=lambda r: (-r[2], r[0], r[1]))):
        x, y = up[a], up[b]
        if x is not y and not any((min(p, q), max(p, q)) in beside for p in x for q in y):
            x |= y
            for f in y:
                up[f] = x
    return {f: min(g, key=lambda q: (-freq[q], q)) for f, g in up.items()}


def consistent_table(lines: DataFrame) -> DataFrame:
    """All runs of all files under one schema: (feed_id, file_id, line_no, algorithm, one column per canonical field).

    A canonical field is a double if most of its values are numbers (units are stripped), else text.
    Fields within a cost entry lose their `costs.*.` prefix if a plain field of that name exists.
    """
    cells, fields, _, names = prepare(lines)
    canon = canonical_names(fields, names)
    plain = {c for c in canon.values() if not c.startswith("costs.*.")}
    to = {f: (c.removeprefix("costs.*.") if c.removeprefix("costs.*.") in plain or c.startswith("costs.*.") else c) for f, c in canon.items()}
    spark = lines.sparkSession
    table = spark.createDataFrame(sorted(to.items()) or [("", "")], "field_name string, canonical string")
    rows = cells.join(F.broadcast(table), "field_name")  # as many rows as distinct field names
    numeric = {r[0] for r in rows.where("kind IS NOT NULL").groupBy("canonical").agg(F.avg(F.expr("CASE WHEN try_cast(nv AS double) IS NOT NULL THEN 1.0 ELSE 0.0 END")).alias("p")).where("p > 0.5").collect()}
    run = F.when(F.col("algorithm") != "", F.col("algorithm"))
    rows = rows.select("feed_id", "file_id", "line_no", run.alias("entry"), "canonical", F.when(F.col("kind").isNotNull(), F.when(F.col("canonical").isin(*sorted(numeric)), F.col("nv")).otherwise(F.col("value"))).alias("v"))
    cols = [F.max(F.when(F.col("canonical") == c, F.col("v"))).alias(c) for c in sorted(set(to.values())) if c]
    # values outside a cost entry belong to every entry of the line: first by line, then joined
    wide = rows.groupBy("feed_id", "file_id", "line_no", "entry").agg(*cols)
    line = wide.where("entry IS NULL").drop("entry")
    inner = wide.where("entry IS NOT NULL")
    names_ = [c for c in sorted(set(to.values())) if c]
    i, o = inner.alias("i"), line.alias("o")
    joined = o.join(i, ["feed_id", "file_id", "line_no"], "full_outer")

    def pick(c: str) -> Column:
        x = F.coalesce(F.col(f"i.`{c}`"), F.col(f"o.`{c}`"))
        return (F.expr(f"try_cast(coalesce(i.`{c}`, o.`{c}`) AS double)") if c in numeric else x).alias(c)

    return joined.select("feed_id", "file_id", "line_no", F.col("i.entry").alias("entry_algorithm"), *(pick(c) for c in names_))
