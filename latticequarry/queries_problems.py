"""Queries of the general data problems: nested records, drifting schemas, two copies."""

from __future__ import annotations

from .operators import drift, nested, reconcile
from .operators.reconcile import FLAG, NUMBER, STAMP, TEXT
from .session import load

RUN_FIELDS = {
    "algorithm": TEXT, "category": NUMBER, "dataset": TEXT, "param_name": TEXT, "param_value": NUMBER, "runtime_s": NUMBER,
    "peak_memory_mb": NUMBER, "generator_count": NUMBER, "timed_out": FLAG, "error": TEXT, "runtime_s_recorded": NUMBER,
    "peak_memory_mb_recorded": NUMBER, "generator_count_recorded": NUMBER, "timed_out_recorded": FLAG, "error_recorded": TEXT,
    "count_matches": FLAG, "peak_source": TEXT, "machine": TEXT, "run_stamp": STAMP,
}


def p2_children(spark, sf_dir):
    return nested.flatten_children(nested.canonical_records(load(spark, sf_dir, "probe_fresh5").select("line_id", "raw_line")))


def p2_found(spark, sf_dir):
    return p2_children(spark, sf_dir).drop("value")


def p2_costs(spark, sf_dir):
    return nested.cost_table(p2_children(spark, sf_dir))


def p2_points(spark, sf_dir):
    return nested.point_table(p2_children(spark, sf_dir))


def p2_lines(spark, sf_dir):
    return nested.line_table(nested.canonical_records(load(spark, sf_dir, "probe_fresh5").select("line_id", "raw_line")))


def p4_differences(spark, sf_dir):
    return reconcile.differences(load(spark, sf_dir, "published_linux_rerun"), load(spark, sf_dir, "published_linux_copy"), "run_id", RUN_FIELDS, "loaded_at", ("only_rerun", "only_copy"))


def p4_found(spark, sf_dir):
    return p4_differences(spark, sf_dir).select("run_id", "diff_kind", "field_name")


def _sql_meaning(c: str, kind: str, copy: bool) -> str:
    if kind == NUMBER:
        x = f"try_cast(trim(CAST({c} AS VARCHAR)) AS DOUBLE)"
        return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"
    t = f"trim(CAST({c} AS VARCHAR))"
    if kind == FLAG:
        return f"CASE WHEN lower({t}) IN ('true','t','1','1.0','yes') THEN 'true' WHEN lower({t}) IN ('false','f','0','0.0','no') THEN 'false' WHEN lower({t}) IN ('','nan') THEN NULL ELSE lower({t}) END"
    if kind == STAMP and copy:
        return f"strftime(CAST({c} AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S')"
    return f"CASE WHEN {t} IN ('', 'NaN') THEN NULL ELSE {t} END"


def _sql_p4() -> str:
    def side(t: str, copy: bool) -> str:
        cols = ", ".join(f"{_sql_meaning(c, k, copy)} AS {c}" for c, k in RUN_FIELDS.items())
        order = ", ".join(f"{c} DESC NULLS LAST" for c in RUN_FIELDS)
        return f"SELECT * FROM (SELECT run_id, loaded_at, {cols}, row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC NULLS LAST, {order}) AS rn FROM {t} WHERE run_id IS NOT NULL) WHERE rn = 1"

    parts = []
    for c, k in RUN_FIELDS.items():
        same = f"(a.{c} IS NOT DISTINCT FROM b.{c})" + (f" OR coalesce(abs(a.{c} - b.{c}) <= 1e-9 * greatest(abs(a.{c}), abs(b.{c})), false)" if k == NUMBER else "")
        parts.append(f"SELECT a.run_id, 'differs' AS diff_kind, '{c}' AS field_name FROM a JOIN b USING (run_id) WHERE NOT ({same})")
    return (
        f"WITH a AS ({side('published_linux_rerun', False)}), b AS ({side('published_linux_copy', True)}) "
        "SELECT run_id, 'only_rerun' AS diff_kind, '' AS field_name FROM a WHERE run_id NOT IN (SELECT run_id FROM b) UNION ALL "
        "SELECT run_id, 'only_copy' AS diff_kind, '' AS field_name FROM b WHERE run_id NOT IN (SELECT run_id FROM a) UNION ALL " + " UNION ALL ".join(parts)
    )


QUERIES = {"p2_found": p2_found, "p2_children": p2_children, "p2_lines": p2_lines, "p2_costs": p2_costs, "p2_points": p2_points, "p4_found": p4_found, "p4_differences": p4_differences}
ORACLE = {"p4_found": _sql_p4()}


def _run_lines(spark, sf_dir):
    return load(spark, sf_dir, "run_files").select("feed_id", "file_id", "file_name", "written_at", "line_no", "raw_line")


def p3_found(spark, sf_dir):
    return drift.changes(_run_lines(spark, sf_dir))


def p3_table(spark, sf_dir):
    return drift.consistent_table(_run_lines(spark, sf_dir))


QUERIES |= {"p3_found": p3_found, "p3_table": p3_table}
