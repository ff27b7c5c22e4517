"""Queries of the language-model data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut, load
from . import components, language, lookalike, matching, mixing, packing, survivor, tokens


def _groups(spark, sf_dir):
    pairs = load(spark, sf_dir, "hit_pairs").where("is_match").select("left_id", "right_id")
    return components.consolidate(pairs, "left_id", "right_id").withColumnRenamed("vertex", "hit_id")


def p1_found(spark, sf_dir):
    return _groups(spark, sf_dir)


def p1_group_sizes(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("hits"))


def p5_found(spark, sf_dir):
    return lookalike.same_look_pairs(load(spark, sf_dir, "bibmeta"), "bib_id", load(spark, sf_dir, "hits_addendum"), "hit_id", "title")


def p5_forms(spark, sf_dir):
    return lookalike.distinct_forms([(load(spark, sf_dir, t), "title") for t in ("bibmeta", "hits_addendum")])


def _won(spark, sf_dir):
    hits = load(spark, sf_dir, "hits_addendum").select("hit_id", "title", "venue", "year", "abstract", "source", "retrieved_at")
    return survivor.winners(hits.join(_groups(spark, sf_dir), "hit_id"), load(spark, sf_dir, "source_trust"))


def p6_found(spark, sf_dir):
    return _won(spark, sf_dir).select("group_id", "field_name", "hit_id")


def p6_survivors(spark, sf_dir):
    return survivor.survivors(_won(spark, sf_dir))


def p7_matches(spark, sf_dir):
    hits = load(spark, sf_dir, "hits_addendum").select("hit_id", "title", "year", "venue", "doi")
    return matching.matches(hits, load(spark, sf_dir, "db_records").select("rec_id", "title", "year", "venue", "doi"))


def p7_found(spark, sf_dir):
    return p7_matches(spark, sf_dir).select("hit_id", "rec_id")


def p8_contents(spark, sf_dir):
    sized = tokens.token_counts(load(spark, sf_dir, "documents"), ["doc_id"])
    return packing.contents(sized, load(spark, sf_dir, "pack_capacities"))


def p8_containers(spark, sf_dir):
    return packing.containers(p8_contents(spark, sf_dir), load(spark, sf_dir, "pack_capacities"))


def _sized(spark, sf_dir):
    return cut(tokens.token_counts(load(spark, sf_dir, "documents"), ["doc_id", "source"]))


def p9_mixture(spark, sf_dir):
    return mixing.mixture(_sized(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark, sf_dir):
    sized, targets = _sized(spark, sf_dir), load(spark, sf_dir, "mix_targets")
    return mixing.shares(cut(mixing.mixture(sized, targets)), sized, targets)


def _segments(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.segments(docs, language.fit(docs))


def p10_found(spark, sf_dir):
    return language.wrong_labels(_segments(spark, sf_dir))


def p10_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def p10_documents(spark, sf_dir):
    return language.document_languages(_segments(spark, sf_dir), load(spark, sf_dir, "documents").select("doc_id", "lang"))


QUERIES = {"p1_found": p1_found, "p1_group_sizes": p1_group_sizes, "p5_found": p5_found, "p5_forms": p5_forms, "p6_found": p6_found, "p6_survivors": p6_survivors,
           "p7_found": p7_found, "p7_matches": p7_matches, "p8_contents": p8_contents, "p8_containers": p8_containers, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_segments": p10_segments, "p10_documents": p10_documents}

_REACH = (
    "WITH RECURSIVE e AS (SELECT left_id AS a, right_id AS b FROM hit_pairs WHERE is_match AND left_id <> right_id "
    "UNION SELECT right_id, left_id FROM hit_pairs WHERE is_match AND left_id <> right_id), "
    "r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS hit_id, min(b) AS group_id FROM r GROUP BY a) "
)
ORACLE = {
    "p1_found": _REACH + "SELECT hit_id, group_id FROM g",
    "p1_group_sizes": _REACH + "SELECT group_id, count(*) AS hits FROM g GROUP BY group_id",
}
