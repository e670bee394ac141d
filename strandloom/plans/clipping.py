"""Queries that clip reads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import clipping as C
from strandloom.operators import perread
from strandloom.sources import adapters as A

from .statistics import poly_sql

BASES = f"WITH {A.ITEM}, {A.BASES} "
ROLL = BASES + ", r AS (SELECT rec, row_number() OVER w AS i, sum(qual) OVER (w ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS s, sum((code = 5)::INT) OVER (w ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS n FROM bases WINDOW w AS (PARTITION BY rec ORDER BY pos)) "


ENDS = f"""{A.VISIBLE}, e AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY "start", rec) = 1 AS leftmost, vend >= max(vend) OVER (PARTITION BY contig_id) AS at_end,
  row_number() OVER (PARTITION BY contig_id ORDER BY "end" DESC, rec DESC) = 1 AS rightmost, lclip - 1 AS os, rclip + 1 AS oe FROM vis)"""
PAIR = """ SELECT rec, CAST(least(l, oe - 2) AS INT) AS "left", CAST(greatest(r, os + 2, least(l, oe - 2) + 2) AS INT) AS "right" FROM p"""

def _strands(s, d):
    """Each probe and its other strand."""
    return A.seq(s, d, "benchmark", "item_id").select("id", F.col("seq").alias("a"), S.reverse_complement(F.col("seq")).alias("b"))


QUERIES = {
    "f7_quality_clip_pairs": (
        lambda s, d: C.quality_clip_pairs(A.visible(A.item(s, d)), A.base_arrays, 15, 20),
        BASES + f""", {ENDS}, q AS (SELECT rec, row_number() OVER w - 1 AS c, sum(qual) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS s FROM bases WINDOW w AS (PARTITION BY rec ORDER BY pos))
        , f AS (SELECT e.rec, any_value(length) AS n, any_value(leftmost) AS leftmost, any_value(at_end) AS at_end, any_value(os) AS os, any_value(oe) AS oe, max(s) FILTER (WHERE c = 7) AS s1, max(s) FILTER (WHERE c = length - 8) AS s2,
          min(c) FILTER (WHERE s >= 300 AND c BETWEEN 8 AND length - 9) AS fl, max(c) FILTER (WHERE s >= 300 AND c BETWEEN 9 AND length - 9) AS fr FROM e JOIN q ON e.rec = q.rec GROUP BY e.rec)
        , p AS (SELECT rec, os, oe, CASE WHEN n < 15 OR leftmost OR s1 > 300 THEN os ELSE greatest(os, coalesce(fl, greatest(n - 9, 8))) END AS l, CASE WHEN n < 15 OR at_end OR s2 > 300 THEN oe ELSE least(oe, coalesce(fr, least(9, n - 9))) END AS r FROM f)""" + PAIR,
    ),
    "f9_unknown_clip_pairs": (
        lambda s, d: C.unknown_clip_pairs(A.visible(A.item(s, d)), A.base_arrays),
        BASES + f""", {ENDS}, b AS (SELECT rec, code, row_number() OVER (PARTITION BY rec ORDER BY pos) AS i FROM bases), x AS (SELECT e.rec, i, leftmost, rightmost, os, oe, CASE WHEN code = 5 THEN 1 WHEN code < 4 THEN -1 ELSE 0 END AS v FROM b JOIN e ON b.rec = e.rec WHERE i > os AND i < oe)
        , y AS (SELECT *, sum(v) OVER (PARTITION BY rec ORDER BY i) AS sl, sum(v) OVER (PARTITION BY rec ORDER BY i DESC) AS sr FROM x)
        , z AS (SELECT *, coalesce(min(sl) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ml, coalesce(min(sr) OVER (PARTITION BY rec ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mr FROM y)
        , p AS (SELECT rec, any_value(os) AS os, any_value(oe) AS oe, CASE WHEN any_value(leftmost) THEN any_value(os) ELSE coalesce(arg_max(i, sl * 100000 + i) FILTER (WHERE ml >= -10 AND sl >= 0), any_value(os)) END AS l,
          CASE WHEN any_value(rightmost) THEN any_value(oe) ELSE coalesce(arg_max(i, sr * 100000 - i) FILTER (WHERE mr >= -10 AND sr >= 0), any_value(oe)) END AS r FROM z GROUP BY rec)""" + PAIR,
    ),
    "f7_mean_quality_clip": (lambda s, d: C.mean_quality_clip(A.item(s, d), A.base_arrays, 31, 21), ROLL + 'SELECT rec, min(i) - 30 AS "left", max(i) AS "right" FROM r WHERE i >= 31 AND s >= 21 * 31 GROUP BY 1'),
    "f14_best_window": (
        lambda s, d: C.best_window(A.item(s, d), A.base_arrays, 31),
        ROLL + 'SELECT rec, i - 30 AS "left", CAST(s AS BIGINT) AS "sum" FROM r WHERE i >= 31 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY s DESC, i) = 1',
    ),
    "f15_unknown_density": (lambda s, d: C.unknown_density(A.item(s, d), A.base_arrays, 31, 2), ROLL + 'SELECT rec, min(i) - 30 AS "left" FROM r WHERE i >= 31 AND n > 2 GROUP BY 1'),
    "f9_unknown_base_clip": (
        lambda s, d: C.unknown_base_clip(A.item(s, d), A.base_arrays),
        BASES + ", c AS (SELECT rec, pos, row_number() OVER w AS i, sum(CASE WHEN code = 5 THEN 1 WHEN code < 4 THEN -1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS score FROM bases WINDOW w AS (PARTITION BY rec ORDER BY pos)), m AS (SELECT *, min(score) OVER (PARTITION BY rec ORDER BY pos) AS worst FROM c) SELECT rec, i AS clip, CAST(score AS BIGINT) AS score FROM m WHERE worst >= -10 AND score > 0 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, i DESC) = 1",
    ),
    "f16_poly_clip": (lambda s, d: C.poly_clip(A.seq(s, d), 10, 4), poly_sql("reverse(seq)")),
    # state along one read, which SQL does not express: tests/test_perread.py compares with hand-made cases and plain versions
    "f12_adaptive_quality_clips": (lambda s, d: perread.quality_clips(A.item(s, d).select(F.col("rec").alias("id"), F.transform(F.sequence("start", "end"), lambda p: (F.col("rec") * 7 + p * 3) % 41).alias("quals")), 10, 20.0), None),
    "f21_low_complexity": (lambda s, d: perread.masked(A.seq(s, d)).select("id", S.count_letter(F.col("seq"), "#").alias("masked")), None),
    "j1_global_alignments": (lambda s, d: perread.alignments(_strands(s, d)), None),
    "j8_local_alignments": (lambda s, d: perread.alignments(_strands(s, d), local=True), None),
}
