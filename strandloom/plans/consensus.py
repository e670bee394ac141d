"""Queries over read bases: pileup, consensus modes, confidence, discrepancies, candidates; each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandloom.operators import consensus as C
from strandloom.operators import tiles
from strandloom.sources import adapters as A

BASES = f"WITH {A.ITEM}, {A.BASES} "
COUNTS = "n_a n_c n_g n_t n_pad n_n".split()
PILE = BASES + ", pile AS (SELECT contig_id, pos, count(*) AS depth, " + ", ".join(f"count(*) FILTER (WHERE code = {i}) AS {n}" for i, n in enumerate(COUNTS)) + " FROM bases GROUP BY 1, 2) "
MOST = "greatest(n_a, n_c, n_g, n_t, n_pad)"
FREQ = PILE + f", freq AS (SELECT contig_id, pos, CASE WHEN 100 * {MOST} // depth < 50 THEN '-' WHEN n_a = {MOST} THEN 'A' WHEN n_c = {MOST} THEN 'C' WHEN n_g = {MOST} THEN 'G' WHEN n_t = {MOST} THEN 'T' ELSE '*' END AS base, 100 * {MOST} // depth AS percent, depth FROM pile) "
CALLED = FREQ + ", called AS (SELECT bases.*, instr('ACGT*', base) - 1 AS called, base FROM bases JOIN freq USING (contig_id, pos)) "


def bayes_sql() -> str:
    """The 15 genotype sums of each column, from counts by base and quality, with the same whole-number units."""
    tables = ", ".join(f"({q}, {a}, {b}, {c})" for q, (a, b, c) in enumerate(C.log_tables(), 1))
    homo, het = round(C.UNIT * math.log((1 - C.HETEROZYGOUS_PRIOR) / 5)), round(C.UNIT * math.log(2 * C.HETEROZYGOUS_PRIOR / 20))
    sums = []
    for a, b in C.GENOTYPES:
        unknown = ("mm", "hm", "no")[(a == 4) + (b == 4)]
        sums.append(f"CAST(sum(CASE WHEN code = 5 THEN {unknown} WHEN code = {a} AND code = {b} THEN mm WHEN code = {a} OR code = {b} THEN hm ELSE no END * n) AS BIGINT) + ({homo if a == b else het}) AS g{a}{b}")
    names = [f"g{a}{b}" for a, b in C.GENOTYPES]
    first = lambda among, best: "CASE " + " ".join(f"WHEN {n} = {best} THEN '{n[1:]}'" for n in among) + " END"
    others = " + ".join(f"CASE WHEN call = '{n[1:]}' THEN 0.0::DOUBLE ELSE exp(({n} - top) / {C.UNIT}::DOUBLE) END" for n in names)
    return BASES + f"""
, lut(q, mm, no, hm) AS (VALUES {tables}), counts AS (SELECT contig_id, pos, code, greatest(1, least(qual, 100)) AS q, count(*) AS n FROM bases GROUP BY 1, 2, 3, 4)
, g AS (SELECT contig_id, pos, CAST(sum(n) AS BIGINT) AS depth, sum(CASE WHEN code < 5 THEN n ELSE 0 END) AS known, {', '.join(sums)} FROM counts JOIN lut ON counts.q = lut.q GROUP BY 1, 2)
, t AS (SELECT *, greatest({', '.join(names)}) AS top, greatest({', '.join(names[:5])}) AS best, greatest({', '.join(names[5:])}) AS best_het FROM g)
, c AS (SELECT *, {first(names[:5], 'best')} AS call, {first(names[5:], 'best_het')} AS het_call FROM t)
, bayes AS (SELECT contig_id, pos, CASE WHEN known = 0 THEN 'N' ELSE substr('ACGT*', CAST(substr(call, 1, 1) AS INT) + 1, 1) END AS base,
  CASE WHEN known = 0 THEN 0 ELSE CAST(least(255, greatest(0, floor(-4.3429448::DOUBLE * ln(greatest({others}, 1e-30::DOUBLE)) + 0.5))) AS INT) END AS phred, het_call, depth FROM c) """


def _bases(s, d):
    return A.bases(A.item(s, d))


def _pile(s, d):
    return tiles.pileup(A.item(s, d), A.base_arrays)


def _freq(s, d):
    return C.frequency_consensus(_pile(s, d))


def _bayes(s, d, *names):
    return tiles.bayes_consensus(A.item(s, d), A.base_arrays, names or tuple(tiles.TYPES))


def _confidence_sql() -> str:
    return bayes_sql() + """, f AS (SELECT CAST(floor(greatest(0, least(phred, 100)) + 0.499) AS INT) AS confidence, count(*) AS n FROM bayes GROUP BY 1 HAVING confidence < 100)
    SELECT confidence, n, round(n * power(10.0::DOUBLE, -confidence / 10), 4) AS errors, CAST(sum(n) OVER (ORDER BY confidence) AS BIGINT) AS cum_n, round(sum(n * power(10.0::DOUBLE, -confidence / 10)) OVER (ORDER BY confidence), 3) AS cum_errors FROM f"""


RATES = CALLED + ", rates AS (SELECT qual, count(*) FILTER (WHERE code = called) AS matches, count(*) FILTER (WHERE code <> called) AS mismatches FROM called WHERE base NOT IN ('-', 'N') GROUP BY 1) "

QUERIES = {
    "e1_pileup": (lambda s, d: _pile(s, d), PILE + "SELECT * FROM pile"),
    "s22_frequency_consensus": (_freq, FREQ + "SELECT * FROM freq"),
    "s22_weighted_consensus": (
        lambda s, d: C.weighted_consensus(A.column_bases(A.item(s, d))),
        BASES + ", w AS (SELECT contig_id, pos, " + ", ".join(f"CAST(sum(CASE WHEN code = {i} THEN qual ELSE 0 END) AS BIGINT) AS w{i}" for i in range(5)) + " FROM bases GROUP BY 1, 2), p AS (SELECT *, greatest(w0, w1, w2, w3, w4) AS m, CASE WHEN w0 + w1 + w2 + w3 + w4 = 0 THEN 0 ELSE 100 * greatest(w0, w1, w2, w3, w4) // (w0 + w1 + w2 + w3 + w4) END AS percent FROM w) SELECT contig_id, pos, CASE WHEN w0 + w1 + w2 + w3 + w4 = 0 OR percent < 60 THEN '-' WHEN w0 = m THEN 'A' WHEN w1 = m THEN 'C' WHEN w2 = m THEN 'G' WHEN w3 = m THEN 'T' ELSE '*' END AS base, percent FROM p",
    ),
    "e2_bayes_consensus": (_bayes, bayes_sql() + "SELECT * FROM bayes"),
    "e4_discrepancy": (
        lambda s, d: tiles.discrepancies(A.item(s, d), A.base_arrays),
        CALLED + ", x AS (SELECT contig_id, pos, CAST(round(power(10.0::DOUBLE, -qual / 10) * 1e9::DOUBLE) AS BIGINT) AS e, code <> called AS other FROM called), y AS (SELECT contig_id, pos, CAST(sum(e) AS BIGINT) AS e, CAST(sum(CASE WHEN other THEN 1000000000 - e ELSE 0 END) AS BIGINT) AS m FROM x GROUP BY 1, 2) SELECT contig_id, pos, round(((m - e) / 1e9::DOUBLE) / sqrt(greatest((m + e) / 1e9::DOUBLE, 1e-9::DOUBLE)), 5) AS discrepancy FROM y",
    ),
    "e22_confidence_list": (lambda s, d: C.confidence_list(_bayes(s, d, "phred")), _confidence_sql()),
    "e23_match_rates": (lambda s, d: tiles.match_rates(A.item(s, d), A.base_arrays), RATES + "SELECT * FROM rates"),
    "e24_problem_score": (
        lambda s, d: C.problem_score(tiles.match_rates(A.item(s, d), A.base_arrays)),
        RATES + ", x AS (SELECT matches + mismatches AS t, (mismatches + 1) / ((matches + mismatches) * power(10.0::DOUBLE, -qual / 10) + 1) AS r FROM rates WHERE qual >= 3) SELECT round(sum(t * power(greatest(r, 1 / r) - 1, 2)) / sum(t), 4) AS problem_score, CAST(sum(t) AS BIGINT) AS bases FROM x",
    ),
    "f24_check_assembly": (
        lambda s, d: tiles.worst_windows(A.item(s, d), A.base_arrays, 29),
        CALLED + ", r AS (SELECT contig_id, rec, CAST(sum((code <> called)::INT) OVER (PARTITION BY rec ORDER BY pos ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS BIGINT) AS m, count(*) OVER (PARTITION BY rec) AS len FROM called) SELECT contig_id, rec, 10000 * max(m) // least(min(len), 29) AS worst FROM r GROUP BY 1, 2",
    ),
    "e56_snp_candidates": (
        lambda s, d: tiles.snp_candidates(A.item(s, d), A.base_arrays, 40),
        BASES + ", q AS (SELECT contig_id, pos, code, CAST(sum(qual) AS BIGINT) AS q FROM bases WHERE code < 4 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY contig_id, pos ORDER BY q DESC, code) AS r FROM q), p AS (SELECT contig_id, pos, max(code) FILTER (WHERE r = 1) AS first, max(code) FILTER (WHERE r = 2) AS second, max(q) FILTER (WHERE r = 1) AS q1, max(q) FILTER (WHERE r = 2) AS q2 FROM r GROUP BY 1, 2) SELECT contig_id, pos, first, second, least(1000, q1 * q2) AS score FROM p WHERE q2 >= 40",
    ),
    "c23_low_quality_search": (
        lambda s, d: C.first_column(_bayes(s, d, "contig_id", "pos", "phred"), F.col("phred") < 20, 100),
        bayes_sql() + "SELECT contig_id, min(pos) AS pos FROM bayes WHERE phred < 20 AND pos >= 100 GROUP BY 1",
    ),
    "c24_depth_search": (lambda s, d: C.first_column(_pile(s, d), F.col("depth") > 12, 100), PILE + "SELECT contig_id, min(pos) AS pos FROM pile WHERE depth > 12 AND pos >= 100 GROUP BY 1"),
    "c34_good_bases_disagree": (
        lambda s, d: C.first_column(_bases(s, d).filter("qual >= 35 and code < 4").groupBy("contig_id", "pos").agg(F.countDistinct("code").alias("kinds")), F.col("kinds") > 1),
        BASES + ", k AS (SELECT contig_id, pos FROM bases WHERE qual >= 35 AND code < 4 GROUP BY 1, 2 HAVING count(DISTINCT code) > 1) SELECT contig_id, min(pos) AS pos FROM k GROUP BY 1",
    ),
    "e64_quality_by_position": (
        lambda s, d: _bases(s, d).groupBy(F.expr("pos div 100").alias("bucket")).agg(F.round(F.avg("qual"), 5).alias("mean_quality"), F.count("*").alias("n")),
        BASES + "SELECT pos // 100 AS bucket, round(avg(qual), 5) AS mean_quality, count(*) AS n FROM bases GROUP BY 1",
    ),
    "e66_read_quality": (
        lambda s, d: _bases(s, d).groupBy("rec").agg(F.round(F.avg("qual"), 5).alias("mean_quality"), F.min("qual").alias("least")),
        BASES + "SELECT rec, round(avg(qual), 5) AS mean_quality, min(qual) AS least FROM bases GROUP BY 1",
    ),
    "j15_pad_columns": (
        lambda s, d: _pile(s, d).filter("n_pad > greatest(n_a, n_c, n_g, n_t) and (100 * n_pad) div depth >= 80").select("contig_id", "pos", "n_pad", "depth"),
        PILE + "SELECT contig_id, pos, n_pad, depth FROM pile WHERE n_pad > greatest(n_a, n_c, n_g, n_t) AND 100 * n_pad // depth >= 80",
    ),
    "e57_consensus_runs": (
        lambda s, d: tiles.call_runs(A.item(s, d), A.base_arrays, 3),
        FREQ + ", r AS (SELECT *, pos - row_number() OVER (PARTITION BY contig_id, base ORDER BY pos) AS isl FROM freq WHERE base IN ('A', 'C', 'G', 'T')) SELECT contig_id, base, min(pos) AS pos, count(*) AS run FROM r GROUP BY contig_id, base, isl HAVING count(*) >= 3",
    ),
}
