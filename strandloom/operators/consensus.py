"""Pileup and consensus over read bases (contig_id, pos, code, qual, template, comp)."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HETEROZYGOUS_PRIOR = 1e-6
#: Log-likelihoods are added up as whole numbers of this fraction, so the sum has no order.
UNIT = 1e7
GENOTYPES = [(i, i) for i in range(5)] + list(combinations(range(5), 2))


def column(bases: DataFrame) -> list[str]:
    """What a column's bases have in common; with ``block``, by which bases may be dealt to tasks already, no shuffle is needed."""
    return ["contig_id", *(["block"] if "block" in bases.columns else []), "pos"]


def pileup(bases: DataFrame) -> DataFrame:
    """Counts by base and depth of each column."""
    counts = [F.count(F.when(F.col("code") == i, 1)).alias(n) for i, n in enumerate(("n_a", "n_c", "n_g", "n_t", "n_pad", "n_n"))]
    return bases.groupBy(*column(bases)).agg(F.count("*").alias("depth"), *counts).drop("block")


def frequency_consensus(columns: DataFrame, cutoff: int = 50) -> DataFrame:
    """The most frequent base with its percentage; ties in the order A, C, G, T, pad; '-' below the cutoff."""
    names = ["n_a", "n_c", "n_g", "n_t", "n_pad"]
    most = F.greatest(*names)
    call = F.lit("-")
    for n, b in reversed(list(zip(names, "ACGT*"))):
        call = F.when(F.col(n) == most, b).otherwise(call)
    share = F.expr("(100 * greatest(n_a, n_c, n_g, n_t, n_pad)) div depth")
    return columns.select("contig_id", "pos", F.when(share >= cutoff, call).otherwise("-").alias("base"), share.alias("percent"), "depth")


def weighted_consensus(bases: DataFrame, cutoff: int = 60) -> DataFrame:
    """The base with the largest sum of qualities."""
    sums = [F.sum(F.when(F.col("code") == i, F.col("qual")).otherwise(0)) for i in range(5)]
    w = bases.groupBy(*column(bases)).agg(*[s.alias(f"w{i}") for i, s in enumerate(sums)])
    most = F.greatest(*[f"w{i}" for i in range(5)])
    total = sum((F.col(f"w{i}") for i in range(1, 5)), F.col("w0"))
    call = F.lit("-")
    for i, b in reversed(list(enumerate("ACGT*"))):
        call = F.when(F.col(f"w{i}") == most, b).otherwise(call)
    percent = F.expr("case when w0 + w1 + w2 + w3 + w4 = 0 then 0 else (100 * greatest(w0, w1, w2, w3, w4)) div (w0 + w1 + w2 + w3 + w4) end")
    return w.select("contig_id", "pos", F.when((total > 0) & (percent >= cutoff), call).otherwise("-").alias("base"), percent.alias("percent"))


def log_tables() -> list[tuple[int, int, int]]:
    """(match, mismatch, half match) of qualities 1..100, in units (S1, 4; E5)."""
    out = []
    for q in range(1, 101):
        p = 1 - 10 ** (-q / 10)
        out.append(tuple(round(UNIT * math.log(x)) for x in (p / 5, (1 - p) / 20, p / 10 + (1 - p) / 40)))
    return out


def genotype_sums(bases: DataFrame) -> DataFrame:
    """Log-likelihood of the 15 genotypes in each column, and its depth.

    Before a shuffle, bases of one code and quality are counted, and the sums run over those counts.
    """
    tables = log_tables()
    lookup = [F.array(*[F.lit(t[k]).cast("long") for t in tables]) for k in range(3)]
    q = F.greatest(F.lit(1), F.least(F.col("qual"), F.lit(100)))
    if "block" in bases.columns:  # dealt by column: no shuffle that counting would make smaller
        counts = bases.select(*column(bases), "code", q.alias("q"), F.lit(1).alias("n"))
    else:
        counts = bases.groupBy("contig_id", "pos", "code", q.alias("q")).agg(F.count("*").alias("n"))
    match, miss, half = (F.element_at(x, F.col("q")) * F.col("n") for x in lookup)
    wide = counts.select(*column(bases), "code", "n", match.alias("mm"), miss.alias("no"), half.alias("hm"))
    sums = []
    for a, b in GENOTYPES:
        known = F.when((F.col("code") == a) & (F.col("code") == b), F.col("mm")).when((F.col("code") == a) | (F.col("code") == b), F.col("hm")).otherwise(F.col("no"))
        pads = (a == 4) + (b == 4)
        unknown = F.col(("mm", "hm", "no")[pads])
        sums.append(F.sum(F.when(F.col("code") == 5, unknown).otherwise(known)).alias(f"g{a}{b}"))
    return wide.groupBy(*column(bases)).agg(F.sum("n").alias("depth"), F.sum(F.when(F.col("code") < 5, F.col("n")).otherwise(0)).alias("known"), *sums).drop("block")


def bayes_consensus(bases: DataFrame) -> DataFrame:
    """Call, heterozygous call and phred of each column (E2, E3), with exact exponentials."""
    sums = genotype_sums(bases)
    homo, het = round(UNIT * math.log((1 - HETEROZYGOUS_PRIOR) / 5)), round(UNIT * math.log(2 * HETEROZYGOUS_PRIOR / 20))
    for a, b in GENOTYPES:
        sums = sums.withColumn(f"g{a}{b}", F.col(f"g{a}{b}") + F.lit(homo if a == b else het))
    names = [f"g{a}{b}" for a, b in GENOTYPES]
    sums = sums.withColumn("top", F.greatest(*names)).withColumn("best", F.greatest(*names[:5])).withColumn("best_het", F.greatest(*names[5:]))

    def first(among: list[str], best: str) -> Column:
        out = F.lit(None).cast("string")
        for n in reversed(among):
            out = F.when(F.col(n) == F.col(best), n[1:]).otherwise(out)
        return out

    e = lambda n: F.exp((F.col(n) - F.col("top")) / F.lit(UNIT))
    called = sums.withColumn("call", first(names[:5], "best")).withColumn("het_call", first(names[5:], "best_het"))
    others = sum((F.when(F.col("call") == n[1:], 0.0).otherwise(e(n)) for n in names[1:]), F.when(F.col("call") == names[0][1:], 0.0).otherwise(e(names[0])))
    phred = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(-4.3429448) * F.log(F.greatest(others, F.lit(1e-30))) + 0.5).cast("int")))
    symbol = F.substring(F.lit("ACGT*"), F.substring("call", 1, 1).cast("int") + 1, F.lit(1))
    return called.select(
        "contig_id", "pos", F.when(F.col("known") == 0, "N").otherwise(symbol).alias("base"), F.when(F.col("known") == 0, 0).otherwise(phred).alias("phred"), "het_call", "depth"
    )


def discrepancies(bases: DataFrame, calls: DataFrame) -> DataFrame:
    """(m - E) / sqrt(m + E) by column, from the bases that differ from the call (S1, 11: E4)."""
    code = F.instr(F.lit("ACGT*"), F.col("base")) - 1
    joined = bases.join(calls.select("contig_id", "pos", code.alias("called")), ["contig_id", "pos"])
    parts = joined.groupBy("contig_id", "pos", "qual").agg(F.count("*").alias("n"), F.count(F.when(F.col("code") != F.col("called"), 1)).alias("other"))
    e = F.round(F.pow(F.lit(10.0), -F.col("qual") / 10) * 1e9).cast("long")
    sums = parts.groupBy("contig_id", "pos").agg(F.sum(e * F.col("n")).alias("e"), F.sum((F.lit(10**9) - e) * F.col("other")).alias("m"))
    return sums.select("contig_id", "pos", F.round(((F.col("m") - F.col("e")) / 1e9) / F.sqrt(F.greatest((F.col("m") + F.col("e")) / 1e9, F.lit(1e-9))), 5).alias("discrepancy"))


def confidence_list(calls: DataFrame) -> DataFrame:
    """Columns by rounded confidence, expected errors and their running sums; 100 is left out (S10: E21, E22)."""
    bucket = F.floor(F.greatest(F.lit(0), F.least(F.col("phred"), F.lit(100))) + 0.499).cast("int")
    freq = calls.groupBy(bucket.alias("confidence")).agg(F.count("*").alias("n")).filter("confidence < 100")
    w = Window.orderBy("confidence").rowsBetween(Window.unboundedPreceding, 0)  # at most 100 rows
    errors = F.col("n") * F.pow(F.lit(10.0), -F.col("confidence") / 10)
    return freq.select("confidence", "n", F.round(errors, 4).alias("errors"), F.sum("n").over(w).alias("cum_n"), F.round(F.sum(errors).over(w), 3).alias("cum_errors"))


def match_rates(bases: DataFrame, calls: DataFrame) -> DataFrame:
    """Bases that agree with the consensus and that do not, by quality."""
    code = F.instr(F.lit("ACGT*"), F.col("base")) - 1
    joined = bases.join(calls.filter("base not in ('-', 'N')").select("contig_id", "pos", code.alias("called")), ["contig_id", "pos"])
    return joined.groupBy("qual").agg(F.count(F.when(F.col("code") == F.col("called"), 1)).alias("matches"), F.count(F.when(F.col("code") != F.col("called"), 1)).alias("mismatches"))


def problem_score(rates: DataFrame) -> DataFrame:
    """Weighted mean of (ratio - 1)**2 over qualities from 3 (S42: E24)."""
    total = F.col("matches") + F.col("mismatches")
    expected = total * F.pow(F.lit(10.0), -F.col("qual") / 10)
    ratio = (F.col("mismatches") + 1) / (expected + 1)
    up = F.greatest(ratio, 1 / ratio)
    return rates.filter("qual >= 3").agg(F.round(F.sum(total * F.pow(up - 1, 2)) / F.sum(total), 4).alias("problem_score"), F.sum(total).alias("bases"))


def worst_windows(bases: DataFrame, calls: DataFrame, width: int) -> DataFrame:
    """The most mismatches a read has to the consensus in a window, as 1/10000 (S7: F24)."""
    code = F.instr(F.lit("ACGT*"), F.col("base")) - 1
    joined = bases.join(calls.select("contig_id", "pos", code.alias("called")), ["contig_id", "pos"])
    w = Window.partitionBy("rec").orderBy("pos").rowsBetween(1 - width, 0)
    rolled = joined.select("contig_id", "rec", F.sum((F.col("code") != F.col("called")).cast("int")).over(w).alias("m"), F.count("*").over(Window.partitionBy("rec")).alias("len"))
    return rolled.groupBy("contig_id", "rec").agg(F.expr(f"(10000 * max(m)) div min(least(len, {width}))").alias("worst"))


def snp_candidates(bases: DataFrame, least: int) -> DataFrame:
    """Columns whose second base has enough summed quality: score min(1000, q1 * q2)."""
    sums = bases.filter("code < 4").groupBy("contig_id", "pos", "code").agg(F.sum("qual").alias("q"))
    w = Window.partitionBy("contig_id", "pos").orderBy(F.desc("q"), "code")
    top = sums.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("contig_id", "pos").agg(
        F.max(F.when(F.col("r") == 1, F.col("code"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("code"))).alias("second"),
        F.max(F.when(F.col("r") == 1, F.col("q"))).alias("q1"), F.max(F.when(F.col("r") == 2, F.col("q"))).alias("q2"),
    )
    return top.filter(f"q2 >= {least}").select("contig_id", "pos", "first", "second", F.least(F.lit(1000), F.col("q1") * F.col("q2")).alias("score"))


def first_column(columns: DataFrame, condition: Column, cursor: int = 0) -> DataFrame:
    """The first column at or after a cursor that meets a condition, by contig (C23..C26)."""
    return columns.filter(condition & (F.col("pos") >= cursor)).groupBy("contig_id").agg(F.min("pos").alias("pos"))


def call_runs(calls: DataFrame, least: int) -> DataFrame:
    """Homopolymer runs of the consensus (S12: E57)."""
    w = Window.partitionBy("contig_id", "base").orderBy("pos")
    marked = calls.filter("base in ('A', 'C', 'G', 'T')").withColumn("island", F.col("pos") - F.row_number().over(w))
    return marked.groupBy("contig_id", "base", "island").agg(F.min("pos").alias("pos"), F.count("*").alias("run")).filter(F.col("run") >= least).drop("island")
