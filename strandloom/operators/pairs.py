"""Read pairs, templates and libraries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mates(items: DataFrame) -> DataFrame:
    """One row a pair: reads 1 and 2 of a template side by side, then 3 and 4, and so on.

    The reads meet in one aggregation by template and pair, so no self join is needed.
    """
    cols = ["rec", "contig_id", "start", "end", "comp", "mqual"]
    of = lambda n, c: F.max(F.when(F.col("end_no") % 2 == n % 2, F.col(c))).alias(f"{c}{n}")
    ends = items.groupBy("template", F.expr("(end_no - 1) div 2").alias("pair")).agg(*[of(n, c) for n in (1, 2) for c in cols], F.max("library").alias("library"))
    return ends.filter("rec1 is not null and rec2 is not null").drop("pair")


def spanning_pairs(pairs: DataFrame, min_mqual: int, min_freq: int, libraries: list[str] | None = None) -> DataFrame:
    """Pairs between contigs and how often their contigs are linked (D2): canonical (least, greatest), signed by orientation."""
    good = pairs.filter((F.col("contig_id1") != F.col("contig_id2")) & (F.least("mqual1", "mqual2") >= min_mqual))
    if libraries is not None:
        good = good.filter(F.col("library").isin(libraries))
    sign = lambda n: F.when(F.col(f"comp{n}"), -F.col(f"contig_id{n}")).otherwise(F.col(f"contig_id{n}"))
    flip = F.col("contig_id1") > F.col("contig_id2")
    signed = good.select(F.when(flip, sign(2)).otherwise(sign(1)).alias("contig_a"), F.when(flip, sign(1)).otherwise(sign(2)).alias("contig_b"))
    return signed.groupBy("contig_a", "contig_b").agg(F.count("*").alias("n_pairs")).filter(F.col("n_pairs") >= min_freq)


def template_status(pairs: DataFrame) -> DataFrame:
    """Distance, orientation and status of each pair (D6), without library statistics."""
    forward_first = (~F.col("comp1")) & F.col("comp2")
    inward = F.when(forward_first, F.col("start1") < F.col("end2")).otherwise(F.col("start2") < F.col("end1"))
    same = F.col("comp1") == F.col("comp2")
    return pairs.select(
        "template", "library",
        F.when(F.col("contig_id1") == F.col("contig_id2"), F.greatest("end1", "end2") - F.least("start1", "start2")).alias("distance"),
        F.when(same, "SAME").when(inward, "INWARD").otherwise("OUTWARD").alias("orientation"),
        F.when(F.col("contig_id1") != F.col("contig_id2"), "SPANNING").when(same, "ORIENT").when(F.greatest("end1", "end2") - F.least("start1", "start2") > 3000, "DISTANCE").otherwise("PAIRED").alias("status"),
    )


def strand_conflicts(items: DataFrame) -> DataFrame:
    """Templates with reads of one contig that imply both directions of the template (E36): template, contig_id, plus, minus.

    A read of the forward primer (odd ``end_no``) that isn't complemented and one of the reverse
    primer that is imply plus.
    """
    agrees = F.col("comp") == (F.col("end_no") % 2 == 0)
    counts = items.groupBy("template", "contig_id").agg(F.count_if(agrees).alias("plus"), F.count_if(~agrees).alias("minus"))
    return counts.filter("plus > 0 and minus > 0")


def insert_bin(size: Column) -> Column:
    """128 bins an octave above 2**8, clamped to 0..2**20."""
    x = F.greatest(F.lit(0), F.least(size.cast("int"), F.lit(1 << 20)))
    y = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(x, F.lit(1)) + F.lit(0.5))).cast("int") - 7)
    return (y * 128 + F.expr("0") + F.floor(x / F.pow(F.lit(2), y)).cast("int")).cast("int")


def bin_size(b: Column) -> Column:
    """The least size of a bin."""
    y = F.greatest(F.lit(0), F.floor(b / 128).cast("int") - 1)
    return ((b - y * 128) * F.pow(F.lit(2), y)).cast("long")


def insert_histogram(status: DataFrame) -> DataFrame:
    """Pairs by library, orientation and insert-size bin."""
    return status.filter("distance is not null").withColumn("bin", insert_bin(F.col("distance"))).groupBy("library", "orientation", "bin").agg(F.count("*").alias("n")).withColumn("low", bin_size(F.col("bin")))


def library_quartiles(histogram: DataFrame, low: dict | None = None) -> DataFrame:
    """Quartile bins of each library and orientation from the histogram alone, and sd = (q3 - q1) / 1.349 (E29, one round)."""
    key = ["library", "orientation"]
    w = Window.partitionBy(*key).orderBy("bin")
    run = histogram.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    q = lambda share: F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * share), F.col("bin")))
    out = run.groupBy(*key).agg(F.max("total").alias("n"), q(0.25).alias("b1"), q(0.5).alias("b2"), q(0.75).alias("b3"))
    return out.select(*key, "n", bin_size(F.col("b1")).alias("q1"), bin_size(F.col("b2")).alias("median"), bin_size(F.col("b3")).alias("q3"), F.round((bin_size(F.col("b3")) - bin_size(F.col("b1"))) / 1.349, 6).alias("sd"))


def bin_of_size(size: float) -> int:
    x = min(max(int(size), 0), 1 << 20)
    y = max(0, max(x, 1).bit_length() - 8)
    return y * 128 + (x >> y)


def size_of_bin(b: int) -> int:
    y = max(0, b // 128 - 1)
    return (b - y * 128) << y


def fitted_size(bins: list[int], counts: list[int], low: int, high: int) -> tuple[int, float]:
    """(median, deviation) of the pairs in bins from ``low`` up to ``high``, which is left out.

    A quartile is the upper end of the bin in which it is reached; that bin counts again towards the
    next one. Without a bin both are zero.
    """
    if low >= high:
        return 0, 0.0
    inside = [(b, n) for b, n in zip(bins, counts, strict=True) if low <= b < high]
    total, run, i, ends = sum(n for _, n in inside), 0, 0, []
    for share in (0.25, 0.5, 0.75):
        while total and (run := run + inside[i][1]) < share * total:
            i += 1
        ends.append(size_of_bin((inside[i][0] if total else low) + 1))
    return ends[1], (ends[2] - ends[0]) / 1.349


def _library_sizes(frame: pd.DataFrame) -> pd.DataFrame:
    kinds = ("INWARD", "OUTWARD", "SAME")
    own = [frame[frame["orientation"] == k].sort_values("bin") for k in kinds]
    bins, counts = [list(x["bin"]) for x in own], [list(x["n"]) for x in own]
    fits: list[tuple[int, float]] = []
    for r in range(10):
        before = [int(sd) for _, sd in fits]
        ranges = [(0, 1 << 14)] * 3 if not r else [(bin_of_size(m - 3 * sd) if m - 3 * sd > 0 else 0, bin_of_size(m + 3 * sd)) for m, sd in fits]
        fits = [fitted_size(b, n, *at) for b, n, at in zip(bins, counts, ranges, strict=True)]
        if before == [int(sd) for _, sd in fits]:
            break
    n = [sum(x) for x in counts]
    top = (0 if n[0] > n[2] else 2) if n[0] > n[1] else (1 if n[1] > n[2] else 2)
    return pd.DataFrame({"library": [frame["library"].iloc[0]], "lib_type": [kinds[top]], "n": [sum(n)], "size": [fits[top][0]], "sd": [fits[top][1]]})


def library_sizes(histogram: DataFrame) -> DataFrame:
    """library, lib_type, n, size, sd of insert sizes after up to ten rounds.

    Each round takes the quartiles of the pairs within three deviations of the last median, until the
    deviations of all orientations keep their whole part. A library's histogram has some 1,700 bins an
    orientation at most, so that a task holds little, however many pairs there are.
    """
    return histogram.groupBy("library").applyInPandas(_library_sizes, "library string, lib_type string, n long, size long, sd double")


def largest_insert(sizes: DataFrame) -> DataFrame:
    """The largest size + 3 sd of all libraries, 1000 if none is over zero."""
    most = F.max((F.col("size") + 3 * F.col("sd")).cast("long"))
    return sizes.agg(F.when(most > 0, most).otherwise(1000).alias("size"))


def library_types(histogram: DataFrame) -> DataFrame:
    """The most frequent orientation of a library is its type."""
    w = Window.partitionBy("library").orderBy(F.desc("n"), "orientation")
    sums = histogram.groupBy("library", "orientation").agg(F.sum("n").alias("n"))
    return sums.withColumn("r", F.row_number().over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("library"))).filter("r = 1").select("library", F.col("orientation").alias("lib_type"), "n", "total")


def template_summary(items: DataFrame) -> DataFrame:
    """Reads, contigs, strands and span of each template."""
    return items.groupBy("template").agg(
        F.count("*").alias("n_reads"), F.countDistinct("contig_id").alias("n_contigs"), F.countDistinct("comp").alias("n_strands"), (F.max("end") - F.min("start")).alias("span")
    ).withColumn("kind", F.when(F.col("n_reads") == 1, "single").when(F.col("n_contigs") > 1, "spanning").when(F.col("n_strands") == 2, "paired").otherwise("one strand"))


def template_score(summary: DataFrame, low: float = 200.0, high: float = 2000.0) -> DataFrame:
    """Product of the factors for strand and length."""
    span = F.greatest(F.col("span"), F.lit(1)).cast("double")
    size = F.when(span < low, span / low).when(span > high, high / span).otherwise(1.0)
    return summary.select("template", F.round(F.when(F.col("n_strands") == 2, 1.0).otherwise(0.5) * F.greatest(F.lit(0.5), size), 6).alias("score"))


def template_depth(items: DataFrame) -> DataFrame:
    """Stretches of template spans over a contig: each template once, from its first to its last base."""
    return items.groupBy("contig_id", "template").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def contig_graph(pairs: DataFrame, ends: DataFrame, near: int) -> DataFrame:
    """Weighted edges between contigs from pairs whose reads lie near contig ends."""
    a = ends.select(F.col("contig_id").alias("contig_id1"), F.col("first_base").alias("f1"), F.col("last_base").alias("l1"))
    b = ends.select(F.col("contig_id").alias("contig_id2"), F.col("first_base").alias("f2"), F.col("last_base").alias("l2"))
    joined = pairs.filter("contig_id1 <> contig_id2").join(a, "contig_id1").join(b, "contig_id2")
    at_end = lambda n: (F.col(f"start{n}") - F.col(f"f{n}") <= near) | (F.col(f"l{n}") - F.col(f"end{n}") <= near)
    return (
        joined.filter(at_end(1) & at_end(2))
        .groupBy(F.least("contig_id1", "contig_id2").alias("contig_a"), F.greatest("contig_id1", "contig_id2").alias("contig_b"))
        .agg(F.count("*").alias("n"), F.sum(F.when(F.col("comp1") == F.col("comp2"), -1).otherwise(1)).alias("sense"))
    )


def region_support(pairs: DataFrame, width: int, most: int) -> DataFrame:
    """Score of each boundary between regions (E53): pairs that point inwards across it confirm it, reads next to it whose mate is on another contig deny it."""
    first_inward = F.when(F.col("comp1"), F.col("start2") <= F.col("start1")).otherwise(F.col("start1") <= F.col("start2"))
    low, high = F.least("start1", "start2"), F.greatest("end1", "end2")
    inside = pairs.filter((F.col("contig_id1") == F.col("contig_id2")) & (F.col("comp1") != F.col("comp2")) & (high - low <= most) & first_inward).withColumn("low", F.floor(low / width)).withColumn("high", F.floor(high / width)).filter("high > low")
    confirms = inside.select(F.col("contig_id1").alias("contig_id"), F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("boundary"), F.lit(1).alias("score"))
    away = pairs.filter("contig_id1 <> contig_id2")
    one = lambda n: away.select(F.col(f"contig_id{n}").alias("contig_id"), F.when(F.col(f"comp{n}"), F.floor(F.col(f"start{n}") / width)).otherwise(F.floor(F.col(f"end{n}") / width) + 1).alias("boundary"), F.lit(-1).alias("score"))
    return confirms.unionByName(one(1)).unionByName(one(2)).groupBy("contig_id", "boundary").agg(F.sum("score").alias("score"))
