"""Contigs made longer by what the clipped parts of their last reads agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns looked at before a contig's end, and behind it.
REACH = 1024


def mirrored(df: DataFrame, low: str, high: str) -> DataFrame:
    """Intervals seen from the other end: columns change sign."""
    return df.withColumns({low: -F.col(high), high: -F.col(low)})


def both_ends(items: DataFrame) -> DataFrame:
    """Reads twice, as seen from each end of their contig (side: left, right); left ones are mirrored."""
    own = items.select("contig_id", "rec", "start", "end", "vstart", "vend")
    return own.withColumn("side", F.lit("right")).unionByName(mirrored(mirrored(own, "start", "end"), "vstart", "vend").withColumn("side", F.lit("left")))


def end_reads(items: DataFrame, reach: int = REACH) -> DataFrame:
    """Reads over the last visible column of a side of their contig whose visible part ends less than ``reach`` before it: contig_id, side, rec, vend, last.

    Columns of left sides are mirrored.
    """
    seen = both_ends(items)
    last = seen.groupBy("contig_id", "side").agg(F.max("vend").alias("last"))
    return seen.join(last, ["contig_id", "side"]).filter((F.col("start") <= F.col("last")) & (F.col("last") <= F.col("end")) & (F.col("last") - F.col("vend") < reach)).select("contig_id", "side", "rec", "vend", "last")


def extensions(reads: DataFrame, bases: DataFrame, calls: DataFrame, least_depth: int, match: int = 1, mismatch: int = -3, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """New columns of contigs and new clips of reads.

    ``reads`` as ``end_reads`` gives them, ``bases`` (contig_id, pos, rec, code) of these reads, clipped parts too, ``calls`` (contig_id, pos, base).

    A read whose clipped part up to the contig's end differs from the consensus in over 5 of 100 columns is left out (whole per cent, cut).
    Behind the end each column calls its commonest base (equal: A, C, G, T as seen along the side; pads and unknown ones don't count),
    until fewer than ``least_depth`` bases are there; a column scores (called - others) / all, and the contig grows by the longest of
    the prefixes with the best sum, if that isn't below 0. Scores are whole numbers of 1e-9, so equal sums are equal.
    The first table has contig_id, side, grown and sequence (as it reads outward, complemented on the left); contigs that
    don't grow aren't in it. The second has contig_id, side, rec and clip, how many of the new columns a read now shows: up to the last match
    with the best sum of ``match`` and ``mismatch`` that isn't below 0; reads without such a match keep their clips and aren't in it.
    """
    left = F.col("side") == "left"
    code = F.when(left & (F.col("code") < 4), 3 - F.col("code")).otherwise(F.col("code"))
    seen = bases.select("contig_id", "rec", "pos", "code").join(reads, ["contig_id", "rec"])
    seen = seen.withColumns({"place": F.when(left, -F.col("pos")).otherwise(F.col("pos")) - F.col("last"), "code": code})
    seen = seen.filter((F.col("place") > F.col("vend") - F.col("last")) & (F.col("place") <= reach))
    # what a clipped part says before the end, against the calls there
    checked = seen.filter("place <= 0").join(calls.select("contig_id", "pos", "base"), ["contig_id", "pos"], "left")
    letter = F.substring(F.lit("ACGT*N"), F.when(left & (F.col("code") < 4), 3 - F.col("code")).otherwise(F.col("code")) + 1, F.lit(1))
    wrong = checked.groupBy("contig_id", "side", "rec").agg(F.count_if(F.coalesce(letter != F.col("base"), F.lit(True))).alias("bad"), F.count("*").alias("n"))
    bad = wrong.filter(F.expr("(100 * bad) div n > 5")).select("contig_id", "side", "rec")
    kept = seen.filter("place > 0").join(bad, ["contig_id", "side", "rec"], "left_anti")
    # the columns behind the end
    counts = [F.count_if(F.col("code") == c).alias(f"n{c}") for c in range(4)]
    columns = kept.filter("code < 4").groupBy("contig_id", "side", "place").agg(F.count("*").alias("depth"), *counts).filter(F.col("depth") >= least_depth)
    most = F.greatest("n0", "n1", "n2", "n3")
    call = F.when(F.col("n0") == most, 0).when(F.col("n1") == most, 1).when(F.col("n2") == most, 2).otherwise(3)
    along = Window.partitionBy("contig_id", "side").orderBy("place")
    gain = F.round((2 * most - F.col("depth")) / F.col("depth") * 1e9).cast("long")
    unbroken = columns.withColumn("call", call).withColumn("i", F.row_number().over(along)).filter("i = place").withColumn("score", F.sum(gain).over(along))
    best = unbroken.filter("score >= 0").groupBy("contig_id", "side").agg(F.max_by("place", F.struct("score", "place")).alias("grown"))
    new = unbroken.join(best, ["contig_id", "side"]).filter("place <= grown")
    sequence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "call"))), lambda x: F.substring(F.lit("ACGT"), x["call"] + 1, F.lit(1))), "")
    grown = new.groupBy("contig_id", "side", "grown").agg(sequence.alias("sequence"))
    # how far each read goes along
    along_read = Window.partitionBy("contig_id", "side", "rec").orderBy("place")
    told = kept.join(new.select("contig_id", "side", "place", "call"), ["contig_id", "side", "place"]).withColumn("same", F.col("code") == F.col("call"))
    scored = told.withColumn("score", F.sum(F.when(F.col("same"), match).otherwise(mismatch)).over(along_read)).filter("same and score >= 0")
    clips = scored.groupBy("contig_id", "side", "rec").agg(F.max_by("place", F.struct("score", "place")).alias("clip"))
    return grown, clips
