"""Range scans, coverage, contig geometry and contig edits over interval tables (contig_id, start, end, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(items: DataFrame, low: int, high: int, start: str = "start", end: str = "end") -> DataFrame:
    """Items that touch [low, high]."""
    return items.filter((F.col(start) <= high) & (F.col(end) >= low))


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Pairs of overlapping intervals of a key: an equi-join on (key, bin) that reports each pair in one bin only.

    ``left`` has start, end; ``right`` has rstart, rend. The pair belongs to the bin of the later start.
    """
    lb = left.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    rb = right.withColumn("_bin", F.explode(F.sequence(F.expr(f"rstart div {width}"), F.expr(f"rend div {width}"))))
    return (
        lb.join(rb, [key, "_bin"])
        .filter((F.col("start") <= F.col("rend")) & (F.col("end") >= F.col("rstart")))
        .filter(F.floor(F.greatest("start", "rstart") / width) == F.col("_bin"))
        .drop("_bin")
    )


def depth_steps(items: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(contig_id, low, high, depth): the runs of equal depth, zero included between first and last base.

    +1 at each start and -1 after each end, added up a position before the window, so a deep
    column is one row and a contig's window holds no more rows than it has positions.
    """
    events = items.select("contig_id", F.col(start).alias("pos"), F.lit(1).alias("d")).unionByName(items.select("contig_id", (F.col(end) + 1).alias("pos"), F.lit(-1).alias("d")))
    steps = events.groupBy("contig_id", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("contig_id").orderBy("pos")
    return (
        steps.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("high", F.lead("pos").over(w) - 1)
        .filter("high is not null")
        .select("contig_id", F.col("pos").alias("low"), "high", "depth")
    )


def bucket_depth(items: DataFrame, width: int) -> DataFrame:
    """Bases of each bucket of ``width`` columns and their whole-number mean depth."""
    parts = items.withColumn("bucket", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    bases = F.least(F.col("end"), (F.col("bucket") + 1) * width - 1) - F.greatest(F.col("start"), F.col("bucket") * width) + 1
    return parts.groupBy("contig_id", "bucket").agg(F.sum(bases).alias("n_bases")).withColumn("avg_depth", F.expr(f"n_bases div {width}"))


def bucket_range(items: DataFrame, width: int) -> DataFrame:
    """Least, largest and mean depth of the covered stretch in each bucket."""
    steps = depth_steps(items).withColumn("bucket", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"high div {width}"))))
    n = F.least(F.col("high"), (F.col("bucket") + 1) * width - 1) - F.greatest(F.col("low"), F.col("bucket") * width) + 1
    return steps.groupBy("contig_id", "bucket").agg(
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.round(F.sum(F.col("depth") * n) / F.sum(n), 6).alias("mean_depth")
    )


def depth_levels(items: DataFrame, widths: list[int]) -> DataFrame:
    """The depth track at several resolutions: coarse levels add up the finest one."""
    finest = bucket_depth(items, widths[0]).select("contig_id", "bucket", "n_bases")
    out = None
    for width in widths:
        own = finest.withColumn("bucket", F.expr(f"bucket div {width // widths[0]}")).groupBy("contig_id", "bucket").agg(F.sum("n_bases").alias("n_bases"))
        own = own.select(F.lit(width).alias("width"), "contig_id", "bucket", F.expr(f"n_bases div {width}").alias("avg_depth"))
        out = own if out is None else out.unionByName(own)
    return out


def covered_islands(items: DataFrame, start: str, end: str) -> DataFrame:
    """Maximal covered runs of a contig, numbered from left (F32)."""
    w = Window.partitionBy("contig_id").orderBy(start, end)
    # intervals with the same start: only the furthest matters
    far = items.groupBy("contig_id", start).agg(F.max(end).alias(end))
    reach = far.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + 1), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("contig_id", "island").agg(F.min(start).alias("low"), F.max(end).alias("high"))


def holes(items: DataFrame, start: str, end: str) -> DataFrame:
    """Runs between the covered islands of a contig."""
    w = Window.partitionBy("contig_id").orderBy("low")
    return covered_islands(items, start, end).withColumn("next", F.lead("low").over(w)).filter("next is not null").select("contig_id", (F.col("high") + 1).alias("hole_start"), (F.col("next") - 1).alias("hole_end"))


def contig_ranges(items: DataFrame) -> DataFrame:
    """Unclipped and visible range, reads and bases of each contig."""
    return items.groupBy("contig_id").agg(
        F.min("start").alias("first_base"), F.max("end").alias("last_base"), F.min("vstart").alias("first_visible"), F.max("vend").alias("last_visible"),
        F.count("*").alias("n_reads"), F.sum("length").alias("n_bases"), F.round(F.avg(F.col("vend") - F.col("vstart") + 1), 6).alias("mean_used"),
    )


def strand_coverage(items: DataFrame, width: int) -> DataFrame:
    """Reads by strand in each bucket and whether a strand is missing."""
    parts = items.withColumn("bucket", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    counts = parts.groupBy("contig_id", "bucket").agg(F.count(F.when(~F.col("comp"), 1)).alias("forward"), F.count(F.when(F.col("comp"), 1)).alias("reverse"))
    return counts.withColumn("single_strand", (F.col("forward") == 0) | (F.col("reverse") == 0))


def single_read_contigs(items: DataFrame) -> DataFrame:
    """Contigs of one read."""
    return items.groupBy("contig_id").agg(F.count("*").alias("n"), F.min("rec").alias("rec")).filter("n = 1").select("contig_id", "rec")


def break_contigs(items: DataFrame, at: int, new_id: Column) -> DataFrame:
    """Reads whose visible start is at or beyond the snapped position move to a new contig.

    The position snaps to the smallest visible start at or beyond ``at``; contigs with an empty side stay whole.
    """
    snap = items.groupBy("contig_id").agg(F.min(F.when(F.col("vstart") >= at, F.col("vstart"))).alias("cpos"), F.min("vstart").alias("least"))
    moved = items.join(snap, "contig_id").withColumn("moves", F.coalesce((F.col("vstart") >= F.col("cpos")) & (F.col("least") < F.col("cpos")), F.lit(False)))
    return moved.withColumn("contig_id", F.when(F.col("moves"), new_id).otherwise(F.col("contig_id"))).drop("cpos", "least", "moves")


def complement_contigs(items: DataFrame) -> DataFrame:
    """Mirrors each contig on its used range and flips orientations."""
    used = items.groupBy("contig_id").agg(F.min("start").alias("ustart"), F.max("end").alias("uend"))
    mirror = F.col("ustart") + F.col("uend")
    return (
        items.join(used, "contig_id")
        .withColumn("new_start", mirror - F.col("end"))
        .withColumn("new_end", mirror - F.col("start"))
        .withColumn("new_comp", ~F.col("comp"))
        .drop("ustart", "uend")
    )


def shift_items(items: DataFrame, at: int, by: int) -> DataFrame:
    """Items at or right of a position move; those that span it grow (K4, K6)."""
    return items.withColumn("new_start", F.when(F.col("start") >= at, F.col("start") + by).otherwise(F.col("start"))).withColumn("new_end", F.when(F.col("end") >= at, F.col("end") + by).otherwise(F.col("end")))


def disassemble(items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, the removed reads as contigs of their own)."""
    stays = items.join(gone.select("rec"), "rec", "left_anti")
    return stays, items.join(gone.select("rec"), "rec", "left_semi").withColumn("contig_id", -F.col("rec"))


def violations(items: DataFrame) -> DataFrame:
    """Structural checks of reads: one row a failed check."""
    checks = {
        "empty": F.col("length") < 1, "span": F.col("end") - F.col("start") + 1 != F.col("length"), "left_clip": (F.col("lclip") < 1) | (F.col("lclip") > F.col("length")),
        "right_clip": (F.col("rclip") < F.col("lclip")) | (F.col("rclip") > F.col("length")), "no_quality": F.col("mqual") <= 0, "short": F.col("rclip") - F.col("lclip") < 4,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return items.select("contig_id", "rec", F.explode(found).alias("problem"))
