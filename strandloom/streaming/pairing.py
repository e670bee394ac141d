"""Bounded pairing of reads as a stream: mates meet within a time bound, the rest is given up.

The analogue of a pairing queue of limited length: a watermark bounds the state, so the memory of
a long run does not grow with the number of reads that never meet their mate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_pairs(reads: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Inner stream-stream join of ends 1 and 2 of a template. ``reads``: template, end_no, rec, ts."""
    one = reads.filter("end_no = 1").select(F.col("template"), F.col("rec").alias("rec1"), F.col("ts").alias("ts1")).withWatermark("ts1", late)
    two = reads.filter("end_no = 2").select(F.col("template").alias("template2"), F.col("rec").alias("rec2"), F.col("ts").alias("ts2")).withWatermark("ts2", late)
    near = (F.col("ts2") >= F.col("ts1") - F.expr(f"interval {within}")) & (F.col("ts2") <= F.col("ts1") + F.expr(f"interval {within}"))
    return one.join(two, (F.col("template") == F.col("template2")) & near).select("template", "rec1", "rec2")


def stream_depth(reads: DataFrame, width: int, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Reads that arrive in each window of time, by contig and bucket of start positions."""
    return (
        reads.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "contig_id", F.expr(f"start div {width}").alias("bucket"))
        .agg(F.count("*").alias("n_reads"))
        .select(F.col("window.start").alias("at"), "contig_id", "bucket", "n_reads")
    )
