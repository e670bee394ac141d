"""List algebra, tags, scaffolds and text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_occurrences(items: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct items, each at its last place (H2, H3)."""
    return items.groupBy(key).agg(F.max(order).alias("place"))


def subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """H4."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def prune_tags(tags: DataFrame, priority: Column) -> DataFrame:
    """One tag a place: the best by priority, then the smallest id."""
    w = Window.partitionBy("contig_id", "start").orderBy(priority, "tag_id")
    return tags.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def format_tag(t: str = "type", d: str = "dir", low: str = "start", high: str = "end", comment: str = "comment") -> Column:
    """'TYPE dir low..high' and the comment on a line of its own."""
    return F.concat(F.col(t), F.lit(" "), F.col(d), F.lit(" "), F.col(low).cast("string"), F.lit(".."), F.col(high).cast("string"), F.lit("\n"), F.col(comment))


def parse_tag(text: Column) -> Column:
    """The inverse: type, strand (0 +, 1 -, 2 other), start, end, comment."""
    part = lambda i: F.regexp_extract(text, r"(?s)^(.{4}) (.) (-?\d+)\.\.(-?\d+)\n(.*)$", i)
    return F.struct(
        part(1).alias("type"), F.when(part(2) == "+", 0).when(part(2) == "-", 1).otherwise(2).alias("strand"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end"), part(5).alias("comment")
    )


def agp(members: DataFrame) -> DataFrame:
    """AGP rows of each scaffold: a gap of the member's size before every member but the first, always '+' (B13)."""
    w = Window.partitionBy("scaffold_id").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.col("idx") > 1, F.col("gap_size")).otherwise(0)
    placed = members.withColumn("gap", gap).withColumn("at", F.coalesce(F.sum(gap + F.col("length")).over(before), F.lit(0)) + 1)
    rows = F.array(
        F.struct((2 * F.col("idx") - 2).alias("part"), F.col("at").alias("low"), (F.col("at") + F.col("gap") - 1).alias("high"), F.lit("N").alias("kind"), F.lit(None).cast("long").alias("contig_id"), F.col("gap").alias("size")),
        F.struct((2 * F.col("idx") - 1).alias("part"), (F.col("at") + F.col("gap")).alias("low"), (F.col("at") + F.col("gap") + F.col("length") - 1).alias("high"), F.lit("W").alias("kind"), F.col("contig_id").alias("contig_id"), F.col("length").alias("size")),
    )
    return placed.select("scaffold_id", F.explode(rows).alias("r")).select("scaffold_id", "r.*").filter("kind = 'W' or size > 0")


def complement_scaffold(members: DataFrame) -> DataFrame:
    """Members in reverse order, each complemented; a gap stays between its two contigs."""
    w = Window.partitionBy("scaffold_id").orderBy(F.desc("idx"))
    return members.select("scaffold_id", F.row_number().over(w).alias("idx"), (-F.col("contig_id")).alias("contig_id"), F.coalesce(F.lag("gap_size").over(w), F.lit(0)).alias("gap_size"))


def fastq(records: DataFrame, name: str, seq: str, quals: Column) -> DataFrame:
    """FASTQ text of each record; pads are skipped."""
    return records.select(F.concat(F.lit("@"), F.col(name).cast("string"), F.lit("\n"), F.replace(F.col(seq), F.lit("*"), F.lit("")), F.lit("\n+\n"), quals).alias("value"))


def fasta(records: DataFrame, name: str, seq: str, width: int = 60) -> DataFrame:
    """FASTA text of each record, pads kept."""
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    return records.select(F.col(name).alias("id"), F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), wrapped).alias("value"))
