"""Edits of reads, contigs, tags, libraries and notes as DataFrames: each returns the table after the edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_bases(seq: Column, place: Column, added: Column) -> Column:
    """Bases put before a 1-based place (K1)."""
    return F.concat(F.substring(seq, F.lit(1), place - 1), added, F.substring(seq, place, F.length(seq)))


def delete_bases(seq: Column, place: Column, n: Column) -> Column:
    """``n`` bases taken out from a 1-based place (K2)."""
    return F.concat(F.substring(seq, F.lit(1), place - 1), F.substring(seq, place + n, F.length(seq)))


def replace_base(seq: Column, place: Column, base: Column) -> Column:
    """K3."""
    return F.overlay(seq, base, place, F.lit(1))


def shifted(items: DataFrame, place: Column, n: int) -> DataFrame:
    """Tags or reads after n bases were inserted (n > 0) or deleted (n < 0) at a place of their contig.

    Ends inside the deleted stretch move to its start; what lay wholly inside it is gone.
    """
    def moved(c: str) -> Column:
        return F.when(F.col(c) < place, F.col(c)).otherwise(F.greatest(F.col(c) + n, place))

    out = items.withColumn("new_start", moved("start")).withColumn("new_end", F.when(F.col("end") < place, F.col("end")).otherwise(F.greatest(F.col("end") + n, place - (1 if n < 0 else 0))))
    return out.filter(F.col("new_end") >= F.col("new_start"))


def moved_contigs(items: DataFrame, by: DataFrame) -> DataFrame:
    """Contigs moved by an offset each (K7); ``by`` has contig_id, offset."""
    return items.join(by, "contig_id", "left").select("rec", "contig_id", (F.col("start") + F.coalesce("offset", F.lit(0))).alias("start"), (F.col("end") + F.coalesce("offset", F.lit(0))).alias("end"))


def from_visible_start(items: DataFrame) -> DataFrame:
    """Contigs renumbered so that their first visible base is 1 (K8): one aggregate a contig."""
    first = items.groupBy("contig_id").agg(F.min("vstart").alias("first"))
    return items.join(first, "contig_id").select("rec", "contig_id", (F.col("start") - F.col("first") + 1).alias("start"), (F.col("end") - F.col("first") + 1).alias("end"))


def added_members(members: DataFrame, added: DataFrame) -> DataFrame:
    """Contigs appended to scaffolds after their last member (K15); ``added`` has scaffold_id, contig_id."""
    last = members.groupBy("scaffold_id").agg(F.max("idx").alias("last"))
    w = Window.partitionBy("scaffold_id").orderBy("contig_id")
    new = added.join(last, "scaffold_id", "left").select("scaffold_id", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).alias("idx"), "contig_id")
    return members.select("scaffold_id", "idx", "contig_id").unionByName(new)


def removed_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Contigs taken out of scaffolds, the others numbered anew."""
    w = Window.partitionBy("scaffold_id").orderBy("idx")
    return members.join(gone.select("contig_id").distinct(), "contig_id", "left_anti").select("scaffold_id", F.row_number().over(w).alias("idx"), "contig_id")


def split_tags(tags: DataFrame, place: Column, new_contig: Column) -> DataFrame:
    """Tags of contigs broken at a place: a tag across it becomes two, the right part counts from the new contig's start."""
    parts = F.array(
        F.struct(F.col("contig_id").alias("contig_id"), F.col("start").alias("start"), F.least(F.col("end"), place - 1).alias("end")),
        F.struct(new_contig.alias("contig_id"), (F.greatest(F.col("start"), place) - place).alias("start"), (F.col("end") - place).alias("end")),
    )
    kept = F.filter(parts, lambda p: p["end"] >= p["start"])
    return tags.select("tag_id", F.explode(kept).alias("p")).select("tag_id", "p.*")


def renumbered(items: DataFrame, order: list[Column]) -> DataFrame:
    """Reads of each contig in a new order of relationships."""
    w = Window.partitionBy("contig_id").orderBy(*order)
    return items.select("contig_id", "rec", F.row_number().over(w).alias("place"), F.lag("rec").over(w).alias("left_rec"), F.lead("rec").over(w).alias("right_rec"))


def contig_problems(items: DataFrame, members: DataFrame) -> DataFrame:
    """Reads in no known contig, contigs in several scaffolds, templates on more than two contigs."""
    single = members.groupBy("contig_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("in several scaffolds").alias("problem"), F.col("contig_id").alias("of"))
    loose = items.join(members.select("contig_id").distinct(), "contig_id", "left_anti").select(F.lit("contig without scaffold").alias("problem"), F.col("contig_id").alias("of")).distinct()
    spread = items.groupBy("template").agg(F.countDistinct("contig_id").alias("n")).filter("n > 2").select(F.lit("template on many contigs").alias("problem"), F.col("template").alias("of"))
    return single.unionByName(loose).unionByName(spread)
