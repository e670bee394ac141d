"""Look-ups by name, searches along contigs, orders, and lists of reads, contigs and scaffolds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(items: DataFrame) -> DataFrame:
    """Adds the names of reads, templates and contigs."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return items.withColumn("name", name("r", "rec")).withColumn("template_name", name("t", "template")).withColumn("contig_name", name("ctg", "contig_id"))


def number_after(ref: Column, prefix: str) -> Column:
    """The number behind a prefix, null where the reference has another form."""
    return F.when(ref.rlike(f"^{prefix}[0-9]+$"), F.substring(ref, len(prefix) + 1, 20).cast("long"))


def resolve_contigs(refs: DataFrame, items: DataFrame) -> DataFrame:
    """(ref, contig_id) of '#read', '=contig', contig names and read names; null where nothing has it (C14, H7, H8)."""
    ref = F.col("ref")
    parsed = refs.select("ref", F.coalesce(number_after(ref, "#"), number_after(ref, "r")).alias("rec"), F.coalesce(number_after(ref, "="), number_after(ref, "ctg")).alias("number"))
    reads = items.select("rec", F.col("contig_id").alias("of_read"))
    contigs = items.select(F.col("contig_id").alias("number")).distinct().withColumn("of_number", F.col("number"))
    return parsed.join(reads, "rec", "left").join(contigs, "number", "left").select("ref", F.coalesce("of_read", "of_number").alias("contig_id"))


def resolve_records(refs: DataFrame, items: DataFrame) -> DataFrame:
    """(ref, rec) of read names, '#read' and template names, which stand for their first read."""
    ref = F.col("ref")
    parsed = refs.select("ref", F.coalesce(number_after(ref, "#"), number_after(ref, "r")).alias("named"), number_after(ref, "t").alias("template"))
    reads = items.select(F.col("rec").alias("named"), F.col("rec").alias("of_name"))
    templates = items.groupBy("template").agg(F.min("rec").alias("of_template"))
    return parsed.join(reads, "named", "left").join(templates, "template", "left").select("ref", F.coalesce("of_name", "of_template").alias("rec"))


def searched_position(spec: Column, cursor: int, base: Column) -> Column:
    """'123' is absolute, '@123' counts from ``base``, '+5' and '-5' from the cursor."""
    number = F.regexp_extract(spec, "([0-9]+)$", 1).cast("long")
    return F.when(spec.startswith("@"), base + number).when(spec.startswith("+"), number + cursor).when(spec.startswith("-"), F.lit(cursor) - number).otherwise(number)


def plot_filter(pairs: DataFrame, mode: int = 0, low: int = 0, high: int = 255) -> DataFrame:
    """Pairs with their quality for a plot and whether they span contigs (C37, S45): mean, least or largest mapping quality by mode, times 3, within 0..255."""
    q = {0: F.floor((F.col("mqual1") + F.col("mqual2")) / 2), 1: F.least("mqual1", "mqual2"), 2: F.greatest("mqual1", "mqual2")}[mode]
    return pairs.select("rec1", "rec2", F.greatest(F.lit(0), F.least(F.lit(255), 3 * q)).cast("int").alias("quality"), (F.col("contig_id1") != F.col("contig_id2")).alias("spans")).filter((F.col("quality") >= low) & (F.col("quality") <= high))


def qualifiers(text: Column) -> Column:
    """'/key="value"' pairs of a feature as a map."""
    pairs = F.regexp_extract_all(text, F.lit('/([a-z_]+="[^"]*")'), 1)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, '"([^"]*)"', 1).alias("value"))))


def with_mates(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reads of a list and their mates, each once."""
    mates = pairs.select(F.col("rec1").alias("rec"), F.col("rec2").alias("mate")).unionByName(pairs.select(F.col("rec2").alias("rec"), F.col("rec1").alias("mate")))
    return chosen.select("rec").unionByName(chosen.join(mates, "rec").select(F.col("mate").alias("rec"))).distinct()


def ranked(rows: DataFrame, order: list[Column], most: int, within: list[str] | None = None) -> DataFrame:
    """The first ``most`` rows of an order with their ranks (G1..G13); without ``within`` a global top-k, which Spark takes in each task first."""
    if within:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("place") <= most)
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # most rows


def contig_links(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Links between contigs with positions from the nearer end: 0 left, 1 right."""
    side = lambda n: ends.select(F.col("contig_id").alias(f"contig_id{n}"), F.col("first_base").alias(f"f{n}"), F.col("last_base").alias(f"l{n}"))
    joined = pairs.filter("contig_id1 <> contig_id2").join(side(1), "contig_id1").join(side(2), "contig_id2")
    end = lambda n: (F.col(f"start{n}") - F.col(f"f{n}") > F.col(f"l{n}") - F.col(f"start{n}")).cast("int")
    offset = lambda n: F.least(F.col(f"start{n}") - F.col(f"f{n}"), F.col(f"l{n}") - F.col(f"start{n}"))
    return joined.select("template", "rec1", "contig_id1", end(1).alias("end1"), offset(1).alias("pos1"), "contig_id2", end(2).alias("end2"), offset(2).alias("pos2"))


def link_positions(links: DataFrame, ends: DataFrame) -> DataFrame:
    """Absolute positions of both sides of each link."""
    side = lambda n: ends.select(F.col("contig_id").alias(f"contig_id{n}"), F.col("first_base").alias(f"f{n}"), F.col("last_base").alias(f"l{n}"))
    at = lambda n: F.when(F.col(f"end{n}") == 0, F.col(f"f{n}") + F.col(f"pos{n}")).otherwise(F.col(f"l{n}") - F.col(f"pos{n}")).alias(f"at{n}")
    return links.join(side(1), "contig_id1").join(side(2), "contig_id2").select("template", "rec1", at(1), at(2))


def last_marker(points: DataFrame, markers: DataFrame, at: str, marker_at: str, value: str) -> DataFrame:
    """As-of join by contig: ``value`` of the last marker at or before each point, and where it stands.

    Markers and points meet in one window of a contig's bucket order; no pairs are formed.
    """
    both = points.withColumn("_m", F.lit(None).cast("long")).withColumn("_v", F.lit(None).cast("long")).withColumn("_p", F.col(at)).withColumn("_k", F.lit(1))
    marks = markers.select("contig_id", F.col(marker_at).alias("_p"), F.col(marker_at).alias("_m"), F.col(value).alias("_v"), F.lit(0).alias("_k"))
    w = Window.partitionBy("contig_id").orderBy("_p", "_k", "_v").rowsBetween(Window.unboundedPreceding, 0)
    united = both.unionByName(marks, allowMissingColumns=True)
    return united.withColumn("marker", F.last("_m", True).over(w)).withColumn("marked", F.last("_v", True).over(w)).filter("_k = 1").drop("_m", "_v", "_p", "_k")


def contig_lists(items: DataFrame, chosen: list[int]) -> DataFrame:
    """The reads of listed contigs (H5)."""
    return items.filter(F.col("contig_id").isin(chosen)).select("contig_id", "rec")


def appended(*lists: DataFrame) -> DataFrame:
    """Lists one after another, repeated items kept (H1)."""
    return reduce(DataFrame.unionByName, lists)


def list_items(lists: DataFrame, ends: DataFrame) -> DataFrame:
    """'contig', 'contig start' or 'contig start end' items with missing bounds taken from the contig (H7)."""
    f = F.split("item", " ")
    parsed = lists.select("item", f[0].cast("long").alias("contig_id"), F.try_element_at(f, F.lit(2)).cast("long").alias("s"), F.try_element_at(f, F.lit(3)).cast("long").alias("e"))
    return parsed.join(ends, "contig_id").select("item", "contig_id", F.coalesce("s", "first_base").alias("start"), F.coalesce("e", "last_base").alias("end"))


def template_sets(items: DataFrame) -> DataFrame:
    """Of each contig the sets of templates of either strand, their union and what both hold."""
    sets = items.groupBy("contig_id").agg(F.collect_set(F.when(~F.col("comp"), F.col("template"))).alias("a"), F.collect_set(F.when(F.col("comp"), F.col("template"))).alias("b"))
    return sets.select("contig_id", F.size(F.array_union("a", "b")).alias("in_either"), F.size(F.array_intersect("a", "b")).alias("in_both"))
