"""Readers and writers of sequence formats as DataFrames; Spark's codecs open .gz files by their suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(path: str) -> str:
    """Format by suffix, looking through compression suffixes (A2): fasta, fastq, sam, gff, agp, exp or ''."""
    name = path.lower()
    for end in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(end)
    known = {"fa": "fasta", "fasta": "fasta", "fna": "fasta", "fq": "fastq", "fastq": "fastq", "sam": "sam", "gff": "gff", "gff3": "gff", "agp": "agp", "exp": "exp"}
    return known.get(name.rpartition(".")[2], "")


def sniffed(name: Column) -> Column:
    """The same over a column of names."""
    end = F.regexp_extract(F.regexp_replace(F.lower(name), r"\.(gz|bz2|zst)$", ""), r"\.([a-z0-9]+)$", 1)
    known = {"fasta": ("fa", "fasta", "fna"), "fastq": ("fq", "fastq"), "sam": ("sam",), "gff": ("gff", "gff3"), "agp": ("agp",), "exp": ("exp",)}
    out = F.lit("")
    for kind, ends in known.items():
        out = F.when(end.isin(*ends), kind).otherwise(out)
    return out


#: Sequencing platforms and their codes.
PLATFORMS = {"illumina": 2, "solexa": 2, "abi": 1, "capillary": 1, "sanger": 1, "454": 4, "ls454": 4, "solid": 3}


def platform_code(name: Column) -> Column:
    """The code of a platform's name, 0 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv]), F.lower(name)), F.lit(0))


def platform_of_name(name: Column) -> Column:
    """The platform that a read's name looks like, 0 for none (A16): 14 letters and digits, VAB_, IL and a digit or exactly
    four colons, and after the first point p or q, a digit and k."""
    colons = F.length(name) - F.length(F.replace(name, F.lit(":"), F.lit("")))
    return F.when(name.rlike("^[A-Za-z0-9]{14}$"), 4).when(name.startswith("VAB_"), 3).when(name.rlike("^IL[0-9]") | (colons == 4), 2).when(name.rlike("^[^.]*[.][pq][0-9]k"), 1).otherwise(0)


def unescaped(text: Column) -> Column:
    """%XX stands for a byte; other signs of per cent, and plus signs, for themselves."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), "[+]", "%2B")
    return F.url_decode(safe)


def annotation_tags(text: Column) -> Column:
    """The annotation tags of an alignment, 'start;end;strand;type;text' parted by '|', as an array.

    Type and text may have %XX; text is optional and loses a leading 'Note='. What follows the first tag
    that has another form is not read. Null and empty texts have no tags.
    """
    pattern = r"(?s)^\s*([+-]?[0-9]+);\s*([+-]?[0-9]+);(.);([^;]*)(?:;(.*))?$"
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "[|]"), lambda x: x != "")
    # bound once: what a lambda captures is worked out anew for each element
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    good = bound(parts, lambda ps: bound(F.array_position(F.transform(ps, lambda x: x.rlike(pattern)), F.lit(False)), lambda bad: F.when(bad == 0, ps).otherwise(F.slice(ps, F.lit(1), bad.cast("int") - 1))))
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(
        good,
        lambda x: F.struct(
            part(x, 1).cast("long").alias("start"), part(x, 2).cast("long").alias("end"), part(x, 3).alias("strand"), unescaped(part(x, 4)).alias("type"), F.regexp_replace(unescaped(part(x, 5)), "^Note=", "").alias("note")
        ),
    )


def parse_position(line: Column) -> Column:
    """'name sense offset tolerance' of a directed assembly."""
    f = F.split(line, " +")
    return F.struct(f[0].alias("name"), f[1].alias("sense"), f[2].cast("long").alias("offset"), f[3].cast("int").alias("tolerance"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word), description, seq (A4): records are split by '>' at a line's start, so files split in tasks."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path).filter("value <> ''"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """Records in ``value``, with or without the leading '>'."""
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    head = F.substring_index(record, "\n", 1)
    body = F.when(F.contains(record, F.lit("\n")), F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n", ""), r"\s", "")).otherwise("")
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("seq")).filter("name <> ''")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, quals array<int> of four-line records (A5, A6): quality is the character less 33, clamped to 0..100.

    A quality line may begin with '@', so records are found by counting lines from the file's start:
    one file is one task's work, and large runs are read from many files.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    n = F.expr("size(l) div 4")
    records = lines.filter(n > 0).select(F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col("l"), i * 4 + 1, 4))).alias("r"))
    quals = F.transform(F.split(F.element_at("r", 4), ""), lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.ascii(c) - 33)))
    return records.filter(F.element_at("r", 1).startswith("@")).select(
        F.regexp_extract(F.element_at("r", 1), r"^@(\S*)", 1).alias("name"), F.upper(F.element_at("r", 2)).alias("seq"), F.slice(quals, 1, F.length(F.element_at("r", 2))).alias("quals")
    )


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def reference_length(cigar: Column) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0))


def read_sam(spark: SparkSession, path: str, unmapped: bool = False, duplicates: bool = False) -> DataFrame:
    """Alignments with flags decoded (A7, A11..A14): unmapped and duplicate reads go unless asked for."""
    return parse_sam(spark.read.text(path).filter(~F.col("value").startswith("@")), unmapped, duplicates)


def parse_sam(lines: DataFrame, unmapped: bool = False, duplicates: bool = False) -> DataFrame:
    f = F.split("value", "\t")
    flag = f[1].cast("int")
    has = lambda bit: flag.bitwiseAND(bit) != 0
    aux = F.map_from_entries(F.transform(F.slice(f, 12, 1 << 20), lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, 6, 1 << 20).alias("value"))))
    rows = lines.select(
        f[0].alias("name"), flag.alias("flag"), f[2].alias("contig"), f[3].cast("long").alias("pos"), f[4].cast("int").alias("mqual"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"), aux.alias("aux"),
        has(16).alias("comp"), F.when(has(64), 1).when(has(128), 2).otherwise(0).alias("end_no"), has(4).alias("is_unmapped"), has(1024).alias("is_duplicate"),
        (f[3].cast("long") + reference_length(f[5]) - 1).alias("end"),
    )
    return rows.filter((~F.col("is_unmapped") | F.lit(unmapped)) & (~F.col("is_duplicate") | F.lit(duplicates)))


def sam_header(contigs: DataFrame) -> DataFrame:
    """@SQ lines in the order of names (B2)."""
    return contigs.select(F.concat(F.lit("@SQ\tSN:"), F.col("contig_id").cast("string"), F.lit("\tLN:"), F.col("last_base").cast("string")).alias("value"))


def sam_records(items: DataFrame) -> DataFrame:
    """SAM lines of reads without sequences."""
    flag = F.when(F.col("comp"), 16).otherwise(0) + F.when(F.col("end_no") == 1, 65).when(F.col("end_no") == 2, 129).otherwise(0)
    parts = [F.col("rec").cast("string"), flag.cast("string"), F.col("contig_id").cast("string"), (F.col("start") + 1).cast("string"), F.col("mqual").cast("string"), F.concat(F.col("length").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("LB:Z:"), F.col("library"))]
    return items.select(F.concat_ws("\t", *parts).alias("value"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns with decoded attributes."""
    return parse_gff(spark.read.text(path))


def parse_gff(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    pairs = F.filter(F.split(f[8], ";"), lambda x: F.contains(x, F.lit("=")))
    attributes = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.url_decode(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value"))))
    rows = lines.filter((F.size(f) == 9) & ~F.col("value").startswith("#"))
    return rows.select(f[0].alias("seqid"), f[1].alias("source"), f[2].alias("type"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), F.expr("try_cast(split(value, '\t')[5] as double)").alias("score"), f[6].alias("strand"), F.expr("try_cast(split(value, '\t')[7] as int)").alias("phase"), attributes.alias("attributes"))


def gff_lines(tags: DataFrame) -> DataFrame:
    """GFF lines of tags, attributes encoded."""
    strand = F.when(F.col("dir").isin("+", "-"), F.col("dir")).otherwise(".")
    return tags.select(F.concat_ws("\t", F.col("contig_id").cast("string"), F.lit("strandloom"), F.col("type"), (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string"), F.lit("."), strand, F.lit("."), F.concat(F.lit("ID="), F.col("tag_id").cast("string"), F.lit(";Note="), F.url_encode("comment"))).alias("value"))


def parse_agp(lines: DataFrame) -> DataFrame:
    """Components of each object with the size of the gap row before them (S19: A31)."""
    f = F.split("value", "\t")
    rows = lines.filter((F.size(f) >= 6) & ~F.col("value").startswith("#")).select(f[0].alias("scaffold"), f[3].cast("int").alias("part"), f[4].alias("kind"), f[5].alias("what"))
    gap = F.expr("lag(case when kind in ('N', 'U') then cast(what as int) else 0 end, 1, 0) over (partition by scaffold order by part)")
    return rows.withColumn("gap_size", gap).filter("kind not in ('N', 'U')").select("scaffold", "part", F.col("what").alias("contig"), "gap_size")


def parse_experiment(records: DataFrame) -> DataFrame:
    """Two-letter records as a map; sequence lines up to '//' are joined (A38). ``records`` has one file a row in value."""
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ[^\n]*\n(.*?)\n//", 1), r"\s", "")
    lines = F.filter(F.split(F.regexp_replace("value", r"(?s)\nSQ[^\n]*\n.*?\n//", ""), "\n"), lambda x: x.rlike(r"^[A-Z]{2}   "))
    entries = F.transform(lines, lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.trim(F.substring(x, 6, 1 << 20)).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    return records.select(last.alias("fields"), body.alias("seq"))


def parse_enzymes(lines: DataFrame) -> DataFrame:
    """'NAME/SITE'CUT//' lines: one row a site with its cut offset."""
    sites = F.filter(F.split(F.regexp_replace("value", "//.*$", ""), "/"), lambda x: x != "")
    return lines.filter(F.contains("value", F.lit("/"))).select(F.element_at(sites, 1).alias("enzyme"), F.explode(F.slice(sites, 2, 1000)).alias("s")).select(
        "enzyme", F.replace("s", F.lit("'"), F.lit("")).alias("site"), F.greatest(F.lit(0), F.instr("s", "'") - 1).alias("cut")
    )
