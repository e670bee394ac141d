import math

from pyspark.sql import functions as F

import __spark_entry__
from strandloom.functions import sequence as S
from strandloom.operators import composition, consensus, kmers, lists, pairs, ranges
from strandloom.sources import formats


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


def test_sequence_functions(spark):
    assert one(spark, "ACGTRN*", S.reverse_complement) == "*NYACGT"
    assert one(spark, "ACGTA", lambda s: S.rotate(s, F.lit(3))) == "GTAAC"
    assert one(spark, "A*C**G", S.depad) == "ACG"
    assert one(spark, "ATGTAANNN", S.translate) == "M*-"
    assert one(spark, "AACCCGT", S.longest_run) == 3
    assert one(spark, "GAATTC", S.is_symmetric) is True
    codes = spark.createDataFrame([(True, False, True, False), (True, True, True, True)], "a boolean, c boolean, g boolean, t boolean")
    assert [r.x for r in codes.select(S.ambiguity_code(*map(F.col, "acgt")).alias("x")).collect()] == ["R", "N"]
    tm = one(spark, "ACGT" * 10, S.melting_temperature)
    assert abs(tm - (81.5 + 16.6 * math.log10(0.05) + 41 * 0.5 - 600 / 40)) < 1e-9


def test_depth_and_holes(spark):
    items = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 10, 11), (2, 5, 5)], "contig_id long, start long, end long")
    steps = sorted(map(tuple, ranges.depth_steps(items).collect()))
    assert steps == [(1, 0, 1, 1), (1, 2, 4, 2), (1, 5, 6, 1), (1, 7, 9, 0), (1, 10, 11, 1), (2, 5, 5, 1)]
    assert [tuple(r) for r in ranges.holes(items, "start", "end").collect()] == [(1, 7, 9)]
    joined = ranges.interval_join(items, items.select("contig_id", F.col("start").alias("rstart"), F.col("end").alias("rend")), "contig_id", width=3)
    assert joined.count() == 6  # each with itself, and the first two with each other


def test_insert_bins(spark):
    df = spark.createDataFrame([(s,) for s in (0, 5, 255, 256, 511, 512, 1 << 20, 1 << 22)], "s int")
    got = df.select(pairs.insert_bin(F.col("s")).alias("b")).select("b", pairs.bin_size(F.col("b")).alias("low")).collect()
    for (size,), r in zip(df.collect(), got):
        width = 1 << max(0, r.b // 128 - 1)
        assert r.low <= min(size, 1 << 20) < r.low + width


def test_composition(spark):
    seqs = spark.createDataFrame([(1, "GGATCCAAGGATCC"), (2, "")], "id long, seq string")
    sites = sorted((r.enzyme, r.cut) for r in composition.restriction_sites(seqs).collect())
    assert sites == [("BamHI", 2), ("BamHI", 10)]
    sizes = sorted((r.cut, r["size"]) for r in composition.fragments(composition.restriction_sites(seqs)).collect())
    assert [s for _, s in sizes] == [1, 8, 5]
    assert [(r.pos, r.length) for r in kmers.previous_repeats(seqs, 4).filter("distance = 8").collect()] == [(9, 6)]


def test_consensus(spark):
    rows = [(1, 7, i, c, 30, i, False, "O") for i, c in enumerate([0, 0, 0, 2])]
    bases = spark.createDataFrame(rows, "contig_id long, pos long, rec long, code int, qual int, template long, comp boolean, library string")
    r = consensus.bayes_consensus(bases).first()
    assert (r.base, r.depth) == ("A", 4) and r.phred >= 0
    assert consensus.frequency_consensus(consensus.pileup(bases)).first().base == "A"


def test_formats(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert [tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "x.fa")).collect()] == [("one", "first", "ACGTAC"), ("two", "", "GG")]
    (tmp_path / "x.fq").write_text("@r1 d\nACG\n+\n!I~\n@r2\nA\n+\n@\n")
    got = [(r.name, r.seq, list(r.quals)) for r in formats.read_fastq(spark, str(tmp_path / "x.fq")).collect()]
    assert got == [("r1", "ACG", [0, 40, 93]), ("r2", "A", [31])]
    agp = spark.createDataFrame([("s\t1\t10\t1\tW\tc1\t1\t10\t+",), ("s\t11\t15\t2\tN\t5\tfragment\tyes",), ("s\t16\t20\t3\tW\tc2\t1\t5\t-",)], "value string")
    assert [(r.contig, r.gap_size) for r in formats.parse_agp(agp).collect()] == [("c1", 0), ("c2", 5)]
    enzymes = spark.createDataFrame([("ALUI/AG'CT//",), ("X/A'A/CC'G//",)], "value string")
    assert sorted(map(tuple, formats.parse_enzymes(enzymes).collect())) == [("ALUI", "AGCT", 2), ("X", "AA", 1), ("X", "CCG", 2)]
    exp = spark.createDataFrame([("ID   a\nQL   3\nQL   5\nSQ\n     ACG T\n     AA\n//\n",)], "value string")
    r = formats.parse_experiment(exp).first()
    assert r.fields == {"ID": "a", "QL": "5"} and r.seq == "ACGTAA"
    assert formats.sniff("reads.FASTQ.gz") == "fastq" and formats.sniff("x.txt") == ""


def test_tags(spark):
    tags = spark.createDataFrame([("COMM", "+", -3, 9, "two\nlines")], "type string, dir string, start long, end long, comment string")
    assert tuple(tags.select(lists.parse_tag(lists.format_tag()).alias("t")).first().t) == ("COMM", 0, -3, 9, "two\nlines")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
