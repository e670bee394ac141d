"""Feature tables: locations and entries worked out by hand."""

from pyspark.sql import functions as F

from strandloom.functions import features as T


def test_locations(spark):
    cases = {
        "467": [(467, 467, False, False, "", "")],
        "340..565": [(340, 565, False, False, "", "")],
        "<345..>500": [(345, 500, False, False, "<", ">")],
        "123^124": [(123, 124, False, True, "", "")],
        "102.110": [(102, 110, False, False, "", "")],
        "(23.45)..600": [(23, 600, False, False, "", "")],
        "1..(9.12)": [(1, 12, False, False, "", "")],
        "complement(34..126)": [(34, 126, True, False, "", "")],
        "join(12..78, 134..202)": [(12, 78, False, False, "", ""), (134, 202, False, False, "", "")],
        "join(complement(4918..5163),2691..4571)": [(4918, 5163, True, False, "", ""), (2691, 4571, False, False, "", "")],
        "complement(join(2691..4571,complement(4918..5163)))": [(4918, 5163, False, False, "", ""), (2691, 4571, True, False, "", "")],
        "join(J00194.1:100..202,1..245)": [(100, 202, False, False, "", ""), (1, 245, False, False, "", "")],
        "": [], "gap()": [], None: [],
    }
    df = spark.createDataFrame([(x,) for x in cases], "s string")
    got = {r.s: [tuple(x) for x in r.x] for r in df.select("s", T.location_intervals(F.col("s")).alias("x")).collect()}
    assert got == cases


def test_entries(spark):
    text = (
        "ID   X; 1\nFH   Key\nFT   CDS             join(1..5,\nFT                   complement(8..9))\nFT                   /gene=\"a\"\n"
        "FT                   /note=\"one /path \"\"quoted\"\"\nFT                   and on\"\nFT                   /codon_start=2\nFT                   /pseudo\nFT                   /gene=\"b\"\n"
        "FT   5'UTR           7\nSQ   Sequence"
    )
    got = spark.createDataFrame([(text,), ("",), (None,)], "s string").select(T.entries(F.col("s")).alias("e")).collect()
    assert [tuple(e) for e in got[0].e] == [
        ("CDS", "join(1..5,complement(8..9))", {"note": 'one /path "quoted" and on', "codon_start": "2", "pseudo": "", "gene": "b"}), ("5'UTR", "7", {}),
    ]
    assert got[1].e == [] and got[2].e == []


def test_round_trip_and_splice(spark):
    intervals = [(2, 4, False), (7, 7, False), (5, 6, True)]
    df = spark.createDataFrame([(intervals, "ACGTACGT")], "i array<struct<start: long, end: long, complement: boolean>>, seq string")
    read = df.withColumn("text", T.location_text(F.col("i"))).withColumn("back", T.location_intervals(F.col("text"))).withColumn("bases", T.spliced(F.col("seq"), F.col("back"))).first()
    assert read.text == "join(2..4,7,complement(5..6))" and [tuple(x)[:3] for x in read.back] == intervals
    assert read.bases == "CGT" + "G" + "GT"


def test_long_values(spark):
    long = spark.range(1).select(F.concat(F.lit("FT   CDS             join(1..2"), F.repeat(F.lit(",\nFT                   3..4"), 20000), F.lit(')\nFT                   /note="'), F.repeat(F.lit('x ""y"" '), 50000), F.lit('"')).alias("s"))
    got = long.select(F.explode(T.entries(F.col("s"))).alias("e")).select(F.size(T.location_intervals(F.col("e.location"))).alias("n"), F.length(F.col("e.qualifiers")["note"]).alias("m")).first()
    assert (got.n, got.m) == (20001, 50000 * 6)
