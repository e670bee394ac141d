"""Cases worked out by hand for rules that earlier versions had wrong."""

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import clipping, kmers, pairs
from strandloom.sources import formats as T


def test_poly_clip(spark):
    rows = [
        (1, "CG" * 15 + "A" * 12),  # the clip ends at the last base that isn't A
        (2, "CG" * 15 + "CACACACACA" + "AAAA"),  # stops in the first window with under 4 of A
        (3, "T" * 30),  # nothing else: all
        (4, "CG" * 20), (5, "ACG"), (6, ""),
        (7, "CCCCCCCCCCCC" + "ATATATATAT"),  # 5 and 5: T counts; the window of 3 T in 10 from the end: its outermost other base is the last A before them
        (8, "GGGGGGGGGGGGGGGTTTTTTTT"),
    ]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {r.id: r.clip for r in clipping.poly_clip(df, 10, 4).collect()}
    assert got[1] == 12 and got[3] == 30 and got[8] == 8 and not {4, 5, 6} & got.keys()
    assert got == {1: 12, 2: got[2], 3: 30, 7: got[7], 8: 8}

    def walk(seq, base):
        tail = seq[::-1]
        for i in range(len(tail) - 10):
            if tail[i : i + 10].count(base) < 4:
                return next(j for j in range(i, i + 10) if tail[j] != base)
        return len(tail)

    assert got[2] == walk(rows[1][1], "A") and got[7] == walk(rows[6][1], "T")


def test_platforms(spark):
    df = spark.createDataFrame([(x,) for x in ("ABI", "abi", "Helicos", "pacbio", "454", "", None)], "p string")
    assert [r[0] for r in df.select(T.platform_code(F.col("p"))).collect()] == [1, 1, 0, 0, 4, 0, 0]
    names = {"ec2f6ae01abcde": 4, "VAB_1": 3, "IL12_1": 2, "ILx": 0, "a:b:c:d:e": 2, "a:b:c:d:e:f:g:h": 0, "zzz": 0, "xb54.p1k": 1, "xb54.q2ka": 1, "xb.s1.p1k": 0, "xb54.s1": 0, "": 0}
    df = spark.createDataFrame(list(names.items()), "name string, code int")
    assert {r.name: r.c for r in df.select("name", T.platform_of_name(F.col("name")).alias("c")).collect()} == names


def test_annotation_tags(spark):
    texts = [("3;10;+;COMM;Note=a%3Bb%7Cc+d 100%",), ("1;2;-;X|4;5;?;Y%20Z;gene=k;v|bad|7;8;+;Z",), ("",), (None,), ("x",)]
    got = [[tuple(t) for t in r.t] for r in spark.createDataFrame(texts, "s string").select(T.annotation_tags(F.col("s")).alias("t")).collect()]
    assert got == [[(3, 10, "+", "COMM", "a;b|c+d 100%")], [(1, 2, "-", "X", ""), (4, 5, "?", "Y Z", "gene=k;v")], [], [], []]


def test_masses(spark):
    df = spark.createDataFrame([("ACGT",), ("",)], "s string")
    got = [r[0] for r in df.select(S.mass(F.col("s"))).collect()]
    assert abs(got[0] - (313.20954 + 289.18454 + 329.20894 + 304.19618 + 1.00794 - 62.97256)) < 1e-9 and abs(got[1] + 61.96462) < 1e-9


def test_strand_conflicts(spark):
    # template 1: forward and reverse primer agree; 2: two forward primers on both strands; 3: disagree, but on two contigs
    rows = [(1, 5, 1, False), (1, 5, 2, True), (2, 5, 1, False), (2, 5, 3, True), (3, 5, 1, False), (3, 6, 2, False)]
    got = pairs.strand_conflicts(spark.createDataFrame(rows, "template long, contig_id long, end_no int, comp boolean")).collect()
    assert [tuple(r) for r in got] == [(2, 5, 1, 1)]


def test_best_intercept_drops_the_furthest_again_and_again(spark):
    # hits 4, 3, 3, 1 over equal lengths: centre 57.5: 200 goes; centre 43.3: 81 goes; centre 27.1: 50 goes
    rows = [(1, 2, d, 100, 300, n, 50) for d, n in ((10, 4), (50, 3), (81, 3), (200, 1))] + [(1, 3, 120, 100, 300, 2, 50)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, diagonal long, len1 int, len2 int, n long, length long")
    got = {r.id2: tuple(r)[2:] for r in kmers.best_intercepts(df).collect()}
    assert got == {2: (10, 89, 0), 3: (120, 0, 21)}


def test_tail_of_many_hits(spark):
    from math import exp, factorial

    df = spark.createDataFrame([(1, 2, 99, 100, 100, 0.9, n) for n in (1, 2, 30, 60)], "id1 long, id2 long, diagonal long, len1 int, len2 int, p double, n long")
    mean = 100 * 0.9**2
    got = {r.n: r.chance for r in kmers.significant_diagonals(df, 2, 2.0).collect()}
    for n, chance in got.items():
        assert abs(chance - (1 - sum(exp(-mean) * mean**i / factorial(i) for i in range(n)))) < 1e-9


def test_acid_mass_of_long_sequences(spark, tmp_path):
    from strandloom import plans

    df = spark.createDataFrame([(1, "TGG" * 40_000, "en", "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.registered()["e43_acid_mass"][0](spark, str(tmp_path)).first()
    assert abs(got.mass - 186.2133 * 40_000) < 1e-2


def test_library_sizes_worked_by_hand(spark):
    # U: one pair of each size from 100 to 199; 25 pairs up to 124, so q1 125; 124 counts again: the 50th at 148; that again: the 75th at 172
    # one size alone: the next round's range has no bin, so size and deviation are zero
    rows = [("U", "INWARD", b, 1) for b in range(100, 200)] + [("U", "SAME", 40, 9), ("One", "OUTWARD", 200, 7)]
    df = spark.createDataFrame(rows, "library string, orientation string, bin int, n long")
    got = {r.library: r for r in pairs.library_sizes(df).collect()}
    assert (got["U"].lib_type, got["U"].n, got["U"]["size"]) == ("INWARD", 109, 149) and abs(got["U"].sd - 48 / 1.349) < 1e-9
    assert (got["One"].lib_type, got["One"]["size"], got["One"].sd) == ("OUTWARD", 0, 0.0)
    assert pairs.largest_insert(pairs.library_sizes(df)).first()["size"] == 255
    assert pairs.largest_insert(pairs.library_sizes(df.filter("library = 'One'"))).first()["size"] == 1000
    assert [pairs.bin_of_size(x) for x in (0, 255, 256, 300, 1 << 22)] == [r.b for r in spark.createDataFrame([(x,) for x in (0, 255, 256, 300, 1 << 22)], "s int").select(pairs.insert_bin(F.col("s")).alias("b")).collect()]


def test_scores_of_exactly_three_stay(spark):
    # eight diagonals of 1 hit, six of 2, one of 4: mean 1.6, deviation 0.8, z = 3
    hits = spark.createDataFrame([(1, 2, d, 1 if d < 8 else 2 if d < 14 else 4) for d in range(15)], "id1 long, id2 long, diagonal long, n long")
    assert [tuple(r) for r in kmers.diagonal_zscores(hits).collect()] == [(1, 2, 14, 4, 3.0)]


def test_poly_clip_takes_rows_one_by_one(spark):
    rows = [(1, "CG" * 15 + "A" * 12), (1, "T" * 30), (2, None), (3, "CG" * 20)]
    found = clipping.poly_clip(spark.createDataFrame(rows, "id long, seq string"), 10, 4)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # of a text's words none is shuffled
    assert sorted(tuple(r) for r in found.collect()) == [(1, 12), (1, 30)]
