from strandloom.operators import clipping, edits, lookups, pairs


def reads(spark, quals, codes=None):
    """Reads of one contig; only the middle one is neither first nor last."""
    rows, bases = [], []
    for rec, start in ((1, 0), (2, 5), (3, 400)):
        n = len(quals) if rec == 2 else 60
        rows.append((7, rec, start, start + n - 1, False, n, 1, n, start, start + n - 1))
        for i in range(n):
            bases.append((rec, start + i, (codes[i] if codes else 0) if rec == 2 else 0, quals[i] if rec == 2 else 30))
    items = spark.createDataFrame(rows, "contig_id long, rec long, start long, end long, comp boolean, length int, lclip int, rclip int, vstart long, vend long")
    return items, spark.createDataFrame(bases, "rec long, pos long, code int, qual int")


def clips(df):
    return {r.rec: (r.left, r.right) for r in df.collect()}


def test_quality_clips_end_at_window_centres(spark):
    quals = [0] * 20 + [40] * 30 + [0] * 20
    got = clips(clipping.quality_clip_pairs(*reads(spark, quals), 5, 20))
    assert got[1] == (0, 61) and got[3] == (0, 61)  # contig ends and good reads keep their clips
    assert got[2] == (20, 49)  # the first windows of mean 20 have 3 good bases: centres 20 and 49, 0-based
    assert clips(clipping.quality_clip_pairs(*reads(spark, [0, 0, 0]), 5, 20))[2] == (0, 4)


def test_unknown_bases_clip_both_ends(spark):
    codes = [5, 5, 0, 5, 5] + [1] * 40 + [5, 2, 5]
    got = clips(clipping.unknown_clip_pairs(*reads(spark, [30] * len(codes), codes)))
    assert got[2] == (5, 46) and got[1] == (0, 61)
    assert clips(clipping.unknown_clip_pairs(*reads(spark, [30] * 9, [1] * 9)))[2] == (0, 10)


def test_all_reads_of_a_template_are_paired(spark):
    rows = [(9, n, 100 + n, 1, n * 10, n * 10 + 5, n % 2 == 0, 20, "L") for n in range(1, 6)]
    items = spark.createDataFrame(rows, "template long, end_no int, rec long, contig_id long, start long, end long, comp boolean, mqual int, library string")
    assert sorted((r.rec1, r.rec2) for r in pairs.mates(items).collect()) == [(101, 102), (103, 104)]


def test_edits_and_references(spark):
    tags = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 12, 13), (3, 1, 14, 30), (4, 1, 2, 4)], "tag_id long, contig_id long, start long, end long")
    from pyspark.sql import functions as F

    got = {r.tag_id: (r.new_start, r.new_end) for r in edits.shifted(tags, F.lit(11), -5).collect()}
    assert got == {1: (10, 15), 3: (11, 25), 4: (2, 4)}  # tag 2 lay inside what was deleted
    items = spark.createDataFrame([(5, 1001)], "contig_id long, rec long")
    refs = spark.createDataFrame([("#1001",), ("=5",), ("ctg5",), ("r1001",), ("ctg6",), ("junk",), (None,)], "ref string")
    assert [r.contig_id for r in lookups.resolve_contigs(refs, items).orderBy("ref").collect()] == [None, 5, 5, 5, None, None, 5]
