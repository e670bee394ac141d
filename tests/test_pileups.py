import random
import re

from strandloom.operators import pileups
from strandloom.streaming import pileup as stream

READS = [
    (1, "c", 1, "4M", "ACGT"),
    (1, "c", 1, "2M2I2M", "ACTTGT"),
    (1, "c", 2, "1M1P1I1M1D1M", "CTGA"),  # positions 2, 3, (4 deleted), 5; after 2 a pad and then a base
    (1, "c", 2, "3S2M1I2H", "NNNCGA"),  # ends with an insertion after 3
    (1, "c", 3, "2I1M2N1M", "AAGC"),  # begins with two bases after 2; 4 and 5 skipped
    (1, "*", 0, "*", "ACG"),
    (2, "d", 7, "1=1X", "ag"),
]


def by_hand():
    """(contig, pos, nth): bases of the reads in order, a '*' for those that pass an inserted column."""
    return {
        ("c", 1, 0): "AA", ("c", 2, 0): "CCCC", ("c", 2, 1): "T*A" + "*" , ("c", 2, 2): "TTA" + "*", ("c", 3, 0): "GGGGG", ("c", 3, 1): "A" + "***", ("c", 4, 0): "TT*", ("c", 5, 0): "A", ("c", 6, 0): "C",
        ("d", 7, 0): "A", ("d", 8, 0): "G",
    }


def table(rows):
    return {(r.contig, r.pos, r.nth): (r.n_a, r.n_c, r.n_g, r.n_t, r.n_pad, r.n_other, r.depth) for r in rows}


def test_columns_by_hand(spark):
    df = spark.createDataFrame(READS, "contig_no long, contig string, pos long, cigar string, seq string")
    got = table(pileups.pileup(df).collect())
    want = {k: (*(v.count(c) for c in "ACGT*"), 0, len(v)) for k, v in by_hand().items()}
    # after 2: reads 1 to 4 go on past 2 (n_on 4); read 2 has T T, read 3 a pad and T, read 5 (which begins there) A A
    assert got == want


def test_stream_equals_batch_and_frees_columns(spark, tmp_path):
    rows = [(c, f"c{c}", 1 + 3 * i, ["5M", "2M1I3M", "3M2D2M"][i % 3], "ACGTAC"[: 5 + (i % 3 == 1)]) for c in (1, 2) for i in range(60)]
    schema = "contig_no long, contig string, pos long, cigar string, seq string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a in range(0, len(rows), 10):
        spark.createDataFrame(rows[a : a + 10], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(9, "end", 1, "1M", "A")], schema).coalesce(1).write.mode("append").parquet(source)
    query = stream.write_columns(stream.stream_columns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 7), out, str(tmp_path / "progress"))
    query.awaitTermination()
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(state) < 140 and state[-1] <= 2  # some three batches of ten reads wait, of 400 columns; only the end is left
    df = spark.createDataFrame(rows, schema)
    assert table(spark.read.parquet(out).collect()) == table(pileups.pileup(df).collect())
    assert pileups.pileup(df.limit(0)).count() == 0


def plain_columns(rows):
    """(contig, pos, nth) to counts, base by base."""
    found, passing = {}, {}
    for _, contig, pos, cigar, seq in rows:
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        last, at, ref, nth = pos + sum(n for n, op in ops if op in "MDN=X") - 1, 0, pos, 0
        for n, op in ops:
            for _ in range(n):
                nth = nth + 1 if op in "IP" else nth if op in "SH" else 0
                if op in "M=XDIP":
                    where = (contig, ref - (op in "IP"), nth)
                    base = "*" if op in "DP" else seq[at : at + 1].upper()
                    own = found.setdefault(where, [0] * 6)
                    own["ACGT*".find(base) if base and base in "ACGT*" else 5] += 1
                    passing[where] = passing.get(where, 0) + (where[1] < last)
                ref, at = ref + (op in "MDN=X"), at + (op in "MIS=X")
    for where, own in found.items():
        if where[2]:
            own[4] += max(0, passing.get((*where[:2], 0), 0) - sum(own))
    return {where: (*own, sum(own)) for where, own in found.items()}


def test_reads_over_borders_of_blocks_and_batches(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        cigar = "".join(f"{rng.randint(1, 12)}{rng.choice('MIDNSP=X')}" for _ in range(rng.randint(1, 7)))
        rows.append((i % 3, f"c{i % 3}", rng.randint(1, 90), cigar, "".join(rng.choice("ACGTacgtN") for _ in range(rng.randint(0, 60)))))
    df = spark.createDataFrame(rows, "contig_no long, contig string, pos long, cigar string, seq string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert table(pileups.pileup(df, width=8).collect()) == table(pileups.pileup(df).collect()) == plain_columns(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_alignments_made_where_columns_are_added_up(spark):
    from strandloom import plans
    from strandloom.sources import adapters as A

    reads = [(1, 7 * i, 3 * i % 40, 3 * i % 40 + i % 13) for i in range(60)] + [(2, 14, 7, 7), (2, 21, 5, 30), (None, 28, 5, 9), (3, 35, 9, 8)]
    items = spark.createDataFrame(reads, "contig_id long, rec long, start long, end long")
    want = table(pileups.pileup(A.aligned_reads(items)).collect())
    for width in (4, 8, 4096):
        assert table(pileups.placed_pileup(A.alignment_places(items), A.placed_alignments, width).collect()) == want
    plan = plans.registered()["a19_column_pileup"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cigar" not in plan[plan.index("RepartitionByExpression") :]  # below the exchange reads have no texts yet


def test_cigars_of_short_runs_alone():
    """A batch in which no run has ten bases, as a task's last few reads can be."""
    import numpy as np

    from strandloom.sources import adapters as A

    kind = np.frombuffer(b"MMDMIM", np.uint8)
    assert A.cigar_texts(kind, np.array([0, 0, 0, 2, 2, 2]), 3).to_pylist() == ["2M1D", "", "1M1I1M"]
    assert A.cigar_texts(kind[:0], np.zeros(0, np.int64), 2).to_pylist() == ["", ""]
    assert A.cigar_texts(np.full(12, 77, np.uint8), np.zeros(12, np.int64), 1).to_pylist() == ["12M"]


def test_steps_of_a_stream_are_many_files(spark, tmp_path, monkeypatch):
    from strandloom.plans import layout

    monkeypatch.setattr(layout, "fresh_path", lambda s, name: str(tmp_path / name))
    items = "/root/testdata/sf0.001"
    got = layout._streamed(spark, items).count()
    assert len(list((tmp_path / "sorted").glob("*.parquet"))) > 5  # one a step and the end before, each written and read by one task
    assert got == layout.QUERIES["a19_column_pileup"][0](spark, items).count()
