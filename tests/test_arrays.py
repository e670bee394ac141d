import random

import numpy as np

from strandloom.functions import sequence as S
from strandloom.operators import composition, joins, kmers, perread, spans
from strandloom.operators import matching as M
from strandloom.plans import statistics

ODD = [(1, ""), (2, None), (3, "ACGTACGTAACC*G"), (4, "aéT*AATAAG"), (5, "*" * 9), (6, "ACGT" * 40 + "N" + "TAATGA" * 7)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def made(seed, n=40, letters="ACGT", most=300):
    rng = random.Random(seed)
    return [(10 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))) for i in range(n)]


def test_clips_of_many_reads_are_those_of_each():
    rng = random.Random(1)
    for width, mean in ((30, 10.0), (10, 20.0), (1, 5.0)):
        reads = [[rng.randint(0, rng.choice([0, 5, 25, 40])) for _ in range(rng.randint(0, 90))] for _ in range(400)]
        at = np.cumsum([0, *map(len, reads)])
        left, right = perread.clips_by_quality(np.array([q for r in reads for q in r], np.int64), at, width, mean)
        assert list(zip(left.tolist(), right.tolist())) == [tuple(map(int, perread.clip_by_quality(r, width, mean))) for r in reads]


def test_masks_of_many_texts_are_those_of_each(spark):
    rows = made(2) + made(3, letters="AAAC") + made(4, letters="aAC-N") + [(i + 500, s) for i, s in ODD]
    got = {r.id: r.seq for r in perread.masked(spark.createDataFrame(rows, "id long, seq string")).collect()}
    assert got == {i: perread.low_complexity((s or "").replace("*", "")) for i, s in rows}
    data, ends = perread.slices.__globals__["letters"]([s for _, s in made(3, letters="AC")])
    assert (perread.masked_letters(data, ends, most=7) == perread.masked_letters(data, ends)).all() and (perread.masked_letters(data, ends) == ord("#")).any()


def test_common_words_need_no_shuffle_of_words(spark):
    rows = made(5, letters="AAAC") + [(1, "")]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = kmers.common_word_cover(df, 5, 60)
    assert shuffles(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kmers._cover_by_join(df, 5, 60).collect())) != []
    odd = spark.createDataFrame(rows + [(i + 500, s) for i, s in ODD], "id long, seq string")
    assert sorted(map(tuple, kmers.common_word_cover(odd, 5, 60).collect())) == sorted(map(tuple, kmers._cover_by_join(odd.filter("seq is not null"), 5, 60).collect()))


def plain_repeats(s, k):
    runs, last = [], {}
    pairs = []
    for p in range(len(s) - k + 1):
        if s[p : p + k] in last:
            pairs.append((p - last[s[p : p + k]], p))
        last[s[p : p + k]] = p
    for d, p in sorted(pairs):
        if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] == p:
            runs[-1][2] += 1
        else:
            runs.append([d, p, 1])
    return [(d, p + 1, n + k - 1) for d, p, n in runs]


def test_repeats_need_no_shuffle(spark):
    rows = made(6, letters="AC", most=60) + made(7, n=5, letters="ac*N") + [(i + 500, s) for i, s in ODD]
    rows = [(i, s) for i, (_, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, seq string")
    for k in (1, 4, 7):
        got = kmers.previous_repeats(df, k)
        assert shuffles(got) == 0
        assert sorted(map(tuple, got.collect())) == sorted((i, *r) for i, s in rows if s for r in plain_repeats(s, k))


def test_pads_go_out_and_back(spark):
    rows = made(8, letters="AC*") + ODD
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    back = M.repadded(df.select("id", S.depad(df.seq).alias("seq")), M.gap_lists(df))
    assert {r.id: r.seq for r in back.collect()} == dict(rows)
    found = M.padded_inexact(df, "CACN", 2)
    assert shuffles(M.padded_inexact(spark.createDataFrame(rows, "id long, seq string"), "CACN", 2)) == 0
    want = []
    for i, s in rows:
        at = [p for p, c in enumerate(s or "") if c != "*"]
        for u in range(len(at) - 3):
            score = sum(s[at[u + j]] == c for j, c in enumerate("CAC"))
            want += [(i, at[u] + 1, score)] if score >= 2 else []
    assert sorted(map(tuple, found.collect())) == sorted(want) != []


def test_frames_and_proteins_need_no_shuffle(spark):
    rows = made(9, letters="TAGC") + ODD
    df = spark.createDataFrame(rows, "id long, seq string")
    code = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), S.GENETIC_CODE))
    protein = lambda s, f: "".join(code.get(s[i : i + 3], "-") for i in range(f, len(s) - 2, 3))
    assert {r.id: r.p for r in df.select("id", S.translate(df.seq, 1).alias("p")).collect()} == {i: None if s is None else protein(s, 1) for i, s in rows}
    want = []
    for i, s in rows:
        for f in range(3) if s is not None else ():
            at, whole = 0, protein(s, f)
            for piece in whole.split("*"):
                n = len(piece) + (at + len(piece) < len(whole))
                want += [(i, f, at * 3 + 1 + f, at * 3 + f + 3 * len(piece), n)] if n > 4 else []
                at += len(piece) + 1
    got = composition.open_frames(df, 4)
    assert shuffles(got) == 0 and sorted(map(tuple, got.collect())) == sorted(want) != []


def test_tags_of_one_contig_are_several_texts(spark):
    rows = [(i, 1, i, i + 3, "+", "A;B%", f"by | {i}") for i in range(40)]
    tags = spark.createDataFrame(rows, "tag_id long, contig_id long, start long, end long, dir string, type string, comment string")
    got = sorted((r.place, r.start, r.end, r.type, r.note) for r in statistics._annotations(tags, 7).collect())
    assert got == [(i, i, i + 3, "A;B%", f"by | {i}") for i in range(40)]


def test_spans_send_each_stretch_once_for_many_probes(spark):
    rows = made(10, n=6, most=60)
    df = spark.createDataFrame(rows, "id long, seq string")
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows], "id1 long, id2 long")
    got = spans.similar_spans(df, df, pairs, 7, 5, tile=16)
    most, spans.MOST_BROADCAST = spans.MOST_BROADCAST, -1
    try:
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spans.similar_spans(df, df, pairs, 7, 5, tile=16).collect())) != []
    finally:
        spans.MOST_BROADCAST = most


def test_rows_of_one_id_are_one_sequence(spark):
    df = spark.createDataFrame([(1, "AAAA"), (1, "AAAAAA"), (2, "CCCC")], "id long, seq string")
    assert [tuple(r) for r in kmers.common_word_cover(df, 3, 4).collect()] == [(1, 6)]
    assert {r.id for r in kmers.previous_repeats(df, 3).filter("distance = 0").collect()} == {1}
