import random

import numpy as np

from strandloom.operators import perread


def slow_align(a, b, local):
    low = -(10**9)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    up = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    left = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                if i:
                    up[i][j] = max(best[i - 1][j] - 4, up[i - 1][j] - 1)
                if j:
                    left[i][j] = max(best[i][j - 1] - 4, left[i][j - 1] - 1)
                d = best[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -2) if i and j else low
                best[i][j] = max(d, up[i][j], left[i][j], 0 if local else low)
            top = max(top, best[i][j])
    return top if local else best[len(a)][len(b)]


def test_align_matches_the_textbook():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14))) for _ in range(2))
        for local in (False, True):
            assert perread.align(a, b, local=local)[0] == slow_align(a, b, local)


def test_quality_clip_cases_worked_by_hand():
    # windows of 3: on the left the one at 1 is the first below 30; of 2 again from 3: the one at 1; of 1: the base at 2
    assert perread.clip_by_quality([2, 2, 2, 20, 20, 20, 20, 20, 2, 2, 2], 3, 10) == (3, 9)
    # one good base inside the bad ends does not count
    assert perread.clip_by_quality([2, 2, 20, 2, 2, 20, 20, 20, 20, 20, 2, 2, 20, 2, 2], 3, 10) == (5, 11)
    # good to both ends: the left scan stops at base 0, the right one at the last base
    assert perread.clip_by_quality([20] * 12, 3, 10) == (1, 12)
    assert perread.clip_by_quality([0] * 9, 3, 10) == (0, 10) and perread.clip_by_quality([], 3, 10) == (0, 1)
    for n in range(1, 7):  # shorter than the window
        left, right = perread.clip_by_quality([30] * n, 6, 10)
        assert left < right


def test_low_complexity(spark):
    rng = random.Random(2)
    plain = "".join(rng.choice("ACGT") for _ in range(60))
    assert perread.low_complexity(plain) == plain
    got = perread.low_complexity(plain + "A" * 60)
    assert got[:50] == plain[:50] and got.count("#") > 50
    df = spark.createDataFrame([(1, "A*" * 60), (2, None)], "id long, seq string")
    rows = {r.id: r.seq for r in perread.masked(df).collect()}
    assert set(rows[1]) <= {"#", "A"} and rows[2] == ""
    pairs = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, None, "A")], "id long, a string, b string")
    assert {r.id: r.score for r in perread.alignments(pairs).collect()} == {1: 4, 2: -4}


def test_low_complexity_divides_by_the_last_base():
    assert perread.low_complexity("ACGTTGCAAAAAAATCGGCTAC") == "ACGTTGCAAAAAAATCGGCTAC"  # scores 16
    long = "ACGTTGC" + "A" * 30 + "TCGGCTAC"
    assert "#" * 25 in perread.low_complexity(long) and perread.low_complexity(long).startswith("ACGTTG")
    assert "#" not in perread.low_complexity("A-" * 40)
