"""Similar spans against a double loop, contig order against cases worked out by hand."""

import random

import numpy as np
import pytest

from strandloom.operators import contig_order as O
from strandloom.operators import spans


def plain_spans(a, b, window, least, skip_main=False):
    half, found = window // 2, []
    at = lambda s, i: s[i] if 0 <= i < len(s) else "-"
    for i in range(len(a)):
        for j in range(len(b)):
            score = sum(at(a, i + k) == at(b, j + k) and at(a, i + k) in "ACGT" for k in range(-half, half + 1))
            if score >= least and not (skip_main and i == j):
                found.append((i + 1 - half, j + 1 - half, score))
    return sorted(found)


def test_diagonal_sums():
    same = np.random.default_rng(1).integers(0, 2, (23, 31)).astype(bool)
    for window in (1, 3, 6, 7, 13):
        want = [[sum(same[i + k, j + k] for k in range(window)) for j in range(31 - window + 1)] for i in range(23 - window + 1)]
        assert spans.diagonal_sums(same, window).tolist() == want


@pytest.mark.parametrize("tile", [8, 2048])
def test_spans_equal_a_double_loop(spark, tile):
    rnd = random.Random(3)
    texts = {i: "".join(rnd.choice("ACGTN" if i % 2 else "ACG") for _ in range(n)) for i, n in enumerate((40, 7, 8, 25, 4, 0, 33))}
    texts[3] = texts[0][5:20] + texts[3]
    seqs = spark.createDataFrame([*texts.items(), (9, None)], "id long, seq string")
    pairs = [(a, b) for a in (0, 2, 4, 5, 6, 9) for b in (0, 1, 3, 6)]
    df = spark.createDataFrame(pairs + pairs[:3], "id1 long, id2 long")
    got = sorted(tuple(r) for r in spans.similar_spans(seqs, seqs, df, 7, 5, tile=tile).collect())
    full = lambda t: t if t and len(t) >= 7 else ""
    assert got == sorted((a, b, *x) for a, b in pairs for x in plain_spans(full(texts.get(a)), full(texts.get(b)), 7, 5))
    own = spans.similar_spans(seqs, seqs, spark.createDataFrame([(6, 6)], "id1 long, id2 long"), 7, 4, skip_main=True, tile=tile)
    assert sorted(tuple(r)[2:] for r in own.collect()) == plain_spans(texts[6], texts[6], 7, 4, True)


def both_ways(edges):
    """(a, b, pairs, side of b for a, side of a for b)"""
    mates = {}
    for a, b, n, s, t in edges:
        mates.setdefault(a, []).append((b, n, s))
        mates.setdefault(b, []).append((a, n, t))
    return {c: sorted(m) for c, m in mates.items()}


def test_paths_by_hand():
    # from 1 the last reached is 4; from 4 the last is 1, at the right end: 4 3 2 1
    chain = [(1, 2, 5, -1, 1), (2, 3, 4, -1, -1), (3, 4, 2, -1, 1)]
    # 4 sees 3 on its right; 3 sees 2 on its left: turned; 2 sees 1 on its right; 1 sees 2 on its left: as it should be
    assert O.ordered_paths(both_ways([(1, 2, 5, -1, 1), (2, 3, 4, 1, -1), (3, 4, 2, -1, 1)])) == [[(4, 1), (3, -1), (2, 1), (1, 1)]]
    assert O.ordered_paths(both_ways(chain)) == [[(4, 1), (3, -1), (2, 1), (1, 1)]]
    # 7 hangs on 3 (place 3) once and on 2 (place 2) three times: 2.25, between 3 and 2
    assert [c for c, _ in O.ordered_paths(both_ways(chain + [(3, 7, 1, 1, 1), (2, 7, 3, 1, 1)]))[0]] == [4, 3, 7, 2, 1]
    # two alone: from 1 to 2, from 2 back to 1, the right end; its neighbour lies to its right: turned
    assert O.ordered_paths(both_ways([(1, 2, 1, 1, 1)])) == [[(2, 1), (1, -1)]]


def test_what_is_level_with_the_start_waits():
    # a star: from 1 the last is 5, from 5 the last is 4: path 5 1 4; 2 and 3 hang on 1 (place 2), over which is only the left end
    star = both_ways([(1, m, 1, 1, -1) for m in (2, 3, 4, 5)])
    paths = [[c for c, _ in p] for p in O.ordered_paths(star)]
    assert paths == [[5, 1, 4], [2], [3]]


def test_order_over_tables(spark):
    rnd = random.Random(5)
    edges = {(g * 100 + a, g * 100 + b) for g in range(6) for _ in range(25) for a, b in [sorted(rnd.sample(range(1, 22), 2))]}
    rows = []
    for a, b in edges:
        n = rnd.randint(1, 9)
        rows += [(a, b, n, rnd.choice([-1, 1])), (b, a, n, rnd.choice([-1, 1]))]
    df = spark.createDataFrame(rows, "contig_id long, mate_id long, n long, side int")
    got = O.contig_order(df).collect()
    assert sorted(r.contig_id for r in got) == sorted({a for a, *_ in rows})
    for component in {r.component for r in got}:
        own = {r.contig_id for r in got if r.component == component}
        assert min(own) == component and all((a in own) == (b in own) for a, b in edges)
        mates = {c: sorted((b, n, s) for a, b, n, s in rows if a == c) for c in own}
        want = [(p, i, *x) for p, path in enumerate(O.ordered_paths(mates), 1) for i, x in enumerate(path, 1)]
        assert sorted((r.path, r.place, r.contig_id, r.direction) for r in got if r.component == component) == sorted(want)


def test_signed_edges(spark):
    pairs = [(1, 2, 990, 999, False, 1, 10, True), (1, 2, 980, 999, False, 5, 15, False), (2, 1, 3, 9, True, 985, 995, False), (1, 2, 500, 510, True, 1, 9, True), (3, 3, 1, 9, False, 1, 9, True)]
    p = spark.createDataFrame(pairs, "contig_id1 long, contig_id2 long, start1 long, end1 long, comp1 boolean, start2 long, end2 long, comp2 boolean")
    ends = spark.createDataFrame([(1, 0, 1000), (2, 0, 1000), (3, 0, 1000)], "contig_id long, first_base long, last_base long")
    assert sorted(tuple(r) for r in O.signed_edges(p, ends, 50).collect()) == [(1, 2, 3, 1), (2, 1, 3, -1)]
    assert O.contig_order(O.signed_edges(p.limit(0), ends, 50)).count() == 0
