"""Contig extension: a case worked out by hand and a walk over columns and reads in plain Python."""

import random

from strandloom.operators import extension as X

LETTERS = "ACGT*N"


def tables(spark, reads, calls):
    """reads: (contig, rec, start, text, first and last visible column)"""
    items = [(c, r, s, s + len(t) - 1, a, b) for c, r, s, t, a, b in reads]
    bases = [(c, r, s + i, LETTERS.index(x)) for c, r, s, t, _, _ in reads for i, x in enumerate(t)]
    return (
        spark.createDataFrame(items, "contig_id long, rec long, start int, end int, vstart int, vend int"),
        spark.createDataFrame(bases, "contig_id long, rec long, pos int, code int"),
        spark.createDataFrame([(c, p, b) for (c, p), b in calls.items()], "contig_id long, pos int, base string"),
    )


def plain(reads, calls, depth, match=1, mismatch=-3):
    """One side of one contig, seen to the right."""
    last = max(b for *_, b in reads)
    kept = []
    for _, r, s, t, _, b in reads:
        if s <= last <= s + len(t) - 1:
            part = range(b + 1, last + 1)
            wrong = sum(t[p - s] != calls.get(p) for p in part)
            if not part or 100 * wrong // len(part) <= 5:
                kept.append((r, t[last + 1 - s :]))
    sequence, score, best, grown = "", 0, 0, 0
    for k in range(max([len(t) for _, t in kept], default=0)):
        column = [t[k] for _, t in kept if k < len(t) and t[k] in "ACGT"]
        if len(column) < depth:
            break
        top = max("ACGT", key=lambda x: (column.count(x), -ord(x)))
        sequence += top
        score += round((2 * column.count(top) - len(column)) / len(column) * 1e9)
        if score >= best:
            best, grown = score, k + 1
    clips = {}
    for r, t in kept:
        total = top = 0
        for k, x in enumerate(t[:grown]):
            total += match if x == sequence[k] else mismatch
            if x == sequence[k] and total >= top:
                top, clips[r] = total, k + 1
    return sequence[:grown], clips


def test_by_hand(spark):
    # the last visible column is 10; read 4's clipped part says G where the consensus says A: 1 of 2 columns, left out
    reads = [
        (1, 1, 1, "AAAAAAAAAACGTAC", 1, 10), (1, 2, 1, "AAAAAAAAAACGTT", 1, 10), (1, 3, 3, "AAAAAAAACCTACC", 3, 10), (1, 4, 3, "AAAAAAGATTTTT", 3, 8), (1, 5, 1, "AAAAAAAAA", 1, 9),
    ]
    items, bases, calls = tables(spark, reads, {(1, p): "A" for p in range(1, 11)})
    grown, clips = X.extensions(X.end_reads(items), bases, calls, 2)
    got = {r.side: (r.grown, r.sequence) for r in grown.collect()}
    # columns: C C C | G G C | T T T | A T A | C C, then one base only: 1 + 1/3 + 1 + 1/3 + 1
    assert got == {"right": (5, "CGTAC")}
    # read 2 ends with its match in the third column; read 3 has 1, -2, -1, 0, 1 and goes to the last of the best
    assert {r.rec: r.clip for r in clips.collect()} == {1: 5, 2: 3, 3: 5}


def test_equals_a_plain_walk(spark):
    rnd = random.Random(11)
    reads, calls = [], {}
    for c in range(30):
        truth = [rnd.choice("ACGT") for _ in range(60)]
        for p in range(60):
            calls[c, p] = truth[p] if rnd.random() < 0.97 else "-"
        for r in range(rnd.randint(3, 9)):
            s = rnd.randint(0, 25)
            e = rnd.randint(max(s + 3, 28), 59)
            text = "".join(rnd.choice(LETTERS) if rnd.random() < 0.06 else truth[p] for p in range(s, e + 1))
            a = rnd.randint(s, min(s + 15, e))
            reads.append((c, c * 100 + r, s, text, a, rnd.randint(a, max(a, min(e, 40)))))
    items, bases, df = tables(spark, reads, calls)
    grown, clips = X.extensions(X.end_reads(items), bases, df, 2)
    got = {(r.contig_id, r.side): r.sequence for r in grown.collect()}
    shown = {(r.side, r.rec): r.clip for r in clips.collect()}
    other = dict(zip("ACGT*N-", "TGCA*N-"))
    turn = lambda t: "".join(other[x] for x in reversed(t))
    want, want_clips = {}, {}
    for c in range(30):
        own = [r for r in reads if r[0] == c]
        back = [(c, r, -(s + len(t) - 1), turn(t), -b, -a) for _, r, s, t, a, b in own]
        for side, rows, called in (("right", own, {p: b for (x, p), b in calls.items() if x == c}), ("left", back, {-p: other[b] for (x, p), b in calls.items() if x == c})):
            sequence, found = plain(rows, called, 2)
            if sequence:
                want[c, side] = sequence
            want_clips |= {(side, r): k for r, k in found.items()}
    assert got == want and shown == want_clips and len(want) > 20


def test_empty(spark):
    items, bases, calls = tables(spark, [(1, 1, 1, "ACGT", 1, 4)], {(1, 1): "A"})
    for df in X.extensions(X.end_reads(items), bases, calls, 1) + X.extensions(X.end_reads(items.limit(0)), bases, calls, 1):
        assert df.count() == 0
