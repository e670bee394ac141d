"""Haplotype sets against a plain merge over lists of edges, and cases worked out by hand."""

import math
import random

import pytest

from strandloom.operators import haplotypes as H


def plain_sets(scores, calls, weights, least, offset, two_pass=False, most_sets=0):
    """The rule, with all edges and links worked out anew after every merge."""
    names = sorted({t for _, t, _ in calls})
    counts = {t: {p: [0] * 5 for p in scores} for t in names}
    for p, t, c in calls:
        counts[t][p][c] += 1

    def edge(a, b):
        total, shared = 0, 0
        for p, s in scores.items():
            x, y = ([v - sum(m[p]) / 5 for v in m[p]] for m in (counts[a], counts[b]))
            norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
            if norm:
                shared += 1
                total += round(1e6 * 100 * (sum(v * w for v, w in zip(x, y)) / norm - offset) * s)
        return total, shared

    edges = {(a, b): edge(a, b)[0] for i, a in enumerate(names) for b in names[i + 1 :] if edge(a, b)[1]}

    def pure(a, b):
        score = total = 0
        for p, s in scores.items():
            for j in range(5):
                for k in range(5):
                    if counts[a][p][j] and counts[b][p][k]:
                        score, total = score + (s if j == k else -s), total + s
        return ((abs(score) + 500) / (total + 500)) ** 2

    purity = {}
    for t in names:
        of = [pure(*e) for e in edges if t in e]
        purity[t] = min(of + [1]) * (sum(of) + 5) / (len(of) + 5)
    between = lambda a, b: edges.get((a, b), edges.get((b, a)))

    def link(a, b):
        found = edges[a, b]
        if found >= 0:
            for x in names:
                p, q = between(a, x), between(b, x)
                if x not in (a, b) and p is not None and q is not None:
                    found += (abs(p + q) - abs(p - q)) / 100
        return round(found * 1e-6 * purity[a] * purity[b] * weights.get(a, 1) * weights.get(b, 1), 6)

    groups = {t: {t} for t in names}

    def passes(least, stop):
        while len(names) > stop and edges:
            rank, a, b = min((-link(*e), min(e), max(e)) for e in edges)
            if -rank <= least:
                break
            a, b = (a, b) if (a, b) in edges else (b, a)
            del edges[a, b]
            for p in scores:
                counts[a][p] = [x + y for x, y in zip(counts[a][p], counts[b][p])]
            names.remove(b)
            groups[a] |= groups.pop(b)
            for x in names:
                for e in ((b, x), (x, b)):
                    if e in edges:
                        del edges[e]
                        if between(a, x) is None:
                            edges[(a, x) if e[0] == b else (x, a)] = 0
            for e in edges:
                if a in e:
                    edges[e] = edge(*e)[0]

    def fill():
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if between(a, b) is None:
                    edges[a, b] = 0

    passes(least, 1)
    if two_pass:
        fill()
        passes(least, 1)
    if most_sets:
        fill()
        passes(-1e6, most_sets)
    return sorted(sorted(g) for g in groups.values())


def made(seed, n_sites=9, n_templates=14, kinds=2, noise=0.1):
    rnd = random.Random(seed)
    scores = {p * 5: rnd.randint(20, 400) + rnd.random() for p in range(n_sites)}
    truth = [[rnd.randint(0, 4) for _ in range(n_sites)] for _ in range(kinds)]
    calls = []
    for t in range(n_templates):
        first, own = rnd.randrange(n_sites - 2), rnd.choice(truth)
        for p in range(first, min(n_sites, first + rnd.randint(2, 5))):
            if rnd.random() < 0.9:
                calls.append((p * 5, t + 1, rnd.randint(0, 4) if rnd.random() < noise else own[p]))
    return scores, calls, {t + 1: rnd.choice([1, 1, 0.1]) for t in range(n_templates)}


def tables(spark, cases):
    sites = [(c, p, s) for c, (scores, _, _) in enumerate(cases) for p, s in scores.items()]
    calls = [(c, *x) for c, (_, found, _) in enumerate(cases) for x in found]
    weights = [(c, t, float(w)) for c, (_, _, ws) in enumerate(cases) for t, w in ws.items()]
    return (
        spark.createDataFrame(sites, "contig_id long, pos long, score double"),
        spark.createDataFrame(calls, "contig_id long, pos long, template long, code int"),
        spark.createDataFrame(weights, "contig_id long, template long, weight double"),
    )


def sets_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.contig_id, {}).setdefault(r.set_id, []).append(r.template)
    assert all(min(ts) == s for groups in found.values() for s, ts in groups.items())
    return {c: sorted(sorted(ts) for ts in groups.values()) for c, groups in found.items()}


@pytest.mark.parametrize("options", [{}, {"offset": 0.9, "least": 10.0}, {"two_pass": True}, {"offset": 0.5, "most_sets": 3}])
def test_sets_equal_a_plain_merge(spark, options):
    cases = [made(seed, noise=0.3 if seed % 2 else 0.0, kinds=2 + seed % 2) for seed in range(24)]
    got = sets_of(H.haplotype_sets(*tables(spark, cases), **options))
    full = {"least": 0.0, "offset": 0.0} | options
    for c, (scores, calls, weights) in enumerate(cases):
        assert got[c] == plain_sets(scores, calls, weights, **full), c
    assert any(1 < len(sets) < 10 for sets in got.values())


def test_two_haplotypes_by_hand(spark):
    # templates 1, 3, 5 say A at all sites, 2, 4, 6 say C; edges of unlike ones are below 0
    calls = [(p, t, t % 2) for t in range(1, 7) for p in (10, 20, 30)]
    got = sets_of(H.haplotype_sets(*tables(spark, [({10: 50.0, 20: 60.0, 30: 70.0}, calls, {})])))
    assert got == {0: [[1, 3, 5], [2, 4, 6]]}


def test_large_contigs_go_in_rounds(spark):
    # two clean haplotypes over 40 sites, reads of six sites; no task may hold over 20 nodes
    scores = {p * 100: 100.0 for p in range(40)}
    calls = [(p * 100, t, (t % 2) * 2) for t in range(1, 141) for p in range((t * 11) % 35, (t * 11) % 35 + 6)]
    got = sets_of(H.haplotype_sets(*tables(spark, [(scores, calls, {}), (scores, calls[:60], {})]), most_nodes=20, width=500))
    assert got[0] == [list(range(1, 141, 2)), list(range(2, 141, 2))]
    assert got[1] == plain_sets(scores, calls[:60], {}, 0.0, 0.0)


def test_spaced_sites_and_template_bases(spark):
    sites = spark.createDataFrame([(1, 10, 60.0), (1, 11, 60.0), (1, 13, 60.0), (2, 12, 60.0)], "contig_id long, pos long, score double")
    # 10: 3 + 2; 11: 3 + 2 + 1; 13: 3 + 1
    assert {(r.contig_id, r.pos): round(r.score, 9) for r in H.spaced_sites(sites).collect()} == {(1, 10): 36.0, (1, 11): 30.0, (1, 13): 45.0, (2, 12): 60.0}
    bases = [(1, 10, 7, 0, 30), (1, 10, 7, 1, 20), (1, 10, 8, 2, 30), (1, 10, 8, 2, 20), (1, 10, 9, 3, 30), (1, 10, 9, 3, 9), (1, 10, 9, 4, 15), (1, 10, 5, 5, 40), (1, 12, 8, 1, 40), (1, 11, 6, 0, 20), (1, 11, 6, 1, 20)]
    found = H.template_bases(spark.createDataFrame(bases, "contig_id long, pos long, template long, code int, qual int"), sites, 12)
    assert {(r.pos, r.template): (r.code, r.conf) for r in found.collect()} == {(10, 8): (2, 50), (10, 9): (3, 15)}


def test_empty_tables(spark):
    sites, calls, weights = tables(spark, [made(1)])
    assert H.haplotype_sets(sites.limit(0), calls, weights).count() == 0
    assert H.chimera_scores(sites, calls.limit(0)).count() == 0


def test_edges_of_a_node_are_those_of_its_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    cells = sorted({(int(n), int(p)) for n, p in rng.integers(0, [12, 9], (60, 2))})
    node, site = (np.array(x) for x in zip(*cells))
    graph = H.Graph(node, site, rng.integers(0, 3, (len(cells), 5)), rng.uniform(1, 1000, 9), 0.25)
    near = np.array([x for x in range(graph.size) if x != 4])

    def pair(x):
        shared = graph.rows[4].keys() & graph.rows[x].keys()
        return sum(int(graph._gains(graph.rows[4][p][None], graph.rows[x][p][None], graph.scores[p])[0][0, 0]) for p in shared)

    assert graph._edges_of(4, near).tolist() == [pair(x) for x in near.tolist()]
    assert graph._edges_of(4, near[:0]).tolist() == []
