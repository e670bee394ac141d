"""Paths through contigs by arrays equal walks over one contig after the other, and large components end soon."""

import random
import time
from collections import deque

from strandloom.operators import contig_order as O


def made(contigs, degree, seed):
    rnd, edges = random.Random(seed), {}
    for _ in range(contigs * degree // 2):
        a, b = rnd.sample(range(1, contigs + 1), 2)
        for way in ((a, b), (b, a)):
            edges.setdefault(way, (rnd.randint(1, 5), rnd.choice([-1, 1])))
    mates = {}
    for (a, b), x in sorted(edges.items()):
        mates.setdefault(a, []).append((b, *x))
    return mates


def plain_chain(mates, free):
    def walk(start):
        parent, queue = {start: None}, deque([start])
        while queue:
            last = queue.popleft()
            for m, _, _ in mates[last]:
                if m in free and m not in parent:
                    parent[m] = last
                    queue.append(m)
        return parent, last

    _, far = walk(min(free))
    parent, at = walk(far)
    chain = []
    while at is not None:
        chain.append(at)
        at = parent[at]
    return chain[::-1]


def test_chains_of_paths_equal_plain_walks():
    for seed in range(60):
        mates = made(2 + seed % 40, 1 + seed % 6, seed)
        free, paths = set(mates), O.ordered_paths(mates)
        for path in paths:
            names = [c for c, _ in path]
            chain = plain_chain(mates, free)
            assert [c for c in names if c in set(chain)] == chain
            free -= set(names)
        assert not free


def test_large_component_in_time():
    mates = made(6000, 50, 1)
    begin = time.process_time()
    paths = O.ordered_paths(mates)
    assert time.process_time() - begin < 8  # by single contigs 17 s on the machine where arrays took 1.5 s
    assert sorted(c for p in paths for c, _ in p) == sorted(mates)
