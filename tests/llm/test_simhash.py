import random

import numpy as np
import pytest

from strandloom.llm import simhash
from strandloom.llm.common import Scratch


def near_rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for base in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 250))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy).upper()))
    return [*rows, (500, None), (501, ""), (502, " \x0b\n"), (None, rows[0][1]), (None, None), (3, rows[9][1]), (3, rows[9][1]), (504, "é x"), (505, "word " * 30000)]


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_matches_brute_force(spark, cell_rows):
    rows = near_rows()
    df = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], "doc_id long, text string, fp string, id int").repartition(3)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, cell_rows=cell_rows).collect()]
    assert sorted(got, key=str) == sorted(simhash.brute_force(rows), key=str)
    assert len({c for _, _, c in got}) < len(rows) - 20
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_links_connect_dense_groups(spark, cell_rows):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        prints.add(base)
        for _ in range(60):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            prints.add(x)
    values = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    scratch = Scratch(spark, "test")
    links = simhash.links_between(df, 4, scratch, cell_rows)
    label = {r.node: r.label for r in simhash.components(links, scratch).collect()}
    parent = {int(v): int(v) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= 4):
            parent[root(int(v))] = root(int(values[j]))
    as_long = {int(v): int(np.uint64(v).view(np.int64)) for v in values}
    want: dict = {}
    for v in parent:
        want.setdefault(root(v), set()).add(as_long[v])
    found: dict = {}
    for v in parent:
        found.setdefault(label.get(as_long[v], as_long[v]), set()).add(as_long[v])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))
    assert all(k == min(v) for k, v in found.items())


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    plain = sum(abs(np.bitwise_count(a >> np.uint64(2 * s) & np.uint64(3)).astype(int) - np.bitwise_count(b >> np.uint64(2 * s) & np.uint64(3))) for s in range(32))
    assert (simhash.manhattan(simhash.counts_of(a), simhash.counts_of(b)) == plain).all()
    assert (plain <= np.bitwise_count(a ^ b)).all()


def test_empty_batches_between_others():
    import pyarrow as pa

    batch = lambda cells, prints: pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(prints, pa.int64())], ["cell", "fp"])
    batches = [batch([], []), batch([1, 1], [0, 3]), batch([], []), batch([1, 2], [7, 9]), batch([], [])]
    found = {tuple(sorted(x)) for out in simhash._links(4, 4096)(iter(batches)) for x in zip(out.column(1).to_pylist(), out.column(2).to_pylist())}
    assert found and all(bin(a ^ b).count("1") <= 4 for a, b in found) and {x for pair in found for x in pair} == {0, 3, 7}
    assert list(simhash._links(4, 4096)(iter([batch([], [])]))) == []
