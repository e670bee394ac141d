import numpy as np

from strandloom.llm import codebooks
from strandloom.llm.queries import op11_sql, queries
from tests.oracle import compare, connection

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def nearest(x, book):
    d = ((x[:, None].astype(object) - book.astype(object)[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def test_trees_cover_and_assign_as_single_points_do():
    rng = np.random.default_rng(3)
    clustered = (rng.integers(-900, 900, (6, 5))[rng.integers(0, 6, 700)] + rng.integers(-3, 4, (700, 5))).astype(np.int64)
    for x in (clustered, rng.integers(-40, 40, (400, 3)), np.zeros((50, 4), np.int64), rng.integers(-(1 << 25), 1 << 25, (90, 16)), np.zeros((0, 4), np.int64)):
        tree = codebooks.CoverTree(x)
        assert sorted(tree.order) == list(range(len(x))) and (tree.points == x[tree.order]).all()
        for r, a, b, f, t in zip(tree.radius, tree.start, tree.end, tree.first, tree.last):
            far = np.sqrt(((tree.points[a:b].astype(float) - tree.points[a]) ** 2).sum(1))
            assert abs(far.max() - r) < 1e-6 * (1 + r)
            if t > f:  # children part the run, none has over half the radius, the first keeps the centre
                assert tree.start[f] == a and tree.end[t - 1] == b and (tree.start[f + 1 : t] == tree.end[f : t - 1]).all()
                assert (tree.radius[f:t] <= r / 2 + 1e-9).all()
                centres = tree.points[tree.start[f:t]].astype(float)
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(t - f) * r
                assert (apart > r / 2 - 1e-9).all()
        book = np.concatenate([x[:9], x[:2]]) if len(x) else np.ones((3, 4), np.int64)
        code, error = nearest(x, book)
        got, far = tree.codes(book)
        assert got.tolist() == code.tolist() and far.tolist() == error.tolist()
        n, total = tree.sums(book)
        assert n.tolist() == np.bincount(code.astype(int), minlength=len(book)).tolist()
        assert all((total[e] == x[code == e].sum(0)).all() for e in range(len(book)))


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (8, 16))
    x = (centres[rng.integers(0, 8, 2000)] + rng.integers(-2, 3, (2000, 16))).astype(np.int64)
    _, start, end, measured = codebooks.CoverTree(x).assign(centres)
    assert (end - start).max() > 100 and measured < 200


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    x[40:90] = x[3]
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(1000)[:120], x)]
    odd = [(5000, None), (5001, [1.0, None, *[0.0] * 6]), (5002, [float("nan")] * 8), (5003, [float("-inf")] * 8)]
    labels = [None if i % 7 == 0 else i % 3 for i in range(124)]
    df = spark.createDataFrame([(i, v, label, "c", "e") for (i, v), label in zip(rows + odd, labels)], SCHEMA).repartition(5)
    want, digest = codebooks.brute_force(rows + odd, entries=20, rounds=3)
    for chunk in (7, 1000):
        coded, found = codebooks.compress(df, entries=20, rounds=3, chunk_rows=chunk)
        got = codebooks.with_label_errors(coded).collect()
        assert found.digest() == digest
        assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == 120
        sums = {}
        for (i, _), label in zip(rows, labels):
            sums[label] = sums.get(label, 0) + want[i][1]
        by_id = {i: label for (i, _), label in zip(rows, labels)}
        assert all(r.label_error == sums[by_id[r.vec_id]] and r.label == by_id[r.vec_id] for r in got)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    coded, found = codebooks.compress(empty)
    assert codebooks.with_label_errors(coded).count() == 0 and found.books.shape[1] == 0
    rows = [(1, [0.5] * 6, None, "", ""), (1, [0.5] * 6, 1, "", ""), (None, [1e300] * 6, 1, "", ""), (2, [], 1, "", ""), (3, [-1e300, 1.0], 1, "", "")]
    coded, found = codebooks.compress(spark.createDataFrame(rows, SCHEMA))
    got = {(r.vec_id, r.code, r.error) for r in coded.collect()}
    assert found.books.shape == (4, 5, 2)
    assert {(i, c) for i, c, _ in got} == {(1, "00000000"), (2, "02020200"), (3, "03020200"), (None, "04040400")}
    assert codebooks.with_label_errors(coded).count() == 5


def test_query_matches_sql(spark):
    small = "/root/testdata/sf0.001"
    assert compare(queries()["op11_cover_tree_codes"](spark, small), connection(small), op11_sql()) == ""
