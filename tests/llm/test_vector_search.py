import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strandloom.llm import vector_search

DATA = "/root/testdata/sf0.1/embeddings.parquet"


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, exact in want.items():
        own = sorted(found.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(exact) + 1))
        assert all(a[2] <= b[2] for a, b in zip(own, own[1:]))
        hit += len({v for _, v, _ in own} & {v for v, _ in exact})
        total += len(exact)
        scores = dict(exact)
        for _, v, s in own:
            assert v not in scores or abs(s - scores[v]) < 1e-12
    return hit / total


def test_recall_on_the_table(spark):
    t = pq.read_table(DATA)
    ids = t["vec_id"].to_numpy()
    x = t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    got = vector_search.nearest(spark.read.parquet(DATA), F.col("vec_id") % 100 == 0).collect()
    assert recall(got, vector_search.brute_force(ids, x, ids[ids % 100 == 0])) >= 0.99


def test_a_third_of_near_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24))
    x[2000:4000] = x[5] + rng.normal(size=(2000, 24)) * 1e-3
    ids = rng.permutation(6000)
    df = spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = vector_search.nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = vector_search.brute_force(ids, x, ids[ids % 50 == 0])
    assert recall(got, want) >= 0.99
    assert recall(got, {q: own for q, own in want.items() if 2000 <= int(np.flatnonzero(ids == q)[0]) < 4000}) >= 0.99


def test_doubles_repeated_rows_and_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[17, 0] = 1e39
    rows = [(i, row.tolist()) for i, row in enumerate(x)]
    rows += rows[:150] * 3 + [(7, [9.0] * 6), (1000, [1.0, 2.0]), (1001, [1.0, 2.5]), (1002, [4.0, 2.0]), (2000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = vector_search.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id >= 300) == [(1000, 1, 1001), (1000, 2, 1002)]
    ids = np.append(np.arange(300), 7)
    want = vector_search.brute_force(ids, np.concatenate([x, [[9.0] * 6]]), np.arange(0, 300, 100))
    assert recall([r for r in got if r.query_id < 300], want) >= 0.95
    far = vector_search.nearest(df.filter("vec_id in (17, 18, 19)"), F.col("vec_id") == 17).collect()
    assert [r.vec_id for r in sorted(far, key=lambda r: r.rank)] == [18, 19] and all(r.score > 9e38 for r in far)


def test_odd_rows_ties_and_hot_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    x[200:420] = x[7]
    ids = np.arange(600)
    rows = [(int(i), [float(v) for v in row], "clash") for i, row in zip(ids, x)]
    odd = [(1000, None, ""), (1100, [0.0] * 5, ""), (1200, [1.0, None, 0.0, 0.0, 1.0], ""), (1300, [float("nan")] * 5, ""), (1400, [float("inf"), 1.0, 1.0, 1.0, 1.0], ""), (None, [1.0] * 5, ""), (1500, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string").repartition(6)
    got = vector_search.nearest(df, F.col("vec_id") % 100 == 0, query_block=3).collect()
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400, 500}
    assert recall(got, vector_search.brute_force(ids, x, np.arange(0, 600, 100))) >= 0.9
    hot = [r.vec_id for r in sorted((r for r in got if r.query_id == 300), key=lambda r: r.rank)]
    assert hot == [7, *range(200, 209)]
    few = vector_search.nearest(df.filter("vec_id < 4"), F.col("vec_id") % 100 == 0).collect()
    assert [r.rank for r in sorted(few)] == [1, 2, 3]
    assert vector_search.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
