"""Approximate nearest neighbours: score-aware quantisation, four-bit table scans, exact reranking.

Euclidean nearness becomes a largest inner product, ``q.x - |x|**2 / 2``, with the norms kept
exactly. The vector's direction is quantised to 4 bits for every two dimensions; codebooks and codes
minimise an anisotropic loss in which the residual along the vector weighs ``eta`` times the
residual across it, as it is that part which spoils the largest inner products.

Codebooks are fitted on a bounded sample; every row is indexed. A task scans its codes with a
table per query (16 entries for each pair of dimensions). A code's estimate of the cosine is off by
``error * |residual|`` at most, but for one pair in ``1 / (1 - certainty)``; ``error`` is
measured on the sample and the residual's length is stored. Every row whose estimate may still
beat the query's k-th distance so far is measured exactly, however many there are, so a cluster of
near copies loses none. The bests of all tasks meet in a ranked window. Queries are broadcast in
blocks of ``query_block`` rows, so that no broadcast grows with the table; each block scans all
codes, as the vectors here are uniform on the sphere and a coarse partition would lose recall.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CENTRES = 16
STEP = 2048
#: No vector found yet.
NONE = np.iinfo(np.int64).max


@dataclass
class Quantiser:
    books: np.ndarray  # pairs of dimensions x 16 x 2
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = 2 * len(self.books) - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), len(self.books), 2)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """A code for each pair of dimensions: nearest centres, then descent by coordinates on the anisotropic loss."""
        parts = self.split(x.astype(np.float32))
        along = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
        codes = np.stack([((parts[:, m, None] - book) ** 2).sum(-1).argmin(1) for m, book in enumerate(self.books)], 1)
        residual = parts - self.books[np.arange(len(self.books)), codes]
        parallel = (residual * along).sum((1, 2))
        for _ in range(rounds):
            for m, book in enumerate(self.books):
                rest = parallel - (residual[:, m] * along[:, m]).sum(1)
                trial = parts[:, m, None] - book
                side = (trial * along[:, m, None]).sum(-1)
                codes[:, m] = ((trial**2).sum(-1) + (self.eta - 1) * (rest[:, None] + side) ** 2).argmin(1)
                residual[:, m] = trial[np.arange(len(x)), codes[:, m]]
                parallel = rest + (residual[:, m] * along[:, m]).sum(1)
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """pairs x 16 x queries: the part of each inner product that a code stands for."""
        return np.einsum("mcd,qmd->mcq", self.books, self.split(queries.astype(np.float32)), optimize=True)


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 0) -> Quantiser:
    """``threshold`` is the share of a query's norm above which an inner product matters; it sets eta."""
    d = x.shape[1]
    pairs = -(-d // 2)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    q = Quantiser(np.zeros((pairs, CENTRES, 2), np.float32), eta)
    parts = q.split(x.astype(np.float32))
    along = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
    for m in range(pairs):
        q.books[m] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m]
    for _ in range(rounds):
        codes = q.encode(x, 1)
        residual = parts - q.books[np.arange(pairs), codes]
        parallel = (residual * along).sum((1, 2))
        for m in range(pairs):
            rest = parallel - (residual[:, m] * along[:, m]).sum(1)
            u, v = along[:, m].astype(np.float64), parts[:, m].astype(np.float64)
            pull = v + (eta - 1) * (rest + (u * v).sum(1))[:, None] * u
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    weight = own.sum() * np.eye(2) + (eta - 1) * u[own].T @ u[own]
                    q.books[m, c] = np.linalg.solve(weight, pull[own].sum(0))
                else:
                    q.books[m, c] = parts[rng.integers(len(x)), m]
            residual[:, m] = parts[:, m] - q.books[m, codes[:, m]]
            parallel = rest + (residual[:, m] * along[:, m]).sum(1)
    return q


def fit_error(q: Quantiser, x: np.ndarray, certainty: float) -> float:
    """The share of |residual| that an estimate is off by, at most, in ``certainty`` of the pairs of a sample of directions."""
    x = x[:2048]
    residual = (q.split(x) - q.books[np.arange(len(q.books)), q.encode(x)]).reshape(len(x), -1)[:, : x.shape[1]]
    return float(np.quantile(np.abs(residual @ x.T) / np.maximum(np.linalg.norm(residual, axis=1), 1e-9)[:, None], certainty))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in single precision, lengths in double precision)."""
    x = x.astype(np.float64)
    largest = np.abs(x).max(axis=1, keepdims=True)
    small = np.linalg.norm(x / largest, axis=1)
    return (x / largest / small[:, None]).astype(np.float32), small * largest[:, 0]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _encoder(shared, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = pickle.loads(shared.value)
        for batch in batches:
            x = directions(_matrix(batch.column("vector"), d))[0]
            codes = quantiser.encode(x)
            residual = np.sqrt(((quantiser.split(x) - quantiser.books[np.arange(len(quantiser.books)), codes]) ** 2).sum((1, 2)))
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = codes[:, ::2] | codes[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(residual.astype(np.float32))], [*batch.schema.names, "codes", "residual"])

    return run


def _bests(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among anyone's k nearest: of equal vectors, the k + 1 smallest ids."""
    rows = np.ascontiguousarray(x).view(np.void(x.shape[1] * x.itemsize).dtype).ravel()
    _, kind = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, kind))
    first = np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) != 0]))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[place <= k])


class Bests:
    """The k nearest found so far of each query, nearest first, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.score, self.ids = np.full((len(query_ids), k), np.inf), np.full((len(query_ids), k), NONE)

    def measure(self, x: np.ndarray, ids: np.ndarray, row: np.ndarray, query: np.ndarray, most: int = 50_000) -> None:
        """Exact distances of (row, query) pairs, ``most`` at a time, merged into the bests."""
        for a in range(0, len(row), most):
            r, q = row[a : a + most], query[a : a + most]
            with np.errstate(over="ignore"):
                score = np.sqrt(((x[r] - self.queries[q]) ** 2).sum(1))
            good = (ids[r] != self.query_ids[q]) & (score <= self.score[q, -1])
            r, q, score = r[good], q[good], score[good]
            order = np.lexsort((ids[r], score, q))
            r, q, score = r[order], q[order], score[order]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            top = place < self.k
            who, number = np.unique(q[top], return_inverse=True)
            new_score, new_ids = np.full((len(who), self.k), np.inf), np.full((len(who), self.k), NONE)
            new_score[number, place[top]], new_ids[number, place[top]] = score[top], ids[r[top]]
            score, found = np.concatenate([self.score[who], new_score], 1), np.concatenate([self.ids[who], new_ids], 1)
            order = np.lexsort((found, score), axis=1)[:, : self.k]
            self.score[who], self.ids[who] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)


def _scan(shared, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, error, query_ids, queries = pickle.loads(shared.value)
        n, bests = len(query_ids), Bests(query_ids, queries, k)
        small, norms = directions(queries)
        for batch in batches:
            ids_all, x_all = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("vector"), d)
            keep = _bests(x_all, ids_all, k)
            packed = np.frombuffer(b"".join(batch.column("codes").take(pa.array(keep)).to_pylist()), np.uint8).reshape(len(keep), -1)
            codes_all = np.stack([packed & 15, packed >> 4], 2).reshape(len(keep), -1)
            ids_all, x_all = ids_all[keep], x_all[keep].astype(np.float64)
            lengths, slack = directions(x_all)[1], error * batch.column("residual").to_numpy(zero_copy_only=False)[keep] + 1e-5  # and single precision
            for a in range(0, len(keep), STEP):
                part = slice(a, a + STEP)
                ids, x, codes = ids_all[part], x_all[part], codes_all[part]
                for b in range(0, n, 256):
                    own = slice(b, min(n, b + 256))
                    tables = quantiser.tables(small[own])
                    cosine = np.repeat(slack[part, None].astype(np.float32), tables.shape[2], 1)
                    for m in range(len(tables)):
                        cosine += tables[m][codes[:, m]]
                    with np.errstate(over="ignore", invalid="ignore"):  # the least squared distance that an estimate allows
                        least = norms[own] ** 2 + lengths[part, None] ** 2 - 2 * norms[own] * lengths[part, None] * cosine
                    fresh = bests.ids[own, -1] == NONE  # no k-th distance yet: the best estimates give a first one
                    if fresh.any():
                        r = min(4 * k, len(ids))
                        top = np.argpartition(least[:, fresh], r - 1, axis=0)[:r]
                        bests.measure(x, ids, top.ravel(), np.tile(np.flatnonzero(fresh) + b, r))
                    with np.errstate(over="ignore"):
                        row, query = np.nonzero(~(least > bests.score[own, -1] ** 2))
                    if fresh.any():  # those are measured already
                        done = np.zeros(least.shape, bool)
                        done[top, np.flatnonzero(fresh)] = True
                        new = ~done[row, query]
                        row, query = row[new], query[new]
                    bests.measure(x, ids, row, query + b)
        row, place = np.nonzero(bests.ids != NONE)
        for a in range(0, len(row), 100_000):
            r, p = row[a : a + 100_000], place[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[r]), pa.array(bests.ids[r, p]), pa.array(bests.score[r, p])], ["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 8192,
    certainty: float = 0.9995,
    query_block: int = 1 << 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``is_query``, its k nearest other ids.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id, and there
    are fewer than k rows only if there are fewer candidates. Vectors that are null, empty or zero,
    hold null or non-finite components or have a null id take no part; a vector's candidates have
    its length. Rows with equal ids and vectors count once; of different vectors with one id each
    is a candidate of others, and the smallest in the order of arrays asks for the id. Rows with
    the query's id are the query's own. The codebooks come from ``sample_rows`` rows, smallest by a
    hash of the id.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    element = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    v = F.transform(F.col(vector_col), lambda x: x.cast(element))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = vectors.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = scratch.save(valid.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks")), "valid")  # equal rows once
    lengths = valid.select(F.size("vector").alias("d")).distinct().orderBy("d").collect()  # one row a length of vectors
    found = [f for own in lengths for f in _found(valid.filter(F.size("vector") == own["d"]), own["d"], element, scratch, k, sample_rows, certainty, query_block)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(valid: DataFrame, d: int, element: str, scratch: Scratch, k: int, sample_rows: int, certainty: float, query_block: int) -> Iterator[DataFrame]:
    """(query_id, vec_id, score) of the bests of each task, for each block of queries among the vectors of one length."""
    context = valid.sparkSession.sparkContext
    sample = valid.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).toArrow()
    sample = directions(_matrix(sample.column("vector").combine_chunks(), d))[0]
    quantiser = fit(sample)
    error = fit_error(quantiser, sample, certainty)
    encoded = valid.mapInArrow(_encoder(context.broadcast(pickle.dumps(quantiser)), d), f"vec_id bigint, vector array<{element}>, asks boolean, codes binary, residual float")
    index = scratch.save(encoded, f"index{d}")
    asking = index.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = -(-asking.count() // query_block)
    dealt = scratch.save(asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))), f"queries{d}")
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).toArrow()  # about query_block rows
        if not rows.num_rows:
            continue
        ids, queries = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), d).astype(np.float64)
        shared = context.broadcast(pickle.dumps((quantiser, error, ids, queries)))
        yield index.select("vec_id", "vector", "codes", "residual").mapInArrow(_scan(shared, d, k), "query_id bigint, vec_id bigint, score double")


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 10) -> dict[int, list[tuple[int, float]]]:
    """For tests: the exact answers of the ids in ``queries``."""
    out, x = {}, x.astype(np.float64)
    for q in queries.tolist():
        own = x[ids == q][0]
        score = np.sqrt(((x - own) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out
