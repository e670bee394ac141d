"""Vector code compression: Lloyd's rounds over partition-local cover trees.

Every vector is cut into equal parts of whole numbers, and each part position has its own codebook.
Tasks grow, once, one cover tree for each chunk of rows and part position: a node's points lie within its
radius of the node's centre, its children's radii are half of its own, a child's centre is a point
that no earlier child covers, and the first child keeps its parent's centre. Points are stored in the
order of the leaves, so that a subtree is a run of them and its sum is the difference of two
cumulative sums.

A round sends the codebooks (bounded: parts x 256 entries) to the tasks. A node whose nearest entry
is nearer than the second nearest by more than twice the node's radius gives its whole subtree to it
(triangle inequality); only the other nodes descend, and single points are compared exactly, in whole
numbers, with ties to the lower index. Tasks hand on one sum and count an entry, so a round
shuffles parts x 256 rows a task whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_hot

#: Larger components count as this, so that squared distances of parts of up to 1024 components are exact longs.
LARGEST = 1 << 25
#: Below this, products and sums of squares are exact in double precision.
FINE = 1 << 21


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances between two sets of integer vectors, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < FINE:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)


class CoverTree:
    """Nodes in order of breadth; node ``i`` has the points ``start[i]`` to ``end[i]`` of ``points``, its centre first."""

    def __init__(self, x: np.ndarray):
        """``order`` tells which row of ``x`` each point is."""
        n, width = x.shape
        all_rows = np.arange(n)
        queue = [(all_rows, np.sqrt(((x - x[:1]) ** 2).sum(1).astype(np.float64)))] if n else []
        radius, start, end, first, last = [], [], [], [], []
        order = np.empty(n, np.int64)
        places = [0]
        for rows, far in queue:  # grows while it is read; a node's rows begin with its centre
            place = places[len(radius)]
            reach = float(far.max())
            radius.append(reach)
            start.append(place)
            end.append(place + len(rows))
            first.append(len(queue))
            if reach == 0:
                order[place : place + len(rows)] = rows
            else:
                while len(rows):
                    near = far <= reach / 2
                    queue.append((rows[near], far[near]))
                    places.append(place)
                    place += int(near.sum())
                    rows = rows[~near]
                    if len(rows):
                        far = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1).astype(np.float64))
            last.append(len(queue))
        self.order = order.astype(np.int32)
        self.points = x[order].astype(np.int32)
        self.radius = np.array(radius)
        self.start, self.end, self.first, self.last = (np.array(v, np.int32) for v in (start, end, first, last))

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entries, starts, ends) of the subtrees that go to one entry each, and how many centres were measured."""
        if not len(self.radius):
            none = np.zeros(0, np.int64)
            return none, none, none, 0
        points = self.points.astype(np.int64)
        own = np.sort(np.unique(book, axis=0, return_index=True)[1])  # of equal entries the first
        entries = book[own]
        frontier = np.zeros(1, np.int64)
        far = squared_distances(points[self.start[frontier]], entries)
        measured, found = 1, []
        while len(frontier):
            nearest = far.argmin(1)
            one = np.sqrt(far[np.arange(len(far)), nearest].astype(np.float64))
            two = np.sqrt(np.partition(far, 1, axis=1)[:, 1].astype(np.float64)) if far.shape[1] > 1 else np.full(len(far), np.inf)
            radius = self.radius[frontier]
            done = (radius == 0) | (one + 2 * radius < two * (1 - 1e-12) - 1e-9)
            found.append((own[nearest[done]], frontier[done]))
            parents, above = frontier[~done], far[~done]
            number = (self.last - self.first)[parents].astype(np.int64)
            begin = np.cumsum(number) - number
            frontier = np.repeat(self.first[parents] - begin, number) + np.arange(number.sum())
            far = np.empty((len(frontier), len(entries)), np.int64)
            far[begin] = above  # a first child has its parent's centre
            new = np.ones(len(frontier), bool)
            new[begin] = False
            if new.any():
                far[new] = squared_distances(points[self.start[frontier[new]]], entries)
            measured += int(new.sum())
        entry, node = (np.concatenate(x) for x in zip(*found, strict=True))
        by_place = np.argsort(self.start[node], kind="stable")
        return entry[by_place], self.start[node][by_place].astype(np.int64), self.end[node][by_place].astype(np.int64), measured

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many points each entry gets, and their sums."""
        entry, start, end, _ = self.assign(book)
        so_far = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)])
        counts, totals = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        np.add.at(counts, entry, end - start)
        np.add.at(totals, entry, so_far[end] - so_far[start])
        return counts, totals

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entry and its squared distance, in the order of the rows that the tree was grown from."""
        entry, start, end, _ = self.assign(book)
        entry = np.repeat(entry, end - start)
        error = ((self.points.astype(np.int64) - book[entry]) ** 2).sum(1)
        code, errors = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
        code[self.order], errors[self.order] = entry, error
        return code, errors


def _padded(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """The vectors of a list column as rows of ``d`` whole numbers; shorter ones end in zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(column), d), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    return out


def _grow(d: int, parts: int, scale: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_batch.slice(a, chunk) for whole_batch in batches for a in range(0, whole_batch.num_rows, chunk)):
            x = _padded(batch.column("vector"), d, scale)
            trees = pickle.dumps([CoverTree(np.ascontiguousarray(own)) for own in np.split(x, parts, axis=1)])
            columns = [pa.ListArray.from_arrays([0, batch.num_rows], batch.column(c)) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.binary())], ["ids", "labels", "trees"])

    return run


def _sums(shared):
    """One row an entry that any of a task's trees uses: cell = part x entries + entry, count, sums by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = pickle.loads(shared.value)
        counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for trees in batch.column("trees"):
                for part, tree in enumerate(pickle.loads(trees.as_py())):
                    n, total = tree.sums(books[part])
                    counts[part] += n
                    totals[part] += total
        used = np.flatnonzero(counts.ravel())
        columns = totals.reshape(-1, books.shape[2])[used]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, counts.ravel()[used], *columns.T)], ["cell", "n", *(f"s{i}" for i in range(columns.shape[1]))])

    return run


def _codes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = pickle.loads(shared.value)
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(c) for c in ("ids", "labels", "trees")), strict=True):
                found = [tree.codes(book) for tree, book in zip(pickle.loads(trees.as_py()), books, strict=True)]
                codes = np.stack([code for code, _ in found], 1).astype(np.uint8)
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"]
                )

    return run


class Codebooks:
    """``books``: parts x entries x width, whole numbers."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def moved(self, rows: list, width: int) -> Codebooks:
        """Each used entry becomes the floor of its points' mean."""
        books = self.books.reshape(-1, width).copy()
        for r in rows:
            books[r["cell"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        return Codebooks(books.reshape(self.books.shape))


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    chunk_rows: int = 1024,
) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks): a code of two hex digits a part for each vector.

    Vectors that are null or hold null or non-finite components take no part. Vectors shorter than
    the longest, and a length that ``parts`` does not divide, are filled up with zeros; components
    beyond +-2**25 after scaling count as that. Repeated rows are rows of their own. The first
    codebook holds the ``entries`` rows with the smallest ids (null ids last, ties by the vector),
    or all rows if there are fewer. Other columns of the input play no part. An empty table gives no
    rows and empty codebooks.
    """
    if not (1 <= entries <= 256 and parts >= 1 and rounds >= 0):
        raise ValueError("entries from 1 to 256, parts from 1, rounds from 0")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codebooks")
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vector"))
    label_type = kept.schema["label"].dataType.simpleString()
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    begin = kept.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow()
    first = _padded(begin.column("vector").combine_chunks(), parts * width, scale) if begin.num_rows else np.zeros((0, parts * width), np.int64)
    found = Codebooks(np.stack(np.split(first, parts, axis=1)))
    trees = scratch.save(kept.mapInArrow(_grow(parts * width, parts, scale, chunk_rows), f"ids array<bigint>, labels array<{label_type}>, trees binary"), "trees")
    columns = [f"s{i}" for i in range(width)]
    for _ in range(rounds if begin.num_rows else 0):
        shared = spark.sparkContext.broadcast(pickle.dumps(found.books))
        sums = trees.select("trees").mapInArrow(_sums(shared), ", ".join(f"{c} bigint" for c in ("cell", "n", *columns)))
        found = found.moved(sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", *columns))).collect(), width)  # one row an entry
    coded = trees.mapInArrow(_codes(spark.sparkContext.broadcast(pickle.dumps(found.books))), f"vec_id bigint, label {label_type}, code string, error bigint")
    return coded, found


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together; null where it passes a long.

    Sums are added up before the shuffle. Labels that hold one ten-thousandth of the rows are few
    and come back as a broadcast, so that no hot label lands in one task; the others join by label.
    """
    scratch = Scratch(coded.sparkSession, "codes")
    coded = scratch.save(coded, "coded")
    sums = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("rows"), F.try_sum("error").alias("label_error")), "sums")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot, rest = split_hot(sums, "rows", total)
    same = F.col("label").eqNullSafe(F.col("of"))
    marked = coded.join(F.broadcast(hot.select("of", F.col("label_error").alias("hot_error"), F.lit(True).alias("hot"))), same, "left").drop("of")
    few = marked.filter(F.col("hot").isNull()).drop("hot", "hot_error").join(rest.select("of", "label_error"), same).drop("of")
    many = marked.filter("hot").drop("hot").withColumnRenamed("hot_error", "label_error")
    return many.unionByName(few)


def brute_force(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[dict, str]:
    """For tests: ({vec_id: (code, error)}, digest) of (vec_id, vector) rows with different ids and equal lengths."""
    import math

    rows = sorted((i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((square(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own: dict[int, list] = {}
            for _, v in rows:
                own.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            new.append([[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])])
        books = new
    out = {}
    for i, v in rows:
        found = [nearest(p, cut(v, p)) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
