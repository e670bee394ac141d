"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words and word pairs in ``buckets`` buckets): one of
target text (rows labelled good), one of the raw text (all rows). A document's log importance
weight is the sum of log p_target - log p_raw over its n-grams; Gumbel noise added to it and a
top-k choice is sampling without replacement in proportion to the weights.

The raw model counts every document; the target model takes at most ``target_rows`` labelled
rows, smallest by a hash of the id. Counts are added up in the tasks, so one number a bucket and
task is shuffled. The k-th largest key is found by global row numbers over (key, id) alone.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spare, text_key, with_fields
from .sharding import with_row_numbers

WORD = re.compile(r"\w+|[^\w\s]+")
CACHE = 300_000


class Hasher:
    """Buckets of the words and the word pairs of a text."""

    def __init__(self, buckets: int):
        self.buckets, self.cache = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, cache = WORD.findall((text or "").lower()), self.cache
        if len(cache) > CACHE:
            cache.clear()
        found = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w) >> 1
            found.append(h)
        one = np.array(found, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        both = np.concatenate([one, two ^ (two >> np.uint64(29))])
        return (both % np.uint64(self.buckets)).astype(np.int64)


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, held, size = Hasher(buckets), np.zeros((2, buckets), np.int64), ([], []), 0

        def count():
            for i in range(2):
                if held[i]:
                    counts[i] += np.bincount(np.concatenate(held[i]), minlength=buckets)

        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("good"), strict=True):
                own = hasher(text.as_py())
                held[0].append(own)
                size += len(own)
                if good.as_py():
                    held[1].append(own)
                if size > 1 << 20:
                    count()
                    held, size = ([], []), 0
        count()
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "target"])

    return run


def fit(documents: DataFrame, good: DataFrame, buckets: int = 10_000, target_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw of each bucket. ``good`` has the ids of target rows; none at all give zeros."""
    sample = (
        good.select(F.col(id_col).alias("_id")).filter("_id is not null").dropDuplicates()
        .withColumn("good", F.lit(True)).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(target_rows)
    )
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id", "left")
    counts = texts.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counted(buckets), "bucket bigint, raw bigint, target bigint")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # buckets rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(buckets)
    prior = raw / raw.sum()  # the target model falls back on the raw one where it has seen little
    strength = 0.1 * buckets
    return np.log((target + strength * prior + 1e-9) / (target.sum() + strength)) - np.log((raw + 1e-9) / raw.sum())


def _weighed(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = pickle.loads(shared.value)
        hasher = Hasher(len(ratio))
        for batch in batches:
            weights, sizes = [], []
            for text in batch.column(text_col):
                own = hasher(text.as_py())
                weights.append(float(ratio[own].sum()))
                sizes.append(len(own))
            names = [c for c in batch.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], [*names, "log_weight", "n_grams"])

    return run


def with_weights(documents: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` plus log_weight and n_grams; a text without n-grams (or null) weighs 0."""
    documents = documents.drop("log_weight", "n_grams")
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(ratio))
    (text,) = spare(documents, "_text")
    return documents.withColumn(text, F.col(text_col)).mapInArrow(_weighed(shared, text), with_fields(documents, "log_weight double, n_grams bigint"))


def gumbel(seed: int, *columns: Column) -> Column:
    """Gumbel noise from a hash: the same for the same row in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def resample(
    documents: DataFrame,
    good: DataFrame,
    share: float = 0.85,
    seed: int = 11,
    buckets: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: its id, log_weight, n_grams, gumbel_key, place (from 0) and keep.

    ``keep`` marks the ceil(share * n) largest keys. Equal keys go by id and text, repeated rows
    have equal keys and places of their own; an empty table gives no rows.
    """
    if not 0 <= share <= 1:
        raise ValueError("share is 0 to 1")
    scratch = Scratch(documents.sparkSession, "resampling")
    ratio = fit(documents, good, buckets, id_col=id_col, text_col=text_col)
    rows = documents.select(F.col(id_col).alias("id"), F.unhex(text_key(id_col, text_col)).alias("row_key"), F.col(text_col).alias("text"))
    weighed = scratch.save(with_weights(rows, ratio).drop("text"), "weighed")  # weighed once, not again for the bounds of the sort
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, F.col("row_key"))).withColumn("_down", -F.col("gumbel_key"))
    placed, n = with_row_numbers(keyed, ["_down", "id", "row_key"], scratch)
    k = -(-int(share * n * 1_000_000) // 1_000_000)
    return placed.select(F.col("id").alias(id_col), "log_weight", "n_grams", "gumbel_key", F.col("row_number").alias("place"), (F.col("row_number") < k).alias("keep"))
