"""Helpers that the operators share: shared-folder tables, column handling and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one temporary folder a session, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_strandloom_dir", None)
    if own is None:
        own = spark.sparkContext._strandloom_dir = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return own


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive the loss of executors.

    ``drop`` removes a table that nothing reads any more. Tables behind a returned DataFrame stay
    until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` and after it the fields of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def split_hot(counts: DataFrame, count_col: str, total: int, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(hot, rest) of keys with counts that sum to ``total`` at most: no more than ``most`` keys can be hot.

    A key is hot with ``total / most`` rows or more, so hot keys have a proven bound for a broadcast
    and no other key brings more than that share of all rows into one task.
    """
    least = max(2, -(-total // most))
    return counts.filter(F.col(count_col) >= least), counts.filter(F.col(count_col) < least)


def text_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text; equal rows share it, nulls differ from empty texts."""
    return F.md5(
        F.concat_ws(
            "|",
            F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
            F.when(F.col(text_col).isNull(), "n").otherwise("t"),
            F.coalesce(F.col(text_col), F.lit("")),
        )
    )


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n + 1 offsets, without copies; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last
