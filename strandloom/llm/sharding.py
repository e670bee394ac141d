"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a row number 0..n-1 in the order of (doc_id, text), a keyed permutation of
[0, n) maps it to a position, and ``shard = position % shards``, ``slot = position // shards``.
Shard counts therefore differ by one at most (law ``rows``), slots are gapless, and shard and
slot of any row number can be computed from (n, shards, seed) alone; ``row_number_at`` inverts it.

DataFrame functions only. The permutation is a mixed-radix Feistel network on Z_a x Z_b with
``a * b >= n`` and fewer than ``a`` surplus positions, so cycle walking hardly ever takes a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spare

ROUNDS = 6
WALKS = 64
PRIME = 2147483647
MULTIPLIER_1 = 1103515245
MULTIPLIER_2 = 1812433253


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of [0, n), as a SQL expression and as Python for single positions."""

    n: int
    seed: int = 7

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(self.n - 1, 0)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    def mixed(self, i: str, x: str) -> str:
        """The round function, as SQL that any engine with 64-bit integers can run."""
        one = f"((({x}) * {MULTIPLIER_1} + ({i} + 1) * 7919 + {self.seed % 1000003} * 104729) % {PRIME})"
        return f"((({one} % 46337) * {MULTIPLIER_2} + {one} * 31 + {self.seed % 1000003}) % {PRIME})"

    def step_sql(self, p: str) -> str:
        """One pass of the network over the position ``p``; SQL with a lambda, run row by row inside the JVM."""
        left, right = self.mixed("i", "s.r"), self.mixed("i", "s.l")
        return (
            f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', ({p}) div {self.b}, 'r', ({p}) % {self.b}), "
            f"(s, i) -> if(i % 2 = 0, named_struct('l', (s.l + {left}) % {self.a}, 'r', s.r), "
            f"named_struct('l', s.l, 'r', (s.r + {right}) % {self.b})), s -> s.l * {self.b} + s.r)"
        )

    def column(self, row_number: str) -> Column:
        """The position of a row number: the network once, then again while the result is n or more."""
        walk = f"aggregate(sequence(1, {WALKS}), {self.step_sql(row_number)}, (p, k) -> if(p < {self.n}, p, {self.step_sql('p')}))"
        late = "raise_error('cycle walk too long: choose another seed')"
        return F.expr(f"element_at(transform(array({walk}), w -> if(w < {self.n}, w, {late})), 1)")

    def _round(self, i: int, x: int) -> int:
        one = (x * MULTIPLIER_1 + (i + 1) * 7919 + self.seed % 1000003 * 104729) % PRIME
        return ((one % 46337) * MULTIPLIER_2 + one * 31 + self.seed % 1000003) % PRIME

    def position(self, row_number: int) -> int:
        p = row_number
        while True:
            left, right = divmod(p, self.b)
            for i in range(ROUNDS):
                if i % 2 == 0:
                    left = (left + self._round(i, right)) % self.a
                else:
                    right = (right + self._round(i, left)) % self.b
            p = left * self.b + right
            if p < self.n:
                return p

    def row_number(self, position: int) -> int:
        """The inverse of ``position``."""
        p = position
        while True:
            left, right = divmod(p, self.b)
            for i in reversed(range(ROUNDS)):
                if i % 2 == 0:
                    left = (left - self._round(i, right)) % self.a
                else:
                    right = (right - self._round(i, left)) % self.b
            p = left * self.b + right
            if p < self.n:
                return p


def with_row_numbers(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Adds ``row_number`` 0..n-1 in the order of the given columns, and returns n with it.

    A range partitioning deals the rows out and each partition numbers its own; only one count a
    partition is added up. Rows that are equal in ``order`` are told apart by their place, so a
    key with a third of all rows still spreads over partitions. The dealt rows are written to the
    shared folder, so a later retry sees the same partitions.
    """
    place, within, part = spare(df, "_place", "_within", "_part")
    placed = df.withColumn(place, F.monotonically_increasing_id())
    dealt = (
        placed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col(place))
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], F.col(place))
        .withColumn(within, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(within, 33))
        .withColumn(within, F.col(within).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(place)
    )
    dealt = scratch.save(dealt, "numbered")
    counts = {r["part"]: r["n"] for r in dealt.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for number in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(number, 0)
    # one number a partition, whatever the number of rows
    start = F.element_at(F.expr(f"array({', '.join(f'{s}L' for s in starts) or '0L'})"), (F.col(part) + 1).cast("int"))
    return dealt.withColumn("row_number", start + F.col(within)).drop(part, within), total


def shard_documents(
    documents: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    Law ``rows``: shard counts differ by one at most. ``size`` is the UTF-8 bytes of the text plus
    16; a null text has no bytes and the checksum of the empty text. Null ids sort first; repeated
    rows get numbers of their own; an empty table gives no rows. Other columns, whatever their
    names, are not read. ``grown_shard`` is null, as this law moves rows when a shard is added.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("_text_md5"),
    )
    numbered, n = with_row_numbers(keys, ["doc_id", "_text_md5"], Scratch(spark, "sharding"))
    return (
        numbered.withColumn("_position", Permutation(n, seed).column("row_number"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("_position") % shards).cast("int").alias("shard"),
            F.expr(f"_position div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "row_number",
        )
    )


def write_shards(documents: DataFrame, path: str, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents as one folder a shard, rows in the order of their slots.

    The text goes along with its row through the numbering, so rows with equal ids stay apart.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    documents = documents.drop("shard", "slot", "row_number")
    digest, at = spare(documents, "_text_md5", "_position")
    numbered, n = with_row_numbers(documents.withColumn(digest, F.md5(text)), [id_col, digest], Scratch(spark, "sharding"))
    (
        numbered.withColumn(at, Permutation(n, seed).column("row_number"))
        .withColumn("shard", (F.col(at) % shards).cast("int"))
        .withColumn("slot", F.expr(f"{at} div {shards}"))
        .drop(digest, at, "row_number")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
