"""Columns of a stream of sorted alignments, given out once no later read can reach them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import pileups

#: Positions of one contig in the line of all positions; watermarks count milliseconds, so some four million contigs have a place.
SPAN = 1 << 31
#: Positions whose columns are one row of the state.
BLOCK = 256


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of some reads, added up, as one row for each contig and block: keys and counts, whole numbers, compressed (most counts are 0)."""
    for batch in batches:
        for some in pileups.some_reads(batch) if batch.num_rows else ():
            names, number = some.column("contig").to_pylist(), some.column("contig_no").to_numpy()
            read, where, nth, code, goes_on = pileups.read_columns(some.column("pos").to_numpy(), some.column("cigar"), some.column("seq"))
            contig, of = np.unique(number, return_index=True)
            block = where // BLOCK
            least = block.min(initial=0)
            span = block.max(initial=0) - least + 1
            tile, at = np.unique(np.searchsorted(contig, number)[read] * span + block - least, return_inverse=True)
            rest = BLOCK.bit_length() + pileups.SHIFT
            key, counts = pileups.tallied((at << rest) | ((where - block * BLOCK) << pileups.SHIFT) | nth, code, goes_on)
            ends = np.searchsorted(key, np.arange(len(tile) + 1) << rest).tolist()
            key &= (1 << rest) - 1
            parts = [zlib.compress(np.column_stack([key[a:b], counts[a:b]]).tobytes(), 1) for a, b in zip(ends, ends[1:])]
            own = (tile // span).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(contig[own]), pa.array([names[of[i]] for i in own], pa.string()), pa.array(tile % span + least), pa.array(parts, pa.binary())], ["contig_no", "contig", "block", "part"])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for contig, block, parts in zip(*(batch.column(n).to_pylist() for n in ("contig", "block", "parts")), strict=True):
            all_ = np.frombuffer(b"".join(map(zlib.decompress, parts)), np.int64).reshape(-1, 8)
            yield pileups._told(contig, block * BLOCK, *pileups.added(all_[:, 0], all_[:, 1:]))


def stream_columns(alignments: DataFrame, longest: int) -> DataFrame:
    """A stream of blocks of columns (contig, block, parts) of a stream of alignments sorted by ``contig_no`` and pos.

    Tasks add up the columns of the reads they get; the state has one row for each block of ``BLOCK`` positions.
    The place of a block's end in the line of all contigs' positions is its event time, in milliseconds, and the
    watermark is ``longest``, the most positions that a read spans, and a block behind the furthest one. As
    reads come sorted, all of a block's reads have come by then: it is given out and its state goes,
    so the state is the blocks of one read's length. Blocks are dealt to tasks one by one, not by contig.
    """
    reads = alignments.filter("contig <> '*' and cigar <> '*'").select(F.col("contig_no").cast("long"), "contig", F.col("pos").cast("long"), "cigar", "seq").filter("pos is not null")
    parts = reads.mapInArrow(_parts, "contig_no long, contig string, block long, part binary")
    at = parts.withColumn("at", F.timestamp_millis(F.col("contig_no") * SPAN + F.col("block") * BLOCK + BLOCK - 1))
    return at.withWatermark("at", f"{longest + BLOCK + 2} milliseconds").groupBy("at", "contig", "block").agg(F.collect_list("part").alias("parts"))


def write_columns(columns: DataFrame, path: str, checkpoint: str):
    """Starts the stream: a block's columns leave in one batch, which adds them up, fills the inserted ones' pads and is written by its number.

    A batch that is repeated after a loss replaces what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.select("contig", "block", "parts").mapInArrow(_columns, pileups.SCHEMA).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return columns.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
