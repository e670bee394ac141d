"""Two Bloom filters, of what was seen once and of what was seen twice, built by all tasks and folded by block."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PROBES = 3


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each hash, by double hashing."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(PROBES)])


def test_bits(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def set_bits(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (at >> np.uint64(3)).astype(np.int64).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def fold_batch(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """Adds hashes of (document, line) pairs: what the batch holds twice or ``once`` has already goes to ``twice``."""
    unique, counts = np.unique(hashes, return_counts=True)
    at = probes(unique, bits)
    again = test_bits(once, at) | (counts > 1)
    set_bits(twice, at[:, again])
    set_bits(once, at)


def _filter_pieces(hashes_in: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for hashes in hashes_in(batch):
                if len(hashes):
                    fold_batch(once, twice, hashes, bits)
        for block in range(bits // 8 // block_bytes):
            a, b = (x[block * block_bytes : (block + 1) * block_bytes] for x in (once, twice))
            if a.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(b.tobytes(), 1)]})

    return run


def _folded(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(batch.column(i) for i in range(3)), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (once, twice))
                if (had := held.get(block.as_py())) is None:
                    held[block.as_py()] = (a.copy(), b.copy())
                else:
                    had[1][:] |= b | (had[0] & a)
                    had[0][:] |= a
        for block, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})

    return run


def twice_filter(rows: DataFrame, hashes_in: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """The compressed twice-seen filter over the hashes of all rows; ``bits`` bounds what the driver gets."""
    block_bytes = min(bits // 8, 1 << 15)
    pieces = rows.mapInArrow(_filter_pieces(hashes_in, bits, block_bytes), "block int, once binary, twice binary")
    merged = pieces.repartition("block").mapInArrow(_folded(block_bytes), "block int, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        whole[row["block"] * block_bytes : (row["block"] + 1) * block_bytes] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


def filter_bits(n: int, bits_each: int, most: int) -> int:
    return min(most, 1 << max(16, int(max(1, n) * bits_each - 1).bit_length()))
