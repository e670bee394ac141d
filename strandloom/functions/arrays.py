"""Letters of many texts as one array, for work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters that are worked on at a time.
SLICE_LETTERS = 1 << 20


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text begins and the last one ends)."""
    ends = np.concatenate([[0], np.cumsum([len(s) for s in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), ends


def slices(batch: pa.RecordBatch, column: str = "seq") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, letters, ends) of some rows at a time; a long text comes alone."""
    texts = batch.column(column).to_pylist()
    part = np.cumsum([len(s) for s in texts], dtype=np.int64) // SLICE_LETTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (batch.slice(a, b - a), *letters(texts[a:b]))


def texts_of(codes: np.ndarray, ends: np.ndarray) -> list[str]:
    whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def text_numbers(ends: np.ndarray) -> np.ndarray:
    """The number of the text of each letter."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)
