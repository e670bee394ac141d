"""Operators with state along one read: adaptive quality clip, low complexity, pairwise alignment.

Each is a small numpy helper over one row, dealt out by ``mapInPandas``; rows are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrays import slices, texts_of


def _rows(function: Callable, columns: list[str], keep: list[str], names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [function(*row) for row in zip(*(frame[c] for c in columns), strict=True)]
            out = frame[keep].copy()
            for i, name in enumerate(names):
                out[name] = [f[i] for f in found]
            yield out

    return run


def clip_by_quality(quals: np.ndarray, width: int = 30, mean: float = 10.0) -> tuple[int, int]:
    """(last clipped base on the left, first clipped base on the right), 1-based, of qualities.

    From the best window the scan goes outward to the first window below the mean. A window shorter
    by one base starts two places inward on the left (one on the right) and does the same, down to
    single bases, so that the clip settles on the base where the quality drops. The first window
    is never the best one. Windows of a short read are no longer than what follows its middle.
    Without a quality over zero nothing is clipped: (0, bases + 1).
    """
    q = np.asarray(quals, float)
    n = len(q)
    if not q.any():
        return 0, n + 1
    sums = np.concatenate([[0.0], np.cumsum(q)])
    start = max(1, int((sums[width:] - sums[:-width]).argmax())) if width < n else n // 2
    left = right = start
    last = left
    for w in range(min(width, n - start), 0, -1):
        low = np.flatnonzero(sums[w : left + w] - sums[:left] < mean * w)
        last = int(low[-1]) if len(low) else min(0, left - 1)
        left = min(last + 2, n - w + 1)
    for w in range(min(width, n - start), 0, -1):
        stop = max(right + 1, n - w)
        low = np.flatnonzero(sums[right + 1 + w : n] - sums[right + 1 : n - w] < mean * w) if right + 1 + w < n else np.zeros(0, int)
        at = right + 1 + int(low[0]) if len(low) else stop
        right = at - 1
    first, second = last + 1, (n + 1 if at == n else at) + 1
    return min(first, second - 1), second


def clips_by_quality(quals: np.ndarray, at: np.ndarray, width: int = 30, mean: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """``clip_by_quality`` of many reads with whole-number qualities; ``at`` has where each read's begin and the last one's end.

    All reads go one window on at a time, those that have met a window below the mean wait for the others.
    """
    total, b, n = np.concatenate([[0], np.cumsum(quals, dtype=np.int64)]), at[:-1], np.diff(at)
    some = np.concatenate([[0], np.cumsum(quals != 0)])
    live = some[at[1:]] > some[b]
    first, second = np.zeros(len(n), np.int64), n + 1
    b, n = b[live], n[live]
    if not len(n):
        return first, second
    # the first best window
    place = np.arange(len(quals))
    read = np.searchsorted(b, place, "right") - 1
    inside = (read >= 0) & (place - b[read] + width <= n[read])
    sums = np.where(inside, total[np.minimum(place + width, len(quals))] - total[place], np.iinfo(np.int64).min)
    best = np.maximum.reduceat(sums, b)
    at_best = np.minimum.reduceat(np.where(inside & (sums == best[read]), place, len(quals)), b) - b
    start = np.where(width < n, np.maximum(at_best, 1), n // 2)
    left, right, stop = start.copy(), start.copy(), start.copy()
    last = left.copy()
    widest = np.minimum(width, n - start)
    for w in range(min(width, int(widest.max())), 0, -1):
        own = np.flatnonzero(w <= widest)
        p = left[own] - 1
        going = np.flatnonzero(p >= 0)
        while len(going):
            q = b[own[going]] + p[going]
            going = going[total[q + w] - total[q] >= mean * w]
            p[going] -= 1
            going = going[p[going] >= 0]
        last[own] = np.where(p >= 0, p, np.minimum(0, left[own] - 1))
        left[own] = np.minimum(last[own] + 2, n[own] - w + 1)
    for w in range(min(width, int(widest.max())), 0, -1):
        own = np.flatnonzero(w <= widest)
        end = n[own] - w
        p = right[own] + 1
        none = np.maximum(p, end)
        going = np.flatnonzero(p < end)
        while len(going):
            q = b[own[going]] + p[going]
            going = going[total[q + w] - total[q] >= mean * w]
            p[going] += 1
            going = going[p[going] < end[going]]
        stop[own] = np.where(p < end, p, none)
        right[own] = stop[own] - 1
    second[live] = np.where(stop == n, n + 1, stop) + 1
    first[live] = np.minimum(last + 1, second[live] - 1)
    return first, second


def quality_clips(reads: DataFrame, width: int = 30, mean: float = 10.0) -> DataFrame:
    """id, left, right of reads (id, quals)."""
    if reads.schema["quals"].dataType.simpleString() not in ("array<tinyint>", "array<smallint>", "array<int>", "array<bigint>"):
        run = _rows(lambda q: clip_by_quality(q, width, mean), ["quals"], ["id"], ["left", "right"])
        return reads.select("id", "quals").mapInPandas(run, "id bigint, left int, right int")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("quals")
            size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            quals = own.flatten().to_numpy(zero_copy_only=False)
            left, right = clips_by_quality(quals, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), width, mean)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["id", "left", "right"])

    return reads.select(F.col("id").cast("bigint").alias("id"), "quals").mapInArrow(whole, "id bigint, left int, right int")


def low_complexity(seq: str, word: int = 3, window: int = 48, level: int = 20) -> str:
    """The sequence with windows of repeated triplets masked by '#' (S43).

    In each half-overlapping window the stretch with the largest score, 10 * (earlier counts of its
    triplets) div (offset of its last base), is masked if that is over ``level``. Triplets with
    characters that are no letters do not count.
    """
    out = list(seq)
    for at in range(0, max(1, len(seq) - word + 1), window // 2):
        part = seq[at : at + window].upper()
        triplets = [part[j : j + word] for j in range(len(part) - word + 1)]
        top, where = 0, (0, 0)
        for i in range(len(triplets)):
            counts: dict[str, int] = {}
            total = 0
            for j in range(i, len(triplets)):
                if not triplets[j].isalpha():
                    continue
                if seen := counts.get(triplets[j], 0):
                    total += seen
                    if (score := 10 * total // (j - i + word - 1)) > top:
                        top, where = score, (i, j + word)
                counts[triplets[j]] = seen + 1
        if top > level:
            out[at + where[0] : at + where[1]] = "#" * (where[1] - where[0])
    return "".join(out)


def _tops(triplets: np.ndarray, word: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, first and last triplet) of the best stretch of each column of triplets; those that don't count are negative, all different.

    A stretch's total are its pairs of equal triplets, so the stretches that end at j are those that end before it and the pairs with j.
    """
    m, n = triplets.shape
    total, best, end = np.zeros((m, n), np.int16), np.zeros((m, n), np.int16), np.zeros((m, n), np.int16)
    for j in range(1, m):
        total[:j] += np.cumsum((triplets[:j] == triplets[j])[::-1], axis=0, dtype=np.int16)[::-1]
        # the nearest a quotient lies to the next whole number is one divided by the window's length: single precision tells them apart
        score = (total[:j] * np.float32(10) / (j - np.arange(j, dtype=np.float32) + word - 1)[:, None]).astype(np.int16)
        better = score > best[:j]
        np.copyto(best[:j], score, where=better)
        np.copyto(end[:j], np.int16(j), where=better)
    first, column = best.argmax(0), np.arange(n)
    return best[first, column], first, end[first, column]


def masked_letters(data: np.ndarray, ends: np.ndarray, word: int = 3, window: int = 48, level: int = 20, most: int = 2048) -> np.ndarray:
    """``low_complexity`` of many texts of ASCII letters, all windows at once, ``most`` at a time; words of three letters."""
    upper = np.where((data >= 97) & (data <= 122), data - 32, data)
    letter = np.append((upper >= 65) & (upper <= 90), np.zeros(window + word, bool))
    code = np.append(np.where(letter[: len(data)], upper - 65, 0), np.zeros(window + word, np.int64))
    size = np.diff(ends)
    count = -(-np.maximum(1, size - word + 1) // (window // 2))
    text = np.repeat(np.arange(len(size)), count)
    begin = ends[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * (window // 2)
    limit, mark, rows = ends[1:][text], np.zeros(len(data) + 1, np.int64), np.arange(window - word + 1)
    for a in range(0, len(begin), most):
        own, end = begin[a : a + most], limit[a : a + most]
        at = own + rows[:, None]
        known = at + word <= end
        triplet = np.zeros(at.shape, np.int64)
        for i in range(word):
            known &= letter[at + i]
            triplet = triplet * 26 + code[at + i]
        top, first, last = _tops(np.where(known, triplet, -1 - rows[:, None]).astype(np.int16), word)
        hit = top > level
        np.add.at(mark, (own + first)[hit], 1)
        np.add.at(mark, (own + last + word)[hit], -1)
    return np.where(np.cumsum(mark)[:-1] > 0, ord("#"), data)


def masked(seqs: DataFrame, word: int = 3, window: int = 48, level: int = 20) -> DataFrame:
    """id, seq with low complexity masked; pads are taken out first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in slices(batch):
                plain = word == 3 and 2 * word <= window <= 128 and data.max(initial=0) < 128
                found = texts_of(masked_letters(data, ends, word, window, level), ends) if plain else [low_complexity(s, word, window, level) for s in rows.column("seq").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found, pa.string())], ["id", "seq"])

    bare = F.replace(F.coalesce("seq", F.lit("")), F.lit("*"), F.lit(""))
    return seqs.select(F.col("id").cast("bigint").alias("id"), bare.alias("seq")).mapInArrow(run, "id bigint, seq string")


def align(a: str, b: str, match: int = 1, mismatch: int = -2, gap_open: int = -4, gap_extend: int = -1, local: bool = False) -> tuple[int, int, int]:
    """(score, end in a, end in b) of the best global or local alignment with affine gaps.

    Row by row with numpy: gaps along the row are a running maximum, as each costs a constant a column.
    """
    n, m = len(a), len(b)
    low = -(1 << 30)
    y = np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    columns = np.arange(m + 1)
    best = np.zeros(m + 1, np.int64)
    if not local:
        best[1:] = gap_open + gap_extend * (columns[1:] - 1)
    down = np.full(m + 1, low, np.int64)
    top, end = (0, (0, 0)) if local else (low, (n, m))
    for i in range(1, n + 1):
        down = np.maximum(best + gap_open, down + gap_extend)
        diagonal = np.empty(m + 1, np.int64)
        diagonal[0] = low
        diagonal[1:] = best[:-1] + np.where(y == ord(a[i - 1]) % 256, match, mismatch)
        row = np.maximum(diagonal, down)
        if local:
            row = np.maximum(row, 0)
        shifted = row - gap_extend * columns  # a gap from column k to c costs open + extend * (c - k - 1)
        along = np.full(m + 1, low, np.int64)
        along[1:] = np.maximum.accumulate(shifted)[:-1] + gap_open + gap_extend * (columns[1:] - 1)
        best = np.maximum(row, along)
        if local and best.max() > top:
            top, end = int(best.max()), (i, int(best.argmax()))
    return (top, *end) if local else (int(best[m]), n, m)


def alignments(pairs: DataFrame, local: bool = False) -> DataFrame:
    """id, score and ends of pairs (id, a, b)."""
    run = _rows(lambda a, b: align(a or "", b or "", local=local), ["a", "b"], ["id"], ["score", "end_a", "end_b"])
    return pairs.select("id", "a", "b").mapInPandas(run, "id bigint, score bigint, end_a int, end_b int")
