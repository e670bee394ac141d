"""Substring dedup by a hash-compared suffix sort.

A byte goes if it is covered by a 200-byte string that also starts anywhere else. Sorting the
suffixes of a whole corpus needs all of it in one place, so the sort is cut up by content:

1. Prefix polynomial hashes give the hash of any substring in constant time. The smallest hashed
   64-byte string in each 200-byte window is its anchor; equal windows have equal anchors at equal
   offsets. Consecutive windows with one anchor make a segment (about 70 windows).
2. Two Bloom filters (once-seen, twice-seen; bounded in size) drop segments whose anchor occurs
   once. The rest are counted by anchor and by the digest of the whole segment: segments that
   occur twice or more are duplicates as a whole.
3. Where different segments share an anchor, one of each kind is fetched with its bytes, and the
   suffixes at its window starts are sorted: a merge sort whose comparisons find the common
   extension of two suffixes by binary search over the prefix hashes. Neighbours with a common
   extension of 200 bytes are verified byte by byte. Only suffixes with the same anchor and offset
   are compared. A group of over ``most_kinds`` kinds of segments is not brought into one task: its
   windows are cut into halved blocks of offsets, and each half is grouped by the bytes that all
   its windows share, until the groups are small enough to be sorted.
4. The covered bytes of a document are the union of its repeated windows.

Runs of a short period (one letter, a repeated word) hold few different windows: the first period
stands for all, and the run is covered as a whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import filter_bits, probes, test_bits, twice_filter
from .common import Scratch, slices, spare, split_hot, string_bytes, text_key, with_fields

BASE = 0x9E3779B97F4A7C15 | 1
WIDTH, GRAM = 200, 64
SLICE_BYTES = 1 << 20
#: Texts over this many bytes are cut into overlapping stretches for the hashing.
STRETCH_BYTES = 1 << 22


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """n + 1 sums; (sums[j] - sums[i]) * base**-i is the hash of raw[i:j]."""
    up, _ = POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments_of(raw: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, int]]]:
    """(text number, first window start, windows, anchor place, anchor hash) of each segment, and the runs (text number, start, end) of a short period.

    ``bounds`` are the n + 1 bounds of the texts in ``raw``; windows do not cross them. All windows
    of a run repeat; those that equal one of its first period are in no segment.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)), []
    n = len(raw) - width + 1
    if n <= 0:
        return none
    sums = prefix_hashes(raw)
    _, down = POWERS.upto(len(raw) + 1)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    span = width - gram + 1
    low = np.uint64((1 << 24) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(keyed) // span)
    grid = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(keyed)] = keyed
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = np.arange(n) + width <= bounds[1:][text]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    starts, sizes = starts[valid[starts]], sizes[valid[starts]]
    at, runs, keep = anchor[starts], [], np.ones(len(starts), bool)
    step, of_text = np.diff(at), text[starts]
    steady = (grams[at[1:]] == grams[at[:-1]]) & (of_text[1:] == of_text[:-1]) & (step > 0) & (step <= gram)
    if steady.any():  # the same gram again and again: a short period
        ends = starts + sizes - 1
        for period, first, last in zip(*(x.tolist() for x in _runs(steady, step, np.arange(len(step)))), strict=True):
            low, high = int(at[first]), int(at[last + 1]) + gram
            if high - low - width + 1 >= 2 * period and (raw[low + period : high] == raw[low : high - period]).all():
                runs.append((int(of_text[first]), low, high))
                keep[np.searchsorted(starts, low + period) : np.searchsorted(ends, high - width, side="right")] = False
    return tuple(x[keep] for x in (of_text, starts, sizes, at, grams[at])), runs


def _segment_rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (raw, at) = batch.column("key"), string_bytes(batch.column("text"))
            for a, b in slices(at, SLICE_BYTES):
                if at[b] - at[a] <= STRETCH_BYTES:
                    parts = [(a, b, int(at[a]), int(at[b]))]
                else:  # one long text: windows of each stretch, cut where the next begins
                    parts = [(a, b, x, min(x + STRETCH_BYTES + width - 1, int(at[b]))) for x in range(int(at[a]), int(at[b]), STRETCH_BYTES)]
                for first, last, x, y in parts:
                    own = raw[x:y]
                    bounds = np.clip(at[first : last + 1], x, y) - x
                    (text, start, size, anchor, hashes), runs = segments_of(own, bounds, width, gram)
                    if runs:  # rows with n = -1 and the run's length in rel
                        who, low, high = (np.array(v) for v in zip(*runs, strict=True))
                        zero = pa.array(np.zeros(len(runs), np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(who + first)), pa.array(low + x - at[who + first]), pa.array(np.full(len(runs), -1, np.int32)), pa.array((high - low).astype(np.int32)), zero, zero, zero],
                            ["key", "at", "n", "rel", "anchor", "kind1", "kind2"],
                        )
                    if not len(start):
                        continue
                    data, rel = own.tobytes(), anchor - start
                    digest = xxhash.xxh3_128_digest
                    kinds = b"".join([digest(data[s : s + n + width - 1], r) for s, n, r in zip(start.tolist(), size.tolist(), rel.tolist(), strict=True)])
                    kinds = np.frombuffer(kinds, np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(text + first)),
                            pa.array(start + x - at[text + first]),
                            pa.array(size.astype(np.int32)),
                            pa.array(rel.astype(np.int32)),
                            pa.array(hashes.view(np.int64)),
                            pa.array(kinds[:, 0].copy()),
                            pa.array(kinds[:, 1].copy()),
                        ],
                        ["key", "at", "n", "rel", "anchor", "kind1", "kind2"],
                    )

    return run


SEGMENT = "key binary, at bigint, n int, rel int, anchor bigint, kind1 bigint, kind2 bigint"


def _anchor_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _suspected(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        twice = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            hit = test_bits(twice, probes(batch.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64), bits))
            if hit.any():
                yield batch.filter(pa.array(hit))

    return run


def _with_bytes(width: int):
    """Segments of a joined document (``list``) with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "at", "n", "rel", "anchor", "kind1", "kind2", "copies", "kinds"]
        for batch in batches:
            raw, at = string_bytes(batch.column("text"))
            lists = batch.column("list")
            flat = lists.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            columns = {n: flat.field(i) for i, n in enumerate(f.name for f in flat.type)}
            starts = columns["at"].to_numpy() + at[row]
            ends = starts + columns["n"].to_numpy() + width - 1
            data = raw.tobytes() if len(raw) < 1 << 26 else memoryview(raw)
            for a in range(0, len(row), 50_000):
                b = min(len(row), a + 50_000)
                pieces = pa.array([bytes(data[x:y]) for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], pa.binary())
                keys = batch.column("key").take(pa.array(row[a:b]))
                yield pa.RecordBatch.from_arrays([keys, *(columns[n].slice(a, b - a) for n in names[1:]), pieces], [*names, "bytes"])

    return run


WITH_BYTES = SEGMENT + ", copies bigint, kinds bigint, bytes binary"


class Suffixes:
    """Suffixes of a buffer, compared by their first ``width`` bytes through prefix hashes."""

    def __init__(self, raw: np.ndarray, width: int):
        self.raw, self.width = raw, width
        self.sums = prefix_hashes(raw)
        self.down = POWERS.upto(len(raw) + 1)[1]

    def same(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common extension, ``width`` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width, np.int64)
        for _ in range(self.width.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.same(a, b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; ``equal`` is the answer where they have no difference."""
        out, rest = equal.copy(), np.flatnonzero(~self.same(a, b, self.width))
        n = self.extension(a[rest], b[rest])
        out[rest] = self.raw[a[rest] + n] < self.raw[b[rest] + n]
        return out

    def sorted(self, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge sort inside each group; (order, group) of the result. Runs double; ranks in the other run are found by bisection."""
        order = np.argsort(group, kind="stable")
        group = group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, len(group)))
        start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        run = 1
        while len(sizes) and run < sizes.max():
            at = np.flatnonzero(size > run)
            p, s, n = places[order], start[at], size[at]
            rank = at - s
            mine = rank // run
            other = np.minimum((mine ^ 1) * run, n)
            low, high = s + other, s + np.minimum(other + run, n)
            base = low.copy()
            own, right = p[at], (mine & 1).astype(bool)  # the left run's element comes first among equals
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                ahead = self.before(p[middle], own[open_], right[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            target = s + (mine & ~1) * run + (rank - mine * run) + (low - base)
            following = order.copy()
            following[target] = order[at]
            order = following
            run *= 2
        return order, group

    def repeated(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether another suffix of the group has the same ``width`` bytes: neighbours in the order, verified by bytes."""
        order, sorted_group = self.sorted(places, group)
        p = places[order]
        same = (sorted_group[1:] == sorted_group[:-1]) & self.same(p[1:], p[:-1], self.width)
        at = np.flatnonzero(same)
        for a in range(0, len(at), 20_000):
            own = at[a : a + 20_000, None]
            offsets = np.arange(self.width)
            if not (self.raw[p[own + 1] + offsets] == self.raw[p[own] + offsets]).all():
                return self.counted(places, group)  # hashes collided
        flags = np.zeros(len(places), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        return flags

    def counted(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        data = self.raw.tobytes()
        keys = [(g, data[p : p + self.width]) for p, g in zip(places.tolist(), group.tolist(), strict=True)]
        counts = Counter(keys)
        return np.array([counts[k] > 1 for k in keys], bool)


def _runs(flags: np.ndarray, segment: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, last window) of the runs of flagged windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    s, w = segment[at], window[at]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)])
    last = np.append(first[1:], True)
    return s[first], w[first], w[last]


def _group_starts(rows: pa.Table) -> np.ndarray:
    """Whether a row begins a new group (g1, g2)."""
    groups = np.stack([rows.column(c).to_numpy() for c in ("g1", "g2")])
    return np.concatenate([[True], (groups[:, 1:] != groups[:, :-1]).any(axis=0)])


def _sorted_repeats(width: int, most_bytes: int = 1 << 21):
    """Over rows sorted by group and kind: (key, low, high) of repeated bytes in segments that have no whole copy."""

    def repeats(rows: pa.Table) -> pa.RecordBatch | None:
        kinds = np.stack([rows.column(c).to_numpy() for c in ("g1", "g2", "kind1", "kind2")])
        keep = np.ones(rows.num_rows, bool)  # repeated rows of documents hand in a segment more than once
        keep[1:] = (kinds[:, 1:] != kinds[:, :-1]).any(axis=0)
        rows = rows.filter(pa.array(keep))
        n, rel, at, copies = (rows.column(c).to_numpy() for c in ("n", "rel", "at", "copies"))
        raw, bounds = string_bytes(rows.column("bytes"))
        raw, bounds = raw[bounds[0] : bounds[-1]], bounds - bounds[0]
        segment = np.repeat(np.arange(len(n)), n)
        window = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        number = np.cumsum(_group_starts(rows).astype(np.int64))
        group = number[segment] * width + (rel[segment] - window)
        flags = Suffixes(raw, width).repeated(bounds[segment] + window, group)
        flags &= copies[segment] == 1  # the others are repeated as a whole
        s, low, high = _runs(flags, segment, window)
        if not len(s):
            return None
        return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks().take(pa.array(s)), pa.array(at[s] + low), pa.array(at[s] + high + width)], ["key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                held.append(part)
                size += int(np.diff(string_bytes(part.column("bytes"))[1]).sum())
                if size < most_bytes:
                    continue
                table = pa.Table.from_batches(held)
                whole = int(np.flatnonzero(_group_starts(table))[-1])
                if whole:
                    if (found := repeats(table.slice(0, whole))) is not None:
                        yield found
                    rest = table.slice(whole).combine_chunks()
                    held = rest.to_batches()
                    size = int(np.diff(string_bytes(rest.column("bytes"))[1]).sum())
        if held and (found := repeats(pa.Table.from_batches(held))) is not None:
            yield found

    return run


NODE = "settled boolean, key binary, at bigint, n int, rel int, bytes binary, first int, hull1 bigint, hull2 bigint, core1 bigint, core2 bigint"


def _nodes(width: int, block: int, halved: bool):
    """Cuts segments (or the nodes of the level above) into blocks of ``block`` anchor offsets.

    A node gets two digests: of its hull, all bytes under its windows, and of its core, the bytes
    that every window of the block covers. Equal hulls repeat as a whole; nodes whose cores differ
    share no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                part = batch.slice(a, 5000)
                n, rel = (part.column(c).to_numpy().tolist() for c in ("n", "rel"))
                above = part.column("first").to_pylist() if halved else [None] * part.num_rows
                row, first, digests = [], [], []
                for i, (data, size, r, f) in enumerate(zip(part.column("bytes").to_pylist(), n, rel, above, strict=True)):
                    low = r - size + 1  # the windows have offsets low..r to the anchor; the one at offset o begins at r - o
                    for o in (f, f + block) if halved else range(low // block * block, r + 1, block):
                        x, y = max(low, o), min(r, o + block - 1)
                        if x > y:
                            continue
                        row.append(i)
                        first.append(o)
                        digests.append(digest(data[r - y : r - x + width], (o << 32) + (x << 16) + y))
                        digests.append(digest(data[r - o : r - (o + block - 1) + width], (o << 32) + block))
                if not row:
                    continue
                four = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
                taken = part.take(pa.array(row))
                settled = taken.column("settled") if halved else pa.array(taken.column("copies").to_numpy() > 1)
                yield pa.RecordBatch.from_arrays(
                    [settled, *(taken.column(c) for c in ("key", "at", "n", "rel", "bytes")), pa.array(first, pa.int32()), *(pa.array(four[:, c].copy()) for c in range(4))],
                    ["settled", "key", "at", "n", "rel", "bytes", "first", "hull1", "hull2", "core1", "core2"],
                )

    return run


def _clipped(width: int, block: int):
    """Nodes as segments of their own: the windows of a block, grouped by its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, rel, first = (batch.column(c).to_numpy() for c in ("at", "n", "rel", "first"))
            low, high = np.maximum(rel - n + 1, first), np.minimum(rel, first + block - 1)  # offsets; the largest is the first window
            cuts = zip(batch.column("bytes").to_pylist(), (rel - high).tolist(), (rel - low + width).tolist(), strict=True)
            copies = np.where(batch.column("settled").to_numpy(zero_copy_only=False), 2, batch.column("times").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("core1", "core2", "hull1", "hull2", "key")), pa.array(at + rel - high), pa.array((high - low + 1).astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(copies.astype(np.int64)), pa.array([d[x:y] for d, x, y in cuts], pa.binary())],
                ["g1", "g2", "kind1", "kind2", "key", "at", "n", "rel", "copies", "bytes"],
            )

    return run


SORTED = "g1 bigint, g2 bigint, kind1 bigint, kind2 bigint, key binary, at bigint, n int, rel int, copies bigint, bytes binary"


def _join_counted(left: DataFrame, counts: DataFrame, count_col: str, keys: list[str], total: int) -> DataFrame:
    """An inner join with keys whose numbers of rows in ``left`` (``total`` rows) are known: the few that can be large by broadcast."""
    hot, rest = split_hot(counts, count_col, total)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(rest, keys))


def halved(segments: DataFrame, scratch: Scratch, width: int, gram: int, most_kinds: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, rows to sort) of groups with very many kinds of segments, without bringing a group together.

    Hulls are counted (partial sums before the shuffle): those that occur twice repeat as a whole.
    Where one core has several hulls, one node of each goes to the sort, or, where there are over
    ``most_kinds``, is halved and grouped again.
    """
    block = 1 << max(0, min((width - gram + 1).bit_length() - 1, (width // 2).bit_length() - 1))
    spans, rows, split, level = [], [], False, segments
    hull, core = ["hull1", "hull2", "core1", "core2"], ["core1", "core2"]
    while block:
        nodes = scratch.save(level.mapInArrow(_nodes(width, block, split), NODE), f"nodes{block}")
        one = F.min(F.struct("settled", "key", "at", "n", "rel", "bytes", "first")).alias("one")
        hulls = scratch.save(nodes.groupBy(*hull).agg(F.count("*").alias("times"), one), f"hulls{block}")
        often = hulls.filter("times > 1").select(*hull, "times")
        offset = F.least(F.col("rel"), F.col("first") + block - 1)  # the largest offset is the first window
        begin = F.col("at") + F.col("rel") - offset
        end = F.col("at") + F.col("rel") - F.greatest(F.col("rel") - F.col("n") + 1, F.col("first")) + width
        spans.append(_join_counted(nodes.filter("not settled"), often, "times", hull, nodes.count()).select("key", begin.alias("low"), end.alias("high")))
        cores = scratch.save(hulls.groupBy(*core).agg(F.count("*").alias("hulls")).filter("hulls > 1"), f"cores{block}")
        level = _join_counted(hulls, cores, "hulls", core, hulls.count()).select(*hull, "times", "hulls", "one.*")
        rows.append(level.filter(F.col("hulls") <= most_kinds).mapInArrow(_clipped(width, block), SORTED))
        if (cores.agg(F.max("hulls")).first()[0] or 0) <= most_kinds:
            break
        level = level.filter(F.col("hulls") > most_kinds).withColumn("settled", F.col("settled") | (F.col("times") > 1)).drop("times", "hulls", *hull)
        block, split = block // 2, True
    return spans, rows


def repeated_spans(documents: DataFrame, scratch: Scratch, width: int, gram: int, most_kinds: int, bits_each: int, max_filter_bits: int) -> DataFrame:
    """(key, low, high): bytes low..high-1 of the documents with that key are covered by repeated windows."""
    spark = documents.sparkSession
    found = scratch.save(documents.mapInArrow(_segment_rows(width, gram), SEGMENT), "segments")
    runs = scratch.save(found.filter("n < 0").select("key", F.col("at").alias("low"), (F.col("at") + F.col("rel")).alias("high")), "runs")
    rows = found.filter("n > 0")
    bits = filter_bits(rows.count(), bits_each, max_filter_bits)
    shared = spark.sparkContext.broadcast(twice_filter(rows.select("anchor"), _anchor_hashes, bits))
    suspects = scratch.save(rows.mapInArrow(_suspected(shared, bits), SEGMENT), "suspects")
    scratch.drop("segments")
    kind = ["anchor", "kind1", "kind2"]
    kinds = scratch.save(suspects.groupBy(*kind).agg(F.count("*").alias("copies"), F.min(F.struct("key", "at", "n", "rel")).alias("one")), "kinds")
    whole = _join_counted(suspects, kinds.filter("copies > 1").select(*kind, "copies"), "copies", kind, suspects.count())
    whole = whole.select("key", F.col("at").alias("low"), (F.col("at") + F.col("n") + width - 1).alias("high"))
    shared_anchors = scratch.save(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "anchors")
    mixed_kinds = _join_counted(kinds, shared_anchors, "kinds", ["anchor"], kinds.count()).select(F.col("one.key").alias("key"), F.struct("one.at", "one.n", "one.rel", *kind, "copies", "kinds").alias("item"))
    lists = mixed_kinds.groupBy("key").agg(F.collect_list("item").alias("list"))  # segments of one document
    fetched = scratch.save(documents.join(lists, "key").mapInArrow(_with_bytes(width), WITH_BYTES), "fetched")
    small = fetched.filter(F.col("kinds") <= most_kinds)
    spans, to_sort = [], [small.select(F.col("anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), "kind1", "kind2", "key", "at", "n", "rel", "copies", "bytes")]
    large = fetched.filter(F.col("kinds") > most_kinds)
    if not large.isEmpty():
        spans, more = halved(large.dropDuplicates(kind), scratch, width, gram, most_kinds)
        to_sort += more
    by_sort = reduce(DataFrame.unionByName, to_sort).repartition("g1", "g2").sortWithinPartitions("g1", "g2", "kind1", "kind2").mapInArrow(_sorted_repeats(width), "key binary, low bigint, high bigint")
    return reduce(DataFrame.unionByName, [runs, whole, by_sort, *spans])


def _cut(text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, kept, size = [], [], [], [], 0
            done = 0
            for row in range(batch.num_rows):
                text = batch.column(text_col)[row].as_py() or ""
                data = text.encode()
                own = []
                for span in sorted((s["low"], s["high"]) for s in batch.column(spans_col)[row].as_py() or ()):
                    if own and span[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], span[1])
                    else:
                        own.append([*span])
                parts, last = [], 0
                for a, b in own:
                    parts.append(data[last:a])
                    last = b
                parts.append(data[last:])
                n_bytes.append(len(data))
                removed.append(sum(b - a for a, b in own))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(parts))
                size += len(data)
                if size > 1 << 25 or row + 1 == batch.num_rows:
                    part = batch.slice(done, row + 1 - done)
                    names = [c for c in part.schema.names if c not in (text_col, spans_col)]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in names), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                        [*names, "n_bytes", "n_removed", "spans", "kept"],
                    )
                    n_bytes, removed, spans, kept, size, done = [], [], [], [], 0, row + 1

    return run


def remove_repeats(
    documents: DataFrame,
    width: int = WIDTH,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_kinds: int = 512,
    bits_each: int = 12,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """All columns of ``documents`` plus n_bytes, n_removed, spans array<struct<start, end>> and kept binary.

    Offsets and lengths count UTF-8 bytes of the text, so ``kept`` may cut a character; a null
    text is empty. Windows do not cross documents. Rows with equal ids and texts are documents of
    their own, so all their windows repeat. Columns of the input with the names of results are
    replaced; an empty table gives no rows.
    """
    if not 2 <= gram <= width:
        raise ValueError("gram is 2 to width")
    scratch = Scratch(documents.sparkSession, "suffixes")
    documents = documents.drop("n_bytes", "n_removed", "spans", "kept")
    key = F.unhex(text_key(id_col, text_col))
    long_enough = documents.filter(F.octet_length(text_col) >= width).select(key.alias("key"), F.col(text_col).alias("text"))
    spans = repeated_spans(long_enough, scratch, width, gram, most_kinds, bits_each, max_filter_bits)
    text_, spans_, key_ = spare(documents, "_text", "_spans", "_key")
    lists = spans.dropDuplicates().groupBy(F.col("key").alias(key_)).agg(F.collect_list(F.struct("low", "high")).alias(spans_))  # of one document
    joined = documents.withColumn(text_, F.col(text_col)).withColumn(key_, key).join(lists, key_, "left").drop(key_)
    return joined.mapInArrow(_cut(text_, spans_), with_fields(documents, "n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"))


def digests(cut: DataFrame) -> DataFrame:
    """The rows of op10: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], width: int = WIDTH) -> list[tuple]:
    """For tests: the rows of op10 by counting all windows."""
    texts = [(text or "").encode() for _, text in rows]
    counts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
