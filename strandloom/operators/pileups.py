"""Columns of alignments: (position, n-th inserted base) from CIGARs, with the bases that reads have there.

Reads are dealt to tasks by contig and block of positions, those over a border to both; a task reads CIGARs and
adds up columns as arrays, so no base is a row and none is shuffled. What a task holds are the columns of the
block at hand and some reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import spread

#: Positions of a block, and letters of reads that a task turns into columns at a time.
WIDTH, MOST_LETTERS = 4096, 400_000
COUNTS = ("n_a", "n_c", "n_g", "n_t", "n_pad", "n_other")
SCHEMA = "contig string, pos long, nth int, " + ", ".join(f"{n} long" for n in COUNTS) + ", depth long"
#: Codes of what a read has in a column: ACGT, pad, others, nothing (a read without a sequence); and operations of CIGARs.
PAD, OTHER, NOTHING = 4, 5, 6
CODES = np.full(256, OTHER, np.int64)
for _i, _c in enumerate("ACGT*"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i


def _of(letters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in letters]] = True
    return found


KNOWN, ON_REF, ON_READ, INSERTED, PADS, SEEN = (_of(x) for x in ("MIDNSHP=X", "MDN=X", "MIS=X", "IP", "DP", "M=XDIP"))
#: A column's place in its block: the position's above, the number of the inserted base below.
SHIFT = 31


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last one ends)."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _before(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of what comes before each place from the last place marked ``first`` on."""
    total = np.cumsum(n) - n
    return total - total[np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))]


def read_columns(pos: np.ndarray, cigar: pa.Array, seq: pa.Array, first: np.ndarray | None = None, width: int = 0) -> tuple[np.ndarray, ...]:
    """(number of the read, position, nth, code, whether the read goes on) for each column that reads have something in.

    M, = and X bring bases, D a '*' a position; I brings bases, P '*', in columns nth 1, 2, ... after the
    position before; S, H and N bring nothing. A read that begins with an insertion has it after the position
    before its first. With ``first`` only a read's columns in first..first + width - 1 count.
    """
    text, at = letters_of(cigar)
    bases, begin = letters_of(seq)
    place = np.flatnonzero((text < 48) | (text > 57))
    read = np.searchsorted(at, place, "right") - 1
    digits = place - np.maximum(np.concatenate([[-1], place[:-1]]), at[read] - 1) - 1
    known = KNOWN[text[place]] & (digits > 0)
    place, read, digits = place[known], read[known], digits[known]
    n = np.zeros(len(place), np.int64)
    for d in range(int(digits.max(initial=0))):
        own = digits > d
        n[own] += (text[place[own] - 1 - d].astype(np.int64) - 48) * 10**d
    op = text[place]
    fresh = np.concatenate([[True], np.diff(read) != 0])[: len(read)]
    on_ref = np.where(ON_REF[op], n, 0)
    ref, base = _before(on_ref, fresh) + pos[read], _before(np.where(ON_READ[op], n, 0), fresh)
    inserted = INSERTED[op]
    extra = _before(np.where(inserted, n, 0), fresh | ON_REF[op])
    last = pos + np.bincount(read, on_ref, len(pos)).astype(np.int64) - 1
    low, high = np.zeros(len(n), np.int64), np.where(SEEN[op], n, 0)
    if first is not None:
        own = first[read]
        low = np.where(inserted, 0, np.maximum(own - ref, 0))
        high = np.where(inserted, np.where((ref - 1 >= own) & (ref - 1 < own + width), high, 0), np.minimum(high, own + width - ref))
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), size)
    i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]
    of, inside = read[which], inserted[which]
    at_base = base[which] + i
    have = at_base < np.diff(begin)[of]
    code = np.full(len(i), OTHER, np.int64)
    code[have] = CODES[bases[begin[of[have]] + at_base[have]]]
    if seq.null_count:
        code[seq.is_null().to_numpy(zero_copy_only=False)[of]] = NOTHING
    code[PADS[op[which]]] = PAD
    where = np.where(inside, ref[which] - 1, ref[which] + i)
    return of, where, np.where(inside, extra[which] + i + 1, 0), code, where < last[of]


def added(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums of their counts), by rising key."""
    found, at = np.unique(key, return_inverse=True)
    return found, np.stack([np.bincount(at, counts[:, c], len(found)) for c in range(counts.shape[1])], 1).astype(np.int64)


def tallied(key: np.ndarray, code: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts by code and of reads that go on) of columns, by rising key."""
    found, at = np.unique(key, return_inverse=True)
    counts = np.bincount(at * 7 + code, minlength=len(found) * 7).reshape(-1, 7)
    counts[:, NOTHING] = np.bincount(at, goes_on, len(found))
    return found, counts


def filled(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts by code and the depth of a block's columns: inserted ones get a pad for every read that goes on past them without a base there."""
    nth, own = key & ((1 << SHIFT) - 1), counts[:, :NOTHING].sum(1)
    begin = np.concatenate([[True], np.diff(key >> SHIFT) != 0])[: len(key)]
    at = np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
    passing = np.where(nth[at] == 0, counts[at, NOTHING], 0)
    missing = np.where(nth > 0, np.maximum(passing - own, 0), 0)
    return np.column_stack([counts[:, :PAD], counts[:, PAD] + missing, counts[:, OTHER], own + missing])


def _told(contig: str, first: int, key: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    names = ["contig", "pos", "nth", *COUNTS, "depth"]
    contigs = pa.DictionaryArray.from_arrays(np.zeros(len(key), np.int32), [contig]).dictionary_decode().cast(pa.string())
    return pa.RecordBatch.from_arrays([contigs, pa.array(first + (key >> SHIFT)), pa.array((key & ((1 << SHIFT) - 1)).astype(np.int32)), *(pa.array(c) for c in filled(key, counts).T)], names)


def some_reads(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some letters."""
    size = np.diff(letters_of(batch.column("seq"))[1])
    part = np.cumsum(size) // MOST_LETTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (contig, block) at hand, its keys and counts
        for batch in batches:
            for some in some_reads(batch) if batch.num_rows else ():
                contigs, block, pos = some.column("contig").to_pylist(), some.column("block").to_numpy(), some.column("pos").to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | np.array([a != b for a, b in zip(contigs, contigs[1:])], bool)]))
                tile = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(block))))
                read, where, nth, code, goes_on = read_columns(pos, some.column("cigar"), some.column("seq"), block * width, width)
                rest = width.bit_length() + SHIFT
                key, counts = tallied((tile[read] << rest) | ((where - block[read] * width) << SHIFT) | nth, code, goes_on)
                ends = np.searchsorted(key, np.arange(len(cut) + 1) << rest)
                for t, at in enumerate(cut.tolist()):
                    own = (contigs[at], int(block[at]))
                    part = key[ends[t] : ends[t + 1]] & ((1 << rest) - 1), counts[ends[t] : ends[t + 1]]
                    if held and held[0] == own:
                        part = added(np.concatenate([held[1], part[0]]), np.concatenate([held[2], part[1]]))
                    elif held and len(held[1]):
                        yield _told(held[0][0], held[0][1] * width, held[1], held[2])
                    held = (own, *part)
        if held and len(held[1]):
            yield _told(held[0][0], held[0][1] * width, held[1], held[2])

    return run


def pileup(alignments: DataFrame, width: int = WIDTH) -> DataFrame:
    """contig, pos, nth, n_a, n_c, n_g, n_t, n_pad, n_other, depth of alignments (contig, pos, cigar, seq).

    In an inserted column the reads that go on past it without a base have a pad.
    """
    spans = F.expr("aggregate(transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), x -> cast(x as long)), 0L, (s, x) -> s + x)")
    low, high = F.floor((F.col("pos") - 1) / width), F.floor((F.col("pos") + F.greatest(spans, F.lit(1)) - 1) / width)
    reads = alignments.filter("contig <> '*' and cigar <> '*'").select("contig", F.col("pos").cast("long").alias("pos"), "cigar", "seq").filter("pos is not null")
    dealt = spread(reads.withColumn("block", F.explode(F.sequence(low, high))), "contig", "block").sortWithinPartitions("contig", "block")
    return dealt.mapInArrow(_blocks(width), SCHEMA)


def placed_pileup(places: DataFrame, source: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], width: int = WIDTH) -> DataFrame:
    """The same of reads whose alignments are made in the task that adds up their columns, so that no CIGAR and no sequence is shuffled.

    ``places`` has contig_id and what else ``source`` needs, and the positions low..high that an alignment's columns lie
    between; ``source`` makes batches of contig, block, pos, cigar, seq of batches of these rows and their block.
    """
    needed = [c for c in places.columns if c not in ("low", "high")]
    blocks = F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))
    dealt = spread(places.select(*needed, F.explode(blocks).alias("block")), "contig_id", "block").sortWithinPartitions("contig_id", "block")
    added_up = _blocks(width)
    return dealt.mapInArrow(lambda batches: added_up(source(batches)), SCHEMA)
