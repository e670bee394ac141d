"""SimHash near-dedup by a segment-popcount embedding.

1. Each text gets a 64-bit fingerprint of its word shingles.
2. Distinct fingerprints map to the bit counts of their 32 two-bit segments. The Manhattan
   distance of two such vectors is a lower bound of the Hamming distance. The segments are dealt
   into B blocks; vectors within distance 4 agree in at least B - 4 blocks, so they share a cell
   in one of the C(B, 4) grids whose cells are the counts of B - 4 blocks. B is chosen by the
   number of fingerprints so that cells stay small: every B finds all pairs.
3. Inside a cell, the Manhattan bound and then the exact Hamming distance decide. A cell hands on
   a spanning forest of its links, not all pairs. Cells over ``cell_rows`` fingerprints are dealt
   into chunks and compared chunk by chunk in tasks of their own.
4. Components of the links by alternating large-star and small-star steps, in tables.

``keep_one_copy`` links by the share of equal five-word shingles instead. Texts that share 0.8 of
them lie about 10 of 64 bits apart and some 18, for which no grid has small cells; so candidates
come from bands of minimal shingle hashes, and an exact comparison of the shingle sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, spare, string_bytes, text_key, with_fields

SEGMENTS, SEGMENT_BITS = 32, 2
#: The chance that two random two-bit counts agree.
AGREE = 0.375
SLICE_BYTES = 1 << 22
#: Keys of a shingle set and the minimal hashes in each.
BANDS, BAND_ROWS = 24, 4
#: The sets and shingles of a chunk of a cell.
CHUNK_SETS, CHUNK_SHINGLES = 2048, 1 << 19


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hash of each run of ``shingle`` words, of all words where they are fewer; none for a text without words."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < shingle:
        cuts = [(0, len(joined))]
    else:
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
        cuts = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in cuts), np.uint64, max(1, len(words) - shingle + 1))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; a text without words gives 0."""
    return print_of(shingle_hashes(text, shingle))


def print_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = string_bytes(batch.column(text_col))
            for a, b in slices(at, SLICE_BYTES):
                data, own = raw[at[a] : at[b]].tobytes(), (at[a : b + 1] - at[a]).tolist()
                prints = np.array([fingerprint(data[x:y], shingle) for x, y in zip(own, own[1:])], np.uint64).view(np.int64)
                rest = batch.slice(a, b - a)
                names = [c for c in rest.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names), pa.array(prints)], [*names, "fp"])

    return run


def with_fingerprints(documents: DataFrame, shingle: int = 4, text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` plus ``fp`` long, the fingerprint's bits; null and empty texts get 0."""
    documents = documents.drop("fp")
    (text,) = spare(documents, "_text")
    return documents.withColumn(text, F.col(text_col)).mapInArrow(_fingerprints(shingle, text), with_fields(documents, "fp bigint"))


def counts_of(prints: np.ndarray) -> np.ndarray:
    """The bit count of each segment, packed like the fingerprint (0, 1 or 2 in two bits)."""
    odd = np.uint64(0x5555555555555555)
    return (prints & odd) + ((prints >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of differences of packed counts: |0-2| is 2 (binary 10), |0-1| and |1-2| are 1."""
    odd = np.uint64(0x5555555555555555)
    x = a ^ b  # per segment: 00 equal, 01 (0,1), 10 (0,2), 11 (1,2)
    low, high = x & odd, (x >> np.uint64(1)) & odd
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low)


def block_count(n: int, distance: int) -> int:
    """The B with the least work: C(B, distance) rows a fingerprint, and the pairs that random cells hold."""

    def work(b: int) -> float:
        grids = math.comb(b, distance)
        return grids * n * 1.0 + grids * n * n / 2 * AGREE ** (SEGMENTS * (b - distance) / b) * 0.5

    return min(range(distance + 2, distance + 9), key=work)


def masks_of(blocks: int, distance: int) -> list[int]:
    """For each grid, the bits of the segments whose counts make a cell."""
    of_block = [0] * blocks
    for s in range(SEGMENTS):
        of_block[s % blocks] |= ((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * s)
    return [sum(of_block[b] for b in kept) for kept in combinations(range(blocks), blocks - distance)]


def _cells(masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = counts_of(prints)
            for a in range(0, len(masks), 16):
                keys = []
                for i, mask in enumerate(masks[a : a + 16], a):
                    x = (counts & np.uint64(mask)) * mix + np.uint64(i)
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    keys.append(x ^ (x >> np.uint64(32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(prints, len(keys)).view(np.int64))], ["cell", "fp"])

    return run


def forest(prints: np.ndarray, distance: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what lies within ``distance``: each found by a walk over what is not yet reached.

    With ``split``, only links between the first ``split`` and the rest are looked for.
    """
    counts, left, links = counts_of(prints), np.arange(len(prints)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = manhattan(counts[left], counts[i]) <= distance
            near[near] = np.bitwise_count(prints[left[near]] ^ prints[i]) <= distance
            if split is not None:
                near &= (left < split) != (i < split)
            if near.any():
                reached = left[near]
                links += [(i, j) for j in reached.tolist()]
                queue += reached.tolist()
                left = left[~near]
    return [(int(a), int(b)) for a, b in links]


def _links(distance: int, cell_rows: int):
    """Over rows sorted by cell: links (kind 0), and the rows of cells that are too large (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b"]
        rest_cell, rest_prints, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def told(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

        def compared(cells, prints):
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            sizes = np.diff(np.append(starts, len(cells)))
            size_at = np.repeat(sizes, sizes)
            counts = counts_of(prints)
            a_out, b_out = [], []
            small = size_at <= 8
            for d in range(1, 8):
                if len(cells) <= d:
                    break
                at = np.flatnonzero((cells[d:] == cells[:-d]) & small[:-d])
                at = at[manhattan(counts[at], counts[at + d]) <= distance]
                at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= distance]
                a_out.append(prints[at])
                b_out.append(prints[at + d])
            for k in np.flatnonzero(sizes > 8):
                own = prints[starts[k] : starts[k] + sizes[k]]
                if links := forest(own, distance):
                    i, j = np.array(links).T
                    a_out.append(own[i])
                    b_out.append(own[j])
            return np.concatenate(a_out), np.concatenate(b_out)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.concatenate([rest_cell, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([rest_prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if large is not None:
                own = cells == large
                if own.any():
                    yield told(1, cells[own], prints[own])
                    cells, prints = cells[~own], prints[~own]
                if not len(cells):
                    rest_cell, rest_prints = cells, prints
                    continue
            whole = int(np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))[-1])
            rest_cell, rest_prints = cells[whole:], prints[whole:]
            if len(rest_cell) > cell_rows:
                large = rest_cell[0]
                yield told(1, rest_cell, rest_prints)
                rest_cell, rest_prints = rest_cell[:0], rest_prints[:0]
            cells, prints = cells[:whole], prints[:whole]
            if len(cells):
                starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                over = np.repeat(np.diff(np.append(starts, len(cells))), np.diff(np.append(starts, len(cells)))) > cell_rows
                if over.any():
                    yield told(1, cells[over], prints[over])
                    cells, prints = cells[~over], prints[~over]
            if len(cells) > 1:
                a, b = compared(cells, prints)
                if len(a):
                    yield told(0, a, b)
        if len(rest_cell) > 1:
            a, b = compared(rest_cell, rest_prints)
            if len(a):
                yield told(0, a, b)

    return run


def _chunk_pair(distance: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        rows = rows.sort_values("chunk", kind="stable")
        prints = rows["fp"].to_numpy(np.int64).view(np.uint64)
        links = forest(prints, distance, None if i == j else int((rows["chunk"] == i).sum()))
        if not links:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        x, y = np.array(links).T
        return pd.DataFrame({"a": prints[x].view(np.int64), "b": prints[y].view(np.int64)})

    return run


def links_between(prints: DataFrame, distance: int, scratch: Scratch, cell_rows: int = 4096) -> DataFrame:
    """(a, b): links that connect every pair of distinct fingerprints within ``distance``, spanning forests of cells.

    ``prints`` has distinct values in ``fp``.
    """
    n = prints.count()
    masks = masks_of(block_count(n, distance), distance)
    cells = prints.mapInArrow(_cells(masks), "cell bigint, fp bigint")
    found = scratch.save(
        cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(distance, cell_rows), "kind tinyint, a bigint, b bigint"), "cells"
    )
    links = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    sizes = large.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("chunks"))
    # every chunk of a large cell meets every other: a row goes to `chunks` pairs of chunks
    dealt = (
        large.join(sizes, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cell", "fp", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    more = dealt.groupBy("cell", "i", "j").applyInPandas(_chunk_pair(distance), "a bigint, b bigint")
    return links.unionByName(more).dropDuplicates()


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for nodes with a link, by large-star and small-star steps."""
    edges = scratch.save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropDuplicates(), "edges0")
    last = None
    for i in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        following = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).dropDuplicates(), f"edges{i}")
        now = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"edges{i - 1}")
        edges = following
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def near_duplicates(documents: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 4096) -> DataFrame:
    """One row a document: its id, ``fingerprint`` (16 hex digits), ``component_id``, ``group`` and ``row_key``.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the smallest id reachable
    (null only if no reachable document has an id), ``group`` a fingerprint that stands for the
    component and ``row_key`` a digest of id and text. Documents without words have fingerprint
    zero and are linked like others; repeated rows share a fingerprint; an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = documents.select(F.col(id_col).alias("id"), F.unhex(text_key(id_col, text_col)).alias("row_key"), F.col(text_col).alias("text"))
    printed = scratch.save(with_fingerprints(rows, shingle).select("id", "row_key", "fp"), "prints")
    distinct = scratch.save(printed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = components(links_between(distinct.select("fp"), distance, scratch, cell_rows), scratch)
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("group"))
    named = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    of_print = scratch.save(labelled.join(named, "group").select("fp", "component_id", "group"), "named")
    return printed.join(of_print, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "row_key")


def _signatures(shingle: int, bands: int, band_rows: int):
    """Of each text: the digest of its set of shingles, the set's size, fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        times, plus = (rng.integers(0, 1 << 63, (bands * band_rows, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            raw, at = string_bytes(batch.column("text"))
            for a, b in slices(at, SLICE_BYTES):
                own, sets, sizes, prints, keys = at[a : b + 1].tolist(), [], [], [], []
                for x, y in zip(own, own[1:]):
                    hashes = np.unique(shingle_hashes(raw[x:y].tobytes(), shingle))
                    least = np.full(len(times), np.iinfo(np.uint64).max)
                    for i in range(0, len(hashes), 1 << 12):
                        least = np.minimum(least, (hashes[None, i : i + (1 << 12)] * times + plus).min(1))
                    key = np.arange(bands, dtype=np.uint64)
                    for column in least.reshape(bands, band_rows).T:
                        key = (key ^ column) * mix
                        key ^= key >> np.uint64(29)
                    sets.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    prints.append(print_of(hashes))
                    keys.append(key.view(np.int64))
                rest = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(keys) + 1, bands), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([rest.column("id"), rest.column("row_key"), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], ["id", "row_key", "set", "n", "fp", "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = string_bytes(batch.column("text"))
            for a, b in slices(at, SLICE_BYTES):
                own = at[a : b + 1].tolist()
                hashes = [np.unique(shingle_hashes(raw[x:y].tobytes(), shingle)).view(np.int64) for x, y in zip(own, own[1:])]
                ends = np.cumsum([0, *map(len, hashes)])
                yield pa.RecordBatch.from_arrays([batch.column("set").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashes)))], ["set", "hashes"])

    return run


def _across_labels(similarity: float):
    """Over the sets of one cell (or of two of its chunks): links that join labels whose sets are alike.

    All sets but those of the most frequent label are compared with all sets of other labels, one
    against all at a time; only links that join two labels are handed on.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        rows = rows.drop_duplicates("set").sort_values("set")
        sets, chunks, sizes = (rows[c].to_numpy() for c in ("set", "chunk", "n"))
        found, label = [], np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        if len(rows) > 1 and label.any():
            token = np.unique(np.concatenate(rows["hashes"].to_list()), return_inverse=True)[1]
            starts, flags = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.zeros(len(token), np.int32)
            most = np.bincount(label).argmax()
            for at in np.flatnonzero(label != most):
                own = token[starts[at] : starts[at] + sizes[at]]
                flags[own] = 1
                both = np.add.reduceat(flags[token], starts)
                flags[own] = 0
                alike = (both >= similarity * (sizes + sizes[at] - both) - 1e-9) & (label != label[at])
                if i != j:
                    alike &= chunks != chunks[at]
                for other in np.unique(label[alike]):
                    found.append((sets[at], sets[alike & (label == other)][0]))
                    label[label == other] = label[at]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return run


def near_copies(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, cell_rows: int = 4096) -> DataFrame:
    """(id, row_key, group): texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more are linked.

    Equal sets are one from the start. Sets meet in cells. The first cells are the groups of
    fingerprints (of the sets' shingles, by ``links_between``) within ``distance`` bits. Pairs whose
    fingerprints lie further apart meet in the cells of ``BANDS`` keys of ``BAND_ROWS``
    minimal hashes each: a pair of similarity 0.8 misses all of them 3 times in a million, a closer
    one less often. All pairs of a cell that can still join two groups are compared: first those
    with the cell's least member, then, where a cell still holds several groups, the others
    between its groups, inside tasks that hand on only what joins groups. So no link of either kind
    of cell goes without the exact check: a fingerprint follows the many and two texts of other words may share it.
    Texts without words are one group.
    """
    scratch = Scratch(documents.sparkSession, "copies")
    rows = documents.select(F.col(id_col).alias("id"), F.unhex(text_key(id_col, text_col)).alias("row_key"), F.col(text_col).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    signed = scratch.save(rows.mapInArrow(_signatures(shingle, BANDS, BAND_ROWS), f"id {kind}, row_key binary, set bigint, n bigint, fp bigint, bands array<bigint>"), "signed")
    distinct = signed.groupBy("set").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    # the fingerprint follows from the set
    printed = scratch.save(signed.select("set", "n", "fp").distinct(), "printed")
    near = components(links_between(scratch.save(printed.select("fp").distinct(), "prints"), distance, scratch, cell_rows), Scratch(documents.sparkSession, "copies"))
    by_print = printed.join(near, printed["fp"] == near["node"], "left").select("set", "n", F.xxhash64(F.lit("fp"), F.coalesce("label", "fp")).alias("cell"))
    dealt = scratch.save(distinct.select("set", "n", F.explode("bands").alias("cell")).unionByName(by_print), "dealt")
    # cells of equal members are one; no more than BANDS + 1 cells have the same least member
    cells = dealt.groupBy("cell").agg(F.count("*").alias("m"), F.min("set").alias("least"), F.bit_xor(F.xxhash64("set")).alias("x")).filter("m > 1")
    cells = scratch.save(cells.groupBy("m", "least", "x").agg(F.min("cell").alias("cell")).select("cell", "least"), "cells")
    members = scratch.save(dealt.join(cells, "cell").select("cell", "least", "set", "n"), "members")
    texts = signed.join(members.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.min("row_key").alias("row_key"))
    named = rows.join(texts, "row_key").dropDuplicates(["set"]).select("set", "text")
    sets = scratch.save(named.mapInArrow(_sets(shingle), "set bigint, hashes array<bigint>"), "sets")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.filter((F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9) & (F.col("a") < F.col("b"))).select("a", "b").dropDuplicates()
        both = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("hashes_b")), "b")
        shared, sizes = F.size(F.array_intersect("hashes_a", "hashes_b")), F.size("hashes_a") + F.size("hashes_b")
        return scratch.save(both.filter(shared >= similarity * (sizes - shared) - 1e-9).select("a", "b"), name)

    sizes = members.groupBy("set").agg(F.first("n").alias("n_a")).withColumnRenamed("set", "a")
    links = alike(members.select(F.col("least").alias("a"), F.col("set").alias("b"), F.col("n").alias("n_b")).dropDuplicates().join(sizes, "a"), "links")
    labels = components(links, Scratch(documents.sparkSession, "copies"))
    now = scratch.save(members.join(labels, members["set"] == labels["node"], "left").select("cell", "least", "set", "n", F.coalesce("label", "set").alias("label")), "labelled")
    # what was compared with the least member needs no second look
    open_cells = now.groupBy("cell").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("m")).filter("first <> last and m > 2").select("cell")
    rest = scratch.save(now.join(open_cells, "cell").filter("set <> least and n > 0").select("cell", "set", "n", "label"), "rest")
    # a task gets a cell, or two chunks of a large one: every chunk meets every other
    sizes = rest.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    dealt = (
        rest.join(sizes, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cell", "set", "n", "label", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    more = scratch.save(dealt.join(sets, "set").groupBy("cell", "i", "j").applyInPandas(_across_labels(similarity), "a bigint, b bigint"), "more")
    labels = components(links.unionByName(more), Scratch(documents.sparkSession, "copies"))
    return signed.join(labels, signed["set"] == labels["node"], "left").select(F.col("id").alias(id_col), "row_key", F.coalesce("label", "set").alias("group"))


def _one_of_each(documents: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The document of the smallest id of each group (null ids last), then text digest; of rows with equal ids and texts one, whichever."""
    best = groups.groupBy("group").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "row_key")).alias("best"))
    (key,) = spare(documents, "_key")
    chosen = Scratch(documents.sparkSession, "chosen").save(best.select(F.col("best.row_key").alias(key)), "keys")
    keyed = documents.withColumn(key, F.unhex(text_key(id_col, text_col)))
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)


def keep_one(documents: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates by fingerprints, with all columns."""
    return _one_of_each(documents, near_duplicates(documents, distance, shingle, id_col, text_col), id_col, text_col)


def keep_one_copy(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, found by fingerprints and minimal hashes and decided by shared shingles, with all columns."""
    return _one_of_each(documents, near_copies(documents, similarity, shingle, id_col, text_col), id_col, text_col)


def brute_force(rows: list[tuple], distance: int = 4, shingle: int = 4) -> list[tuple]:
    """For tests: (doc_id, fingerprint, component_id) by comparing all pairs."""
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words)] if 0 < len(words) < shingle else [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], f"{prints[i]:016x}", min(ids) if ids else None) for i in members]
    return out
