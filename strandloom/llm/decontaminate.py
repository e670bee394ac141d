"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become lower-cased words joined by single spaces with a space at both ends; each window of
10 item words is a pattern in that form. Patterns of similar length share tables: a block of B
bytes at the end of the search window tells through the shift table how far the window can move;
where the shift is zero, the bucket of the suffix hash (with a prefix hash beside it) selects the
patterns, which are then compared byte for byte. Many search windows move at once: the text of a
batch is cut into stretches with a cursor each, and numpy moves all cursors together.

Patterns go to the tasks in blocks of bounded size (``block_bytes`` of item text); with more than
one block the documents are scanned once a block and the hits are united, so a benchmark of any
size is searched exactly.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, spare, string_bytes, text_key, with_fields

#: Bytes of words after lower-casing stay, all others become spaces: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HASH_BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
STRETCH = 1024
SLICE_BYTES = 1 << 20
#: Patterns of these lengths share tables, so that a short one does not shorten all shifts.
LENGTH_CLASSES = (1, 8, 24, 1 << 62)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def _loads(raw: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """The ``block`` bytes at each place as one number; ``raw`` has 8 bytes to spare at its end."""
    wide = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    return wide[at] & np.uint64((1 << 8 * block) - 1)


def _hashed(values: np.ndarray) -> np.ndarray:
    return ((values * MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class WuManber:
    """Tables over patterns of at least ``m`` bytes, ``m`` being the shortest one's length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        raw = np.frombuffer(b"".join(p[: self.m] for p in patterns) + bytes(8), np.uint8)
        starts = np.arange(len(patterns)) * self.m
        self.shift = np.full(1 << HASH_BITS, self.m - self.block + 1, np.int64)
        for end in range(self.block, self.m + 1):
            h = _hashed(_loads(raw, starts + end - self.block, self.block))
            self.shift[h] = np.minimum(self.shift[h], self.m - end)
        suffix, prefix = _loads(raw, starts + self.m - self.block, self.block), _loads(raw, starts, self.block)
        keys = suffix * MIX ^ prefix
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.bucket = np.split(order, first[1:])

    def occurrences(self, raw: np.ndarray, data: bytes) -> tuple[list[int], list[int]]:
        """(places, pattern numbers) in raw[:-8]; a pattern may occur at many places and overlap others."""
        n = len(raw) - 8
        ends = np.arange(0, max(0, n - self.m + 1), STRETCH) + self.m  # exclusive ends of the search windows
        stop = np.minimum(ends + STRETCH, n + 1)
        found = []
        while len(ends):
            shift = self.shift[_hashed(_loads(raw, ends - self.block, self.block))]
            if (zero := shift == 0).any():
                at = ends[zero] - self.m
                keys = _loads(raw, at + self.m - self.block, self.block) * MIX ^ _loads(raw, at, self.block)
                slot = np.searchsorted(self.keys, keys)
                slot[slot == len(self.keys)] = 0
                hit = self.keys[slot] == keys
                found.append((at[hit], slot[hit]))
            ends = ends + np.maximum(shift, 1)
            alive = ends < stop
            ends, stop = ends[alive], stop[alive]
        places, numbers = [], []
        for at, slot in found:
            for a, s in zip(at.tolist(), slot.tolist(), strict=True):
                for p in self.bucket[s].tolist():
                    if data.startswith(self.patterns[p], a):
                        places.append(a)
                        numbers.append(p)
        return places, numbers


class Searcher:
    """All length classes of one block of patterns; patterns know their items and number of words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        owners: dict[bytes, set] = defaultdict(set)
        for item_id, text in items:
            for words in windows_of(words_of(text), window):
                owners[b" " + b" ".join(words) + b" "].add(item_id)
        self.tables = []
        for low, high in zip(LENGTH_CLASSES, LENGTH_CLASSES[1:]):
            own = sorted(p for p in owners if low <= len(p) < high)
            if own:
                self.tables.append((WuManber(own), [sorted(owners[p], key=str) for p in own], np.array([p.count(b" ") - 1 for p in own])))

    def search(self, texts: list[bytes]) -> tuple[list[int], dict[int, set[int]], dict[int, set]]:
        """Word counts; hit word positions and items by row."""
        rows = [words_of(t) for t in texts]
        joined = [b" " + b" ".join(r) + b" " for r in rows]
        data = b"\0".join(joined)  # no pattern holds a zero byte
        raw = np.frombuffer(data + bytes(8), np.uint8)
        hits: dict[int, set[int]] = defaultdict(set)
        items: dict[int, set] = defaultdict(set)
        starts = spaces = None
        for table, owners, n_words in self.tables:
            places, numbers = table.occurrences(raw, data)
            if not places:
                continue
            if starts is None:
                starts = np.concatenate([[0], np.cumsum([len(j) + 1 for j in joined])[:-1]]).astype(np.int64)
                spaces = np.flatnonzero(raw == 32)
            row = np.searchsorted(starts, places, side="right") - 1
            first = np.searchsorted(spaces, places) - np.searchsorted(spaces, starts[row])
            for r, w, p in zip(row.tolist(), first.tolist(), numbers, strict=True):
                hits[r].update(range(w, w + int(n_words[p])))
                items[r].update(owners[p])
        return [len(r) for r in rows], hits, items


def _search(shared, window: int, only_hits: bool, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(pickle.loads(shared.value), window)
        for batch in batches:
            raw, at = string_bytes(batch.column(text_col))
            for a, b in slices(at, SLICE_BYTES):
                data, own = raw[at[a] : at[b]].tobytes(), (at[a : b + 1] - at[a]).tolist()
                counts, hits, items = searcher.search([data[x:y] for x, y in zip(own, own[1:])])
                keep = [i for i in range(b - a) if i in hits] if only_hits else range(b - a)
                if not len(keep):
                    continue
                rest = batch.slice(a, b - a)
                rest = rest.take(pa.array(keep)) if only_hits else rest
                names = [c for c in rest.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rest.column(c) for c in names),
                        pa.array([counts[i] for i in keep], pa.int64()),
                        pa.array([sorted(hits.get(i, ())) for i in keep], pa.list_(pa.int32())),
                        pa.array([sorted(map(str, items.get(i, ()))) for i in keep], pa.list_(pa.string())),
                    ],
                    [*names, "n_words", "hit_words", "items"],
                )

    return run


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """All columns of ``documents`` plus n_words, hit_words array<int> and items array<string>.

    ``hit_words`` are the positions of the words inside any occurrence of a window, ``items`` the
    ids of the items (as strings, sorted, each once) with occurring windows. Null and empty texts
    have no words; items without words or with a null id have no windows; repeated items count
    once an id. Input columns with the names of results are replaced.
    """
    spark = documents.sparkSession
    documents = documents.drop("n_words", "hit_words", "items")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text")).filter("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    found, (text, key) = "n_words bigint, hit_words array<int>, items array<string>", spare(documents, "_text", "_key")

    def shared(rows):
        return spark.sparkContext.broadcast(pickle.dumps([(r["item"], bytes(r["text"])) for r in rows]))

    texts = documents.withColumn(text, F.col(text_col))
    if size <= block_bytes:
        return texts.mapInArrow(_search(shared(items.collect()), window, False, text), with_fields(documents, found))
    # blocks of about block_bytes: a hash of the item deals them out, each is collected by itself
    blocks = -(-size // block_bytes)
    dealt = Scratch(spark, "benchmark").save(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")
    keyed = texts.withColumn(key, text_key(id_col, text_col))
    counted = keyed.mapInArrow(_search(spark.sparkContext.broadcast(pickle.dumps([])), window, False, text), with_fields(keyed.drop(text), found)).drop("hit_words", "items")
    hits = None
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).collect()
        own = keyed.select(key, text).mapInArrow(_search(shared(rows), window, True, text), with_fields(keyed.select(key), found)).drop("n_words")
        hits = own if hits is None else hits.unionByName(own)
    ranked = hits.dropDuplicates()  # equal rows of documents give equal hits
    united = ranked.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = counted.join(united, key, "left").drop(key)
    return joined.withColumn("hit_words", F.coalesce("hit_words", F.expr("cast(array() as array<int>)"))).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))


def digests(found: DataFrame) -> DataFrame:
    """The rows of op5: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple], benchmark: list[tuple], window: int = 10) -> list[tuple]:
    """For tests: the rows of op5 by comparing all word windows."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = defaultdict(set)
    for item_id, text in benchmark:
        words = split(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[i : i + window])].add(item_id)
    sizes, out = sorted({len(k) for k in owners}), []
    for doc_id, text in documents:
        words, hit, items = split(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (own := owners.get(tuple(words[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= own
        joined = ",".join(sorted(map(str, items)))
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out
