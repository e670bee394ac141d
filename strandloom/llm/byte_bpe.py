"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Characters become classes (letter, number, blank, other, and the cases the pattern looks ahead
for), classes become transition functions of a small automaton, and an associative scan composes
them: the functions form a finite monoid, so composing two is one table look-up, in blocks and
then over blocks. The automaton's state before each character tells where a token of the pattern
begins. The slices between the boundaries go to a cached merge of pairs by rank.

Spark deals the rows out; each task encodes its batches in slices of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spare, string_bytes, with_fields

#: The characters of Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, BLANK = range(4)
#: A space that joins the token after it; another blank before a token; an apostrophe that may begin
#: a contraction of one or of two letters.
JOINING, LAST_BLANK, SHORT, LONG = range(4, 8)
#: The first character of a text has its class plus this.
START = 8
#: States: what the character before belongs to; ONE and TWO letters of a contraction to come; a token ended.
IN_OTHER, IN_LETTER, IN_NUMBER, IN_BLANK, JOINED, ONE, TWO, ENDED = range(8)
SLICE_BYTES = 1 << 20
#: Longer texts are encoded in stretches, cut where a token begins whatever stands around.
STRETCH_BYTES = 1 << 22
SAFE_CUT = re.compile(rb"[A-Za-z](?= [A-Za-z])")
LONG_PIECE = 96


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at this character."""
    if kind >= START:
        state, kind = ENDED, kind - START
    if kind == LETTER and state in (ONE, TWO):
        return (ENDED if state == ONE else ONE), False
    if kind == JOINING:
        return JOINED, True
    if kind == LAST_BLANK:
        return IN_BLANK, True
    if kind in (SHORT, LONG):
        if state in (IN_OTHER, JOINED):
            return IN_OTHER, False
        return (ONE if kind == SHORT else TWO), True
    own = {OTHER: IN_OTHER, LETTER: IN_LETTER, NUMBER: IN_NUMBER, BLANK: IN_BLANK}[kind]
    return own, not (state == own or state == JOINED and kind != BLANK)


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, function applied to a state, boundary by state and class)."""
    generators = [tuple(_step(s, k)[0] for s in range(8)) for k in range(16)]
    ids = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for f in order:
        for g in generators:
            if (fg := tuple(g[x] for x in f)) not in ids:
                ids[fg] = len(order)
                order.append(fg)
    n = len(order)
    compose = np.array([[ids[tuple(g[x] for x in f)] for g in order] for f in order], np.uint16)
    begins = np.array([[_step(s, k)[1] for k in range(16)] for s in range(8)], bool)
    return np.array([ids[g] for g in generators], np.uint16), compose.ravel(), np.array(order, np.uint8).ravel(), begins.ravel()


def composed(functions: np.ndarray, compose: np.ndarray, n: int, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of ``functions``."""
    size = len(functions)
    if size <= width:
        out = functions.copy()
        for i in range(1, size):
            out[i] = compose[int(out[i - 1]) * n + int(functions[i])]
        return out
    rows = -(-size // width)
    grid = np.zeros(rows * width, np.uint16)  # function 0 is the identity
    grid[:size] = functions
    grid = grid.reshape(rows, width).T.copy()
    for i in range(1, width):
        grid[i] = compose[grid[i - 1].astype(np.int32) * n + grid[i]]
    before = np.zeros(rows, np.uint16)
    before[1:] = composed(grid[-1], compose, n, width)[:-1]
    return compose[before.astype(np.int32) * n + grid].T.ravel()[:size]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[WHITE_SPACE] = BLANK
    return table


def token_starts(data: bytes, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens of the pattern begin; ``text_starts`` are those of nonempty texts."""
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    kinds = class_table()[points]
    first = np.searchsorted(lead, text_starts)
    after, after2 = np.zeros_like(points), np.zeros_like(points)  # 0 past the end of a text: no letter
    after[:-1], after2[:-2] = points[1:], points[2:]
    ends = np.append(first[1:], len(points)) - 1
    next_kind = np.full(len(kinds), BLANK, np.uint8)
    next_kind[:-1] = kinds[1:]
    next_kind[ends] = BLANK
    after[ends] = after2[ends] = 0
    after2[np.maximum(ends - 1, 0)] = 0
    last = (kinds == BLANK) & (next_kind != BLANK)
    quote = np.flatnonzero(points == 39)
    kinds[last] = LAST_BLANK
    kinds[last & (points == 32)] = JOINING
    if len(quote):
        x, y = after[quote], after2[quote]
        kinds[quote[np.isin(x, [ord(c) for c in "stmd"])]] = SHORT
        kinds[quote[((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))]] = LONG
    kinds[first] += START
    of_class, compose, applied, begins = automaton()
    n = len(applied) // 8
    functions = composed(of_class[kinds], compose, n)
    state = np.full(len(kinds), ENDED, np.uint8)
    state[1:] = applied[functions[:-1].astype(np.int32) * 8 + ENDED]
    return lead[begins[state.astype(np.int32) * 16 + kinds]]


class Merger:
    """Ids of a piece by repeated merging of the adjacent pair of lowest rank, with a cache of two generations."""

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        self.ranks, self.most = ranks, most
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        found = self.old.get(piece)
        if found is None:
            found = self.merged(piece)
        if len(piece) <= LONG_PIECE:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def merged(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > LONG_PIECE:
            return self.merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 30:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return tuple([ranks[p] for p in parts])

    def merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, so that one piece of a whole text takes n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before = [i + 1 for i in range(n)], [i - 1 for i in range(n)]  # a part is piece[i:end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray([1]) * n
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue
            j = end[i]
            alive[j] = 0
            end[i] = to
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


@lru_cache(maxsize=1)
def _merger(content: bytes) -> Merger:
    """One merger a Python worker: pieces that its earlier tasks met stay cached."""
    return Merger(parse_ranks(content))


@lru_cache(maxsize=1)
def _tokens(content: bytes) -> list[bytes]:
    """The bytes of each id."""
    ranks = parse_ranks(content)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return tokens


def encode_texts(data: bytes, offsets: np.ndarray, merge: Merger) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n + 1 offsets into them) of the texts data[offsets[i]:offsets[i + 1]]."""
    counts = np.zeros(len(offsets), np.int64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if not len(filled):
        return np.zeros(0, np.int32), counts
    starts = token_starts(data, offsets[filled])
    cuts = starts.tolist()
    cuts.append(len(data))
    young, rows = merge.young, []
    for a, b in zip(cuts, cuts[1:]):
        piece = data[a:b]
        ids = young.get(piece)
        if ids is None:
            ids = merge(piece)
            young = merge.young
        rows.append(ids)
    sizes = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)), out=sizes[1:])
    return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes[-1])), sizes[np.searchsorted(starts, offsets)]


def stretches(data: bytes, most: int = STRETCH_BYTES) -> list[int]:
    """Cuts of a long text: before a space between two letters a token begins whatever stands around.

    A text without such a place is one stretch.
    """
    cuts = [0]
    while len(data) - cuts[-1] > most and (found := SAFE_CUT.search(data, cuts[-1] + most)):
        cuts.append(found.end())
    return [*cuts, len(data)]


def encode_long(data: bytes, merge: Merger, most: int = STRETCH_BYTES) -> np.ndarray:
    """The ids of one long text, stretch by stretch."""
    cuts = stretches(data, most)
    return np.concatenate([encode_texts(data[a:b], np.array([0, b - a]), merge)[0] for a, b in zip(cuts, cuts[1:])])


def _valid(column: pa.Array) -> pa.Array:
    """Texts with bytes that are no UTF-8 get the replacement character for them."""
    return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())


def _encoder(shared, token_offsets: bool, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _merger(shared.value)
        widths = np.fromiter(map(len, _tokens(shared.value)), np.int64) if token_offsets else None
        for batch in batches:
            column = batch.column(text_col)
            raw, at = string_bytes(column)
            for a, b in slices(at, SLICE_BYTES):
                data = raw[at[a] : at[b]].tobytes()
                own = at[a : b + 1] - at[a]
                try:
                    if b - a == 1 and len(data) > STRETCH_BYTES:
                        ids = encode_long(data, merge)
                        cuts = np.array([0, len(ids)])
                    else:
                        ids, cuts = encode_texts(data, own, merge)
                except UnicodeDecodeError:
                    raw2, own = string_bytes(_valid(column.slice(a, b - a)))
                    data = raw2[own[0] : own[-1]].tobytes()
                    own = own - own[0]
                    ids, cuts = encode_texts(data, own, merge)
                rest = batch.slice(a, b - a)
                names = [c for c in rest.schema.names if c != text_col]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))
                arrays = [*(rest.column(c) for c in names), lists]
                if token_offsets:
                    ends = np.cumsum(widths[ids])
                    starts = ends - widths[ids] - np.repeat(own[:-1], np.diff(cuts))
                    arrays.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(starts.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "ids", *(["token_offsets"] if token_offsets else [])])

    return run


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, ranks_path: str, text_col: str = "text", token_offsets: bool = True) -> DataFrame:
    """All columns of ``documents`` plus ids array<int>, and with ``token_offsets`` the byte offset of each token.

    ``ranks_path`` is a file of the driver with base64 tokens and ranks; its content (under a
    megabyte for 50,000 tokens) is broadcast. A null text is encoded as the empty one, to no ids.
    Input columns with the names of results are replaced; rows are independent, so repeated rows
    and ties need no rule. A text is limited to 2**31 bytes, as any Spark string; long ones are
    encoded in stretches.
    """
    documents = documents.drop("ids", "token_offsets")
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    more, (text,) = "ids array<int>, token_offsets array<int>" if token_offsets else "ids array<int>", spare(documents, "_text")
    return documents.withColumn(text, F.col(text_col)).mapInArrow(_encoder(shared, token_offsets, text), with_fields(documents, more))


def _decoder(shared, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared.value)
        for batch in batches:
            column = batch.column(ids_col)
            cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            flat = column.values
            for a, b in slices(cuts.astype(np.int64), 1 << 20):
                ids = flat.slice(int(cuts[a]), int(cuts[b] - cuts[a])).to_numpy(zero_copy_only=False).tolist()
                parts = [tokens[i] for i in ids]
                own = (cuts[a : b + 1] - cuts[a]).tolist()
                decoded = [b"".join(parts[x:y]) for x, y in zip(own, own[1:])]
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(decoded, pa.binary())], [*rest.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns plus ``decoded`` binary, the bytes of the ids; null ids decode to no bytes."""
    encoded = encoded.drop("decoded").withColumn(ids_col, F.coalesce(F.col(ids_col), F.expr("cast(array() as array<int>)")))
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return encoded.mapInArrow(_decoder(shared, ids_col), with_fields(encoded, "decoded binary"))


def digests(decoded: DataFrame) -> DataFrame:
    """The rows of op6: doc_id, n_tokens, ids_sha256, decoded_sha256, and a checksum of the tokens' offsets."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *([F.xxhash64("token_offsets").alias("offsets_xxhash64")] if "token_offsets" in decoded.columns else []),
    )
