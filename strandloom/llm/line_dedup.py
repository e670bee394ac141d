"""Line dedup with two Bloom filters: once-seen and twice-seen line hashes.

1. Each task folds the line hashes of its documents (each document's distinct lines once) into a
   pair of bit arrays and hands them on by block. Folding two pairs is associative:
   ``twice = twice_a | twice_b | (once_a & once_b)``, ``once = once_a | once_b``. A line in two
   documents is always in ``twice``; false positives only make the next step larger.
2. Lines that ``twice`` holds are suspected repeats. They alone are shuffled, as whole keys, and
   counted exactly; hot keys are added up before the shuffle.
3. Lines whose key is in ``min_docs`` documents go: everywhere (``keep="none"``) or everywhere but
   at the first occurrence (``keep="first"``: smallest id, then smallest text digest).

The filters have 16 bits a line up to ``max_filter_bits``; beyond, more lines become suspects and
the result stays exact. Repeated lines go to the last pass as a broadcast set if their measured
bytes are within ``broadcast_bytes``, and by a join on the document otherwise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import filter_bits, probes, test_bits, twice_filter
from .common import Scratch, spare, text_key, with_fields

BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: The mean length of a line that the filters are sized by; shorter lines only bring more suspects.
BYTES_A_LINE = 64
#: Documents whose lines a task holds at once.
ROWS = 1024


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(BLANK_BYTES).lower() for line in (text or "").encode().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points; bytes are counted only where they can decide."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _line_hashes(min_chars: int):
    """The hashes of each document's distinct lines."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        found: list[bytes] = []
        for text in batch.column(0):
            found.extend({k for k in line_keys(text.as_py()) if long_enough(k, min_chars)})
            if len(found) > 20_000:
                yield hashes_of(found)
                found = []
        yield hashes_of(found)

    return run


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            keys, docs, ids = [], [], batch.column(0)
            for row, text in enumerate(batch.column(1)):
                own = list(dict.fromkeys(k for k in line_keys(text.as_py()) if long_enough(k, min_chars)))
                keys += own
                docs += [row] * len(own)
            if not keys:
                continue
            hit = np.flatnonzero(test_bits(twice, probes(hashes_of(keys), bits)))
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in hit], pa.binary()), ids.take(pa.array([docs[i] for i in hit])), batch.column(2).take(pa.array([docs[i] for i in hit]))],
                    ["key", "id", "doc"],
                )

    return run


def _kept(text: str | None, gone: dict[bytes, bool] | set[bytes]) -> tuple[int, int, str]:
    """Lines, dropped lines and what stays. A dict tells whether this document keeps the first line of a key."""
    lines, kept, seen = (text or "").split("\n"), [], set()
    for line, key in zip(lines, line_keys(text), strict=True):
        if key not in gone:
            kept.append(line)
        elif isinstance(gone, dict) and gone[key] and key not in seen:
            seen.add(key)
            kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _cleaned(gone_of, hidden: list[str]):
    """gone_of(batch, row): the repeated keys that matter for that row; the first of ``hidden`` is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, kept = [], [], []
            for row, text in enumerate(batch.column(hidden[0])):
                a, b, c = _kept(text.as_py(), gone_of(batch, row))
                n.append(a)
                dropped.append(b)
                kept.append(c)
                if len(n) == ROWS or sum(map(len, kept[-64:])) > 1 << 25 or row + 1 == batch.num_rows:
                    done = row + 1 - len(n)
                    rest = batch.slice(done, len(n))
                    names = [c for c in rest.schema.names if c not in hidden]
                    yield pa.RecordBatch.from_arrays([rest.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept_text"])
                    n, dropped, kept = [], [], []

    return run


def dedup_lines(
    documents: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_a_line: int = 16,
    max_filter_bits: int = 1 << 28,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """All columns of ``documents`` plus n_lines, n_dropped and kept_text.

    A null or empty text is one empty line; keys shorter than ``min_chars`` code points are never
    dropped. A line counts once a document, whatever its
    rows; rows with equal ids are documents of their own. Columns of the input with the names of
    results are replaced. An empty table gives no rows.
    """
    if keep not in ("none", "first") or min_docs < 2 or min_chars < 0:
        raise ValueError("keep is none or first, min_docs 2 or more, min_chars 0 or more")
    spark = documents.sparkSession
    scratch = Scratch(spark, "lines")
    documents = documents.drop("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = documents.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("rows")).first()
    bits = filter_bits(size["rows"] + (size["bytes"] or 0) // BYTES_A_LINE, bits_a_line, max_filter_bits)  # a size for the filter: no line is read for it
    shared = spark.sparkContext.broadcast(twice_filter(documents.select(F.col(text_col).alias("_text")), _line_hashes(min_chars), bits))

    keyed = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("_text"), F.unhex(text_key(id_col, text_col)).alias("doc"))
    suspects = keyed.mapInArrow(_suspects(shared, bits, min_chars), "key binary, id string, doc binary")
    first = F.min(F.struct(F.expr("try_cast(id as decimal(38,0))"), "id", "doc")) if keep == "first" else F.lit(None)
    counted = suspects.groupBy("key").agg(F.count("*").alias("docs"), *([first.alias("first")] if keep == "first" else []))
    repeated = scratch.save(counted.filter(F.col("docs") >= min_docs), "repeated")
    size = repeated.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    schema = with_fields(documents, "n_lines bigint, n_dropped bigint, kept_text string")
    hidden = text_, gone_, doc_ = spare(documents, "_text", "_gone", "_doc")
    texts = documents.withColumn(text_, F.col(text_col))
    if size <= broadcast_bytes:
        rows = repeated.collect()
        if keep == "none":
            gone = spark.sparkContext.broadcast({bytes(r["key"]) for r in rows})
            return texts.mapInArrow(_cleaned(lambda batch, row: gone.value, hidden), schema)
        firsts = spark.sparkContext.broadcast({bytes(r["key"]): bytes(r["first"]["doc"]) for r in rows})

        def gone_of(batch, row):
            doc = batch.column(gone_)[row].as_py()
            text = batch.column(text_)[row].as_py()
            return {k: firsts.value[k] == doc for k in line_keys(text) if k in firsts.value}

        return texts.withColumn(gone_, F.unhex(text_key(id_col, text_col))).mapInArrow(_cleaned(gone_of, hidden), schema)
    # too large for a broadcast: the repeated keys of each document, joined to it
    keeps = (F.col("first.doc") == F.col("doc")) if keep == "first" else F.lit(False)
    pairs = suspects.join(repeated, "key").select("doc", F.struct("key", keeps.alias("keeps")).alias("one"))
    lists = pairs.groupBy(F.col("doc").alias(doc_)).agg(F.collect_set("one").alias(gone_))  # as many as the document has lines
    joined = texts.withColumn(doc_, F.unhex(text_key(id_col, text_col))).join(lists, doc_, "left").drop(doc_)

    def listed(batch, row):
        return {x["key"]: x["keeps"] for x in batch.column(gone_)[row].as_py() or ()}

    return joined.mapInArrow(_cleaned(listed, hidden), schema)


def digests(cleaned: DataFrame) -> DataFrame:
    """The rows of op8: doc_id, n_lines, n_dropped, kept_sha256."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], min_docs: int = 10) -> list[tuple]:
    """For tests: (doc_id, n_lines, n_dropped, kept_sha256) of (doc_id, text) rows."""
    from collections import Counter

    docs = Counter(k for _, text in rows for k in set(line_keys(text)) if k)
    gone = {k for k, n in docs.items() if n >= min_docs}
    out = []
    for doc_id, text in rows:
        n, dropped, kept = _kept(text, gone)
        out.append((doc_id, n, dropped, hashlib.sha256(kept.encode()).hexdigest()))
    return out
