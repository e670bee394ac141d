"""Substring dedup by line or paragraph hashing.

Units (lines, paragraphs between blank lines, or the sentences of lines) are normalised (lower case,
words only), digested to 128 bits and grouped over all documents; the earliest ranked occurrence
(smallest id, then hash of the text, then row, then first place in the text) stays and the others
go. Spans keep the original offsets.

``min_words`` is a floor over runs: adjacent repeated units go together if they hold that many
words, so a long passage goes however short its lines are, and a short line goes with its
neighbours but not by itself, unless it is all that the document has. Texts often come as one long line, and a passage may begin in the
middle of it; cutting lines at sentence ends lets all but the passage's two ends be found.

A digest is added up before the shuffle; digests in very many rows, whose number is bounded, meet
their occurrences by broadcast, the others by a join in which no key is large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, spare, split_hot, with_fields

SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*"), "sentence": re.compile(r"\n|(?<=[.!?])[ \t]+")}
WORDS = re.compile(r"\w+")


def units_of(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the units, separators left out."""
    out, start = [], 0
    for m in SEPARATORS[unit].finditer(text):
        out.append((start, m.start()))
        start = m.end()
    return [*out, (start, len(text))]


def digest_of(unit: str) -> tuple[bytes, int]:
    """The digest of a unit's words and their number; a unit without words is blank."""
    words = WORDS.findall(unit.lower())
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), len(words)


UNIT = "d1 bigint, d2 bigint, id {id}, text_hash bigint, row bigint, at int"


def _units(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, at = [], [], []

            def told():
                two, take = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), pa.array(rows, pa.int64())
                shared = [batch.column(c).take(take) for c in ("id", "text_hash", "row")]
                return pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), *shared, pa.array(at, pa.int32())], ["d1", "d2", "id", "text_hash", "row", "at"])

            for row, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                for i, (a, b) in enumerate(units_of(text, unit)):
                    digest, n = digest_of(text[a:b])
                    if n:
                        digests.append(digest)
                        rows.append(row)
                        at.append(i)
                if len(digests) > 50_000:
                    yield told()
                    digests, rows, at = [], [], []
            if digests:
                yield told()

    return run


def gone_units(sizes: list[int], repeated: set[int], min_words: int) -> set[int]:
    """The units that go: runs of repeated ones (blank ones between count as neither) with ``min_words`` words in all, or all units."""
    if repeated and all(i in repeated for i, n in enumerate(sizes) if n):
        return repeated
    gone, run, words = set(), [], 0
    for i, n in enumerate([*sizes, -1]):
        if n and i not in repeated:
            if words >= min_words:
                gone.update(run)
            run, words = [], 0
        elif n:
            run.append(i)
            words += n
    return gone


def _removed(unit: str, min_words: int, text_col: str, repeated_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done, size, n_units, spans, kept = 0, 0, [], [], []
            for row in range(batch.num_rows):
                text, own, parts, last = batch.column(text_col)[row].as_py() or "", [], [], 0
                units, repeated = units_of(text, unit), batch.column(repeated_col)[row].as_py()
                if repeated:
                    gone = gone_units([len(WORDS.findall(text[a:b])) for a, b in units], set(repeated), min_words)
                    own = [u for i, u in enumerate(units) if i in gone]
                    for i, (a, b) in enumerate(units):
                        if i in gone:
                            parts.append(text[last:a])
                            last = units[i + 1][0] if i + 1 < len(units) else b
                parts.append(text[last:])
                n_units.append(len(units))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append("".join(parts))
                size += len(text)
                if size > 1 << 24 or row + 1 == batch.num_rows:
                    part = batch.slice(done, row + 1 - done)
                    names = [c for c in part.schema.names if c not in (text_col, repeated_col)]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in names), pa.array([len(s) for s in spans], pa.int64()), pa.array(n_units, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
                        [*names, "n_removed", "n_units", "removed_spans", "kept_text"],
                    )
                    done, size, n_units, spans, kept = row + 1, 0, [], [], []

    return run


def dedup_units(documents: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` plus n_removed, n_units, removed_spans and kept_text.

    Spans are code points of the original text; the separator after a removed unit goes with it.
    Units without words stay. A null text is empty; ids sort numerically where they are numbers,
    null ids last. Of rows with equal ids and texts one, whichever, is the first, and the others
    lose what it keeps. Input columns with the names of results are replaced; an empty table gives
    no rows.
    """
    if unit not in SEPARATORS:
        raise ValueError(f"unit is one of {sorted(SEPARATORS)}")
    scratch = Scratch(documents.sparkSession, "units")
    documents = documents.drop("n_units", "n_removed", "removed_spans", "kept_text")
    row, text, repeated = spare(documents, "_row", "_text", "_repeated")
    numbered = scratch.save(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written: the numbers stay the same
    whole = isinstance(documents.schema[id_col].dataType, IntegralType)
    id_type = "bigint" if whole else "string"
    inputs = numbered.select(F.col(id_col).cast(id_type).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    units = scratch.save(inputs.mapInArrow(_units(unit), UNIT.format(id=id_type)), "units")
    number = F.expr("try_cast(id as decimal(38,0))")
    of_id = [F.col("id").isNull().alias("no_id")] if whole else [number.isNull().alias("no_number"), number.alias("number")]
    rank = F.struct(*of_id, "id", "text_hash", "row", "at")
    times = scratch.save(
        units.groupBy("d1", "d2").agg(F.count("*").alias("times"), F.min(rank).alias("first")).filter("times > 1").select("d1", "d2", "times", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")),
        "repeated",
    )
    hot, rest = split_hot(times, "times", units.count())
    later = "row <> first_row or at <> first_at"
    occurrences = units.join(F.broadcast(hot), ["d1", "d2"]).filter(later).select("row", "at")
    occurrences = occurrences.unionByName(units.join(rest, ["d1", "d2"]).filter(later).select("row", "at"))
    lists = occurrences.groupBy(F.col("row").alias(row)).agg(F.collect_list("at").alias(repeated))  # units of one document
    joined = numbered.withColumn(text, F.col(text_col)).join(lists, row, "left").drop(row)
    return joined.mapInArrow(_removed(unit, min_words, text, repeated), with_fields(documents, "n_removed bigint, n_units bigint, removed_spans array<struct<start: bigint, end: bigint>>, kept_text string"))


def brute_force(rows: list[tuple], unit: str = "line", min_words: int = 1) -> list[tuple]:
    """For tests: (doc_id, n_units, spans) of (doc_id, text) rows with distinct integer ids."""
    first, out = {}, []
    for doc_id, text in sorted(rows):
        units, repeated, sizes = units_of(text or "", unit), set(), []
        for i, (a, b) in enumerate(units):
            digest, n = digest_of((text or "")[a:b])
            sizes.append(n)
            if n and first.setdefault(digest, (doc_id, i)) != (doc_id, i):
                repeated.add(i)
        gone = gone_units(sizes, repeated, min_words)
        out.append((doc_id, len(units), [u for i, u in enumerate(units) if i in gone]))
    return out
