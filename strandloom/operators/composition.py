"""Composition, codons, open frames, sites and matrices over sequences (id, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions.arrays import firsts, slices, text_numbers


def base_counts(seqs: DataFrame) -> DataFrame:
    """Bases, GC share and mass of each sequence, by lengths and not by rows of bases."""
    counts = [S.count_letter(F.col("seq"), b).alias(f"n_{b.lower()}") for b in "ACGT"]
    return seqs.select("id", F.length("seq").alias("length"), *counts, F.round(S.gc_content(F.col("seq")), 6).alias("gc"), F.round(S.mass(F.col("seq")), 4).alias("mass"))


def words(seqs: DataFrame, k: int, keep: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """Overlapping words of length k with 0-based places.

    One pass of a look-ahead pattern: taking substrings one by one would walk the text anew each time.
    """
    found = F.regexp_extract_all("seq", F.lit(f"(?=(.{{{k}}}))"), 1)
    return seqs.select(*keep, F.posexplode(found).alias("pos", "word"))


def pair_counts(seqs: DataFrame) -> DataFrame:
    """The 16 counts over all sequences, without a row a base: two different bases can't overlap themselves, so lengths
    give their counts; the rest of a base's places, but for a sequence's last, are followed by the base itself."""
    pairs = [(a, b) for a in "ACGT" for b in "ACGT" if a != b]
    sums = seqs.agg(
        *[F.sum((F.length("seq") - F.length(F.replace("seq", F.lit(a + b), F.lit("")))) / 2).alias(a + b) for a, b in pairs],
        *[F.sum(S.count_letter(F.col("seq"), a) - F.endswith(F.col("seq"), F.lit(a)).cast("int")).alias(a) for a in "ACGT"],
    )
    n = lambda a, b: F.col(a + b) if a != b else F.col(a) - sum(F.col(a + x) for x in "ACGT" if x != a)
    counts = [F.struct(F.lit(a + b).alias("word"), F.coalesce(n(a, b), F.lit(0)).cast("long").alias("n")) for a in "ACGT" for b in "ACGT"]
    return sums.select(F.explode(F.array(*counts)).alias("x")).select("x.word", "x.n")


def dinucleotides(seqs: DataFrame) -> DataFrame:
    """Observed and expected percentages of pairs; the expectation leaves the last base of a sequence out."""
    pairs = pair_counts(seqs).filter("n > 0")
    first = pairs.groupBy(F.substring("word", 1, 1).alias("base")).agg(F.sum("n").alias("m"))
    total = F.sum("n").over(Window.partitionBy())
    observed = pairs.withColumn("total", total)
    a, b = first.select(F.col("base").alias("b1"), F.col("m").alias("m1")), first.select(F.col("base").alias("b2"), F.col("m").alias("m2"))
    return (
        observed.withColumn("b1", F.substring("word", 1, 1)).withColumn("b2", F.substring("word", 2, 1)).join(a, "b1").join(b, "b2")
        .select("word", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("observed"), F.round(100 * (F.col("m1") / F.col("total")) * (F.col("m2") / F.col("total")), 6).alias("expected"))
    )


def codon_usage(seqs: DataFrame, frame: int = 0) -> DataFrame:
    """Codons of a frame, their amino acids and shares among the codons of the acid."""
    counts = seqs.select(F.explode(S.codons(F.col("seq"), frame)).alias("codon")).filter(F.col("codon").rlike("^[ACGT]{3}$")).groupBy("codon").agg(F.count("*").alias("n"))
    acid = counts.withColumn("acid", S.amino_acid(F.col("codon")))
    return acid.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("acid")), 6))


def codon_marginals(usage: DataFrame) -> DataFrame:
    """Counts of bases by place in the codon."""
    places = usage.select("n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("place"), "codon")
    return places.groupBy("place", F.substring("codon", F.col("place"), F.lit(1)).alias("base")).agg(F.sum("n").alias("n"))


def composition_windows(seqs: DataFrame, letters: str, width: int) -> DataFrame:
    """Centred running counts of some bases; sums are partial at the edges (F1)."""
    half = width // 2
    scored = words(seqs, 1).withColumn("score", F.col("word").isin(list(letters)).cast("int"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(-half, half)
    return scored.select("id", "pos", F.sum("score").over(w).alias("score"))


def composition_peaks(seqs: DataFrame, letters: str, width: int) -> DataFrame:
    """The best full window of each sequence: the first with the largest count."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return composition_windows(seqs, letters, width).withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "pos", "score")


def open_frames(seqs: DataFrame, min_codons: int) -> DataFrame:
    """Stretches without stops in the three frames; no start codon is asked for (S30: I45, I47).

    ``low`` and ``high`` are 1-based and count the codons before the stop, ``codons`` counts the stop too. Frames
    are cut inside the task that reads a sequence, nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, ends in slices(batch):
                a, b, c = (np.append(codes, [0, 0])[i : i + len(codes)] for i in range(3))
                text = text_numbers(ends)
                stop = (a == ord("T")) & (((b == ord("A")) & ((c == ord("A")) | (c == ord("G")))) | ((b == ord("G")) & (c == ord("A")))) & (np.arange(len(codes)) + 3 <= ends[1:][text])
                at = np.flatnonzero(stop)
                of, place = text[at], at - ends[text[at]]
                for frame in range(3):
                    own = place % 3 == frame
                    total = np.maximum(np.diff(ends) - frame, 0) // 3
                    # each text's stops, in codons, and the end of its last stretch behind them
                    which = np.concatenate([of[own], np.arange(len(total))])
                    until, last = np.concatenate([(place[own] - frame) // 3, total]), np.concatenate([np.zeros(own.sum(), np.int64), np.ones(len(total), np.int64)])
                    order = np.lexsort((last, until, which))
                    which, until, last = which[order], until[order], last[order]
                    before = np.concatenate([[0], until[:-1] + 1])
                    before[firsts(which)] = 0
                    codons = until - before + 1 - last
                    hit = np.flatnonzero(codons > min_codons)
                    if len(hit):
                        low, high = before[hit] * 3 + 1 + frame, until[hit] * 3 + frame
                        yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(which[hit])), pa.array(np.full(len(hit), frame, np.int32)), pa.array(low), pa.array(high), pa.array(codons[hit].astype(np.int32))], ["id", "frame", "low", "high", "codons"])

    return seqs.filter("seq is not null").select("id", "seq").mapInArrow(run, f"id {seqs.schema['id'].dataType.simpleString()}, frame int, low bigint, high bigint, codons int")


def stop_codons(seqs: DataFrame) -> DataFrame:
    """Stops by frame and strand."""
    both = seqs.select("id", F.lit("+").alias("strand"), "seq").unionByName(seqs.select("id", F.lit("-").alias("strand"), S.reverse_complement(F.col("seq")).alias("seq")))
    frames = [F.struct(F.lit(f).alias("frame"), F.size(F.filter(S.codons(F.col("seq"), f), lambda c: c.isin("TAA", "TAG", "TGA"))).alias("stops")) for f in range(3)]
    return both.select("id", "strand", F.explode(F.array(*frames)).alias("x")).select("id", "strand", "x.frame", "x.stops")


#: Enzymes, recognition sites and the cut's place in the site.
ENZYMES = [("EcoRI", "GAATTC", 1), ("BamHI", "GGATCC", 1), ("HindIII", "AAGCTT", 1), ("AluI", "AGCT", 2), ("HaeIII", "GGCC", 2), ("TaqI", "TCGA", 1), ("RsaI", "GTAC", 2)]


def restriction_sites(seqs: DataFrame) -> DataFrame:
    """Every site of every enzyme; cuts are 1-based.

    A split at the sites of each enzyme inside the row: no join of enzymes with positions.
    """
    def cuts(name: str, site: str, cut: int) -> Column:
        before = F.split("seq", f"(?={site})")  # pieces begin at sites, all but the first
        ends = F.aggregate(
            F.slice(before, 1, F.size(before) - 1),
            F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(x))).alias("all")),
            lambda s: s["all"],
        )
        places = F.when(F.startswith(F.col("seq"), F.lit(site)), F.concat(F.array(F.lit(1)), ends)).otherwise(ends)
        found = F.when(F.contains(F.col("seq"), F.lit(site)), F.array_distinct(places)).otherwise(F.array().cast("array<int>"))
        return F.transform(found, lambda i: F.struct(F.lit(name).alias("enzyme"), (i + cut).alias("cut")))

    return seqs.select("id", F.length("seq").alias("length"), F.explode(F.concat(*[cuts(*e) for e in ENZYMES])).alias("x")).select("id", "length", "x.enzyme", "x.cut")


def fragments(sites: DataFrame) -> DataFrame:
    """Fragment lengths between the ordered cuts of a linear sequence: n + 1 pieces."""
    w = Window.partitionBy("id", "enzyme").orderBy("cut")
    inner = sites.select("id", "enzyme", "cut", (F.col("cut") - F.coalesce(F.lag("cut").over(w), F.lit(1))).alias("size"))
    last = sites.groupBy("id", "enzyme").agg((F.max("length") - F.max("cut") + 1).alias("size"), (F.max("length") + 1).alias("cut"))
    return inner.unionByName(last.select("id", "enzyme", "cut", "size"))


def inexact_matches(seqs: DataFrame, pattern: str, min_match: int) -> DataFrame:
    """1-based places where at least ``min_match`` letters of the pattern agree (S8: I30, C21, C22)."""
    at = words(seqs, len(pattern))
    score = sum((F.substring("word", i + 1, 1) == c).cast("int") for i, c in enumerate(pattern) if c != "N")
    return at.select("id", (F.col("pos") + 1).alias("pos"), score.alias("score")).filter(F.col("score") >= min_match)


def best_matches(seqs: DataFrame, pattern: str, min_match: int) -> DataFrame:
    """The first best place of each sequence (I32)."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return inexact_matches(seqs, pattern, min_match).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def matrix_hits(seqs: DataFrame, weights: list[dict[str, int]], least: int, mark: int = 0) -> DataFrame:
    """Places whose sum of column weights reaches ``least``, marked at ``mark`` (S16: I53, I56)."""
    at = words(seqs, len(weights))
    score: Column = F.lit(0)
    for i, column in enumerate(weights):
        score = score + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in column.items() for x in kv]), F.substring("word", i + 1, 1)), F.lit(0))
    return at.select("id", (F.col("pos") + mark).alias("pos"), score.alias("score")).filter(F.col("score") >= least)


def pad_map(padded: DataFrame) -> DataFrame:
    """Padded and unpadded place of each base."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return words(padded, 1).withColumn("unpadded", F.sum((F.col("word") != "*").cast("int")).over(w)).filter("word <> '*'").select("id", (F.col("pos") + 1).alias("padded"), "unpadded")


def cigars(padded: DataFrame) -> DataFrame:
    """Padded CIGAR of each read: runs of bases are M, runs of pads D, a last run of pads is dropped."""
    runs = F.regexp_extract_all(F.regexp_replace("seq", r"\*+$", ""), F.lit(r"([^*]+|\*+)"), 1)
    one = F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.when(r.startswith("*"), "D").otherwise("M")))
    return padded.select("id", F.array_join(one, "").alias("cigar"))
