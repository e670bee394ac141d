"""Column functions on sequences: complement, pads, ambiguity, translation, matching, melting temperature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import slices, texts_of

#: IUB codes and their complements, in the same order.
IUB = "ACGTRYMKSWBDHVN*-acgtrymkswbdhvn"
IUB_COMPLEMENT = "TGCAYRKMSWVHDBN*-tgcayrkmswvhdbn"
#: The ambiguity code of each set of bases, indexed by 8A + 4C + 2G + T.
AMBIGUITY = "nTGKCYSBAWRDMHVN"
#: The standard genetic code, codons in the order T, C, A, G of each place.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Average molecular masses of the nucleotides, and of the hydrogen that a strand has and the phosphate that it lacks.
MASS = {"A": 313.20954, "C": 289.18454, "G": 329.20894, "T": 304.19618}
HYDROGEN, PHOSPHATE = 1.00794, 62.97256


def complement(s: Column) -> Column:
    """I1, I4."""
    return F.translate(s, IUB, IUB_COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    """I2."""
    return F.reverse(complement(s))


def rotate(s: Column, origin: Column) -> Column:
    """A circular sequence from a new 1-based origin, modulo its length."""
    at = F.coalesce(F.pmod(origin - 1, F.nullif(F.length(s), F.lit(0))), F.lit(0))  # an empty one has one origin only
    return F.concat(F.substring(s, at + 1, F.length(s)), F.substring(s, F.lit(1), at))


def depad(s: Column) -> Column:
    """I6."""
    return F.replace(s, F.lit("*"), F.lit(""))


def ambiguity_code(a: Column, c: Column, g: Column, t: Column) -> Column:
    """The code of the bases that are present."""
    index = a.cast("int") * 8 + c.cast("int") * 4 + g.cast("int") * 2 + t.cast("int")
    return F.substring(F.lit(AMBIGUITY), index + 1, F.lit(1))


def codon_index(codon: Column) -> Column:
    """0..63 in the order of the genetic code; null for codons with other letters."""
    digit = lambda i: F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) - 1
    return F.when(codon.rlike("^[ACGT]{3}$"), digit(1) * 16 + digit(2) * 4 + digit(3))


def amino_acid(codon: Column, code: str = GENETIC_CODE) -> Column:
    """One letter, '-' for codons with other letters."""
    return F.coalesce(F.substring(F.lit(code), codon_index(codon) + 1, F.lit(1)), F.lit("-"))


def codons(s: Column, frame: int = 0) -> Column:
    """The whole codons of a frame, as an array."""
    return F.regexp_extract_all(F.substring(s, frame + 1, 1 << 30), F.lit("(.{3})"), 1)


def _proteins(code: str):
    """Amino acids of texts, whole codons from their beginnings on, as arrays."""
    acids = np.array([ord(c) for c in code + "-"], np.uint32)
    digit = np.full(256, 64, np.int64)
    digit[[ord(c) for c in "TCAG"]] = range(4)

    def run(texts: pa.Array) -> pa.Array:
        out: list = []
        for rows, codes, ends in slices(pa.RecordBatch.from_arrays([texts.fill_null("")], ["seq"])):
            d, n = digit[np.minimum(codes, 255)], np.diff(ends) // 3
            first = np.repeat(ends[:-1], n) + 3 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            codon = d[first] * 16 + d[first + 1] * 4 + d[first + 2]
            known = (d[first] < 4) & (d[first + 1] < 4) & (d[first + 2] < 4)
            out += texts_of(acids[np.where(known, codon, 64)], np.concatenate([[0], np.cumsum(n)]))
        return pa.array(out, pa.string())

    return run


def translate(s: Column, frame: int = 0) -> Column:
    """Amino acids of the whole codons of a frame, codons with other letters '-', as arrays inside tasks."""
    run = _proteins(GENETIC_CODE)

    @F.arrow_udf("string")
    def proteins(texts: pa.Array) -> pa.Array:
        return run(texts)

    return F.when(s.isNotNull(), proteins(F.substring(s, frame + 1, 1 << 30)))


def identity_count(a: Column, b: Column) -> Column:
    """Positions with equal letters, whatever their case."""
    pairs = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: (x == y) & (x != ""))
    return F.size(F.filter(pairs, lambda same: F.coalesce(same, F.lit(False))))


def count_letter(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def gc_content(s: Column) -> Column:
    return (count_letter(s, "G") + count_letter(s, "C")) / F.nullif(F.length(s), F.lit(0))


def melting_temperature(s: Column, salt: float = 50.0) -> Column:
    """The formula for long primers."""
    return F.lit(81.5) + F.lit(16.6) * F.log10(F.lit(salt / 1000)) + F.lit(41.0) * gc_content(s) - F.lit(600.0) / F.nullif(F.length(s), F.lit(0))


def mass(s: Column) -> Column:
    """The mass of a single strand (I64)."""
    return sum((count_letter(s, b) * F.lit(m) for b, m in MASS.items()), F.lit(HYDROGEN - PHOSPHATE))


def is_symmetric(s: Column) -> Column:
    """Whether a sequence is its own reverse complement."""
    return s == reverse_complement(s)


def longest_run(s: Column) -> Column:
    """The longest stretch of one base."""
    runs = F.regexp_extract_all(s, F.lit("(A+|C+|G+|T+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def bam_bin(low: Column, high: Column) -> Column:
    """The smallest bin of the five-level index that holds [low, high)."""
    last = high - 1
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(low, shift) == F.shiftright(last, shift), F.shiftright(low, shift) + offset).otherwise(out)
    return out
