"""Words of sequences: counts, uniqueness, repeats, exact matches along diagonals, screening."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions.arrays import firsts, slices, text_numbers

from . import joins
from .composition import words


def word_counts(seqs: DataFrame, k: int, both: bool = False, cap: int | None = None) -> DataFrame:
    """Counts of words, on both strands if asked; ``cap`` saturates them."""
    counts = words(seqs, k).groupBy("word").agg(F.count("*").alias("n"))
    if both:  # the distinct words are complemented, not every occurrence
        strands = F.array(F.col("word"), S.reverse_complement(F.col("word")))
        counts = counts.select(F.explode(strands).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return counts if cap is None else counts.withColumn("n", F.least("n", F.lit(cap)))


def count_spectrum(counts: DataFrame) -> DataFrame:
    """How many words occur n times."""
    return counts.groupBy("n").agg(F.count("*").alias("words"))


def ids_repeat(seqs: DataFrame) -> bool:
    """Whether two rows have one id, nulls among them; only ids are shuffled."""
    return bool(seqs.groupBy("id").count().filter("count > 1").limit(1).count())


def common_word_cover(seqs: DataFrame, k: int, often: int) -> DataFrame:
    """Positions of each sequence covered by words that occur more than ``often`` times.

    Tasks count words in tables of 4**k, as ``joins.rare_words`` does, and look them up in a broadcast bit a word, so no
    word is shuffled. Words over 12 letters, and tables with other letters than A, C, G and T or with repeated ids, join by word instead.
    """
    repeated = ids_repeat(seqs)
    seqs = seqs.filter("seq is not null")
    if repeated or k > joins.LONGEST_WORD or seqs.filter(F.col("seq").rlike("[^ACGT]")).limit(1).count():
        return _cover_by_join(seqs, k, often)
    shared = seqs.sparkSession.sparkContext.broadcast(joins.word_bits(seqs, k, often, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for rows, letters, ends in joins._letters(batch):
                word, known = joins._words(letters, ends, k)
                hit = np.flatnonzero(known & ((bits[word >> 3] >> (7 - (word & 7)) & 1) > 0))
                if len(hit):
                    text = text_numbers(ends)[hit]
                    begin = firsts(text)
                    adds = np.minimum(np.diff(hit, prepend=-k), k)
                    adds[begin] = k
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows[text[begin]])), pa.array(np.add.reduceat(adds, begin))], ["id", "covered"])

    return seqs.select("id", "seq").mapInArrow(run, f"id {seqs.schema['id'].dataType.simpleString()}, covered bigint")


def _cover_by_join(seqs: DataFrame, k: int, often: int) -> DataFrame:
    """The same by a join; a word in many places splits by adaptive skew handling."""
    at = words(seqs, k)
    common = at.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > often).select("word")
    hits = at.join(common, "word").select("id", "pos")
    w = Window.partitionBy("id").orderBy("pos")
    gap = F.coalesce(F.least(F.col("pos") - F.lag("pos").over(w), F.lit(k)), F.lit(k))
    return hits.dropDuplicates().select("id", gap.alias("adds")).groupBy("id").agg(F.sum("adds").alias("covered"))


def word_numbers(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each place, equal where the ``k`` letters from there on are equal; numbers of words of powers of two are put together."""
    known, size, power = np.unique(codes, return_inverse=True)[1], 1, {}
    while True:
        power[size] = known
        if 2 * size > k:
            break
        known = np.unique(known[:-size] * (int(known.max()) + 1) + known[size:], return_inverse=True)[1]
        size *= 2
    n = len(codes) - k + 1
    return power[size][:n] * (int(power[size].max()) + 1) + power[size][k - size : k - size + n]


def previous_repeats(seqs: DataFrame, k: int) -> DataFrame:
    """Exact repeats inside a sequence: maximal runs in which each word has its previous occurrence at one distance.

    Each occurrence meets the one before it, not all others, so a low-complexity sequence stays
    linear; a run's length is the run of words plus k - 1 (D15, D16, D24 on one sequence). A sequence's words
    are sorted inside the task that reads it, nothing is shuffled. Rows of one id are one sequence's: if ids repeat, words meet by id and word.
    """
    if ids_repeat(seqs):
        return _repeats_by_window(seqs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, ends in slices(batch):
                if len(codes) < k:
                    continue
                text = text_numbers(ends)
                pos = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
                if not len(pos):
                    continue
                small = joins.LETTERS[np.minimum(codes, 255)]
                if 2 * k + len(ends).bit_length() <= 62 and (codes < 97).all() and (small < 4).all():
                    key = text[pos] << (2 * k) | joins._words(small, ends, k)[0][pos]
                    order = np.argsort(key, kind="stable")
                else:
                    key = np.unique(word_numbers(codes, k)[pos], return_inverse=True)[1]
                    key = text[pos] * (int(key.max()) + 1) + key
                    order = np.argsort(key, kind="stable")
                same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
                at = pos[order[same + 1]]
                distance, of = at - pos[order[same]], text[at]
                order = np.lexsort((at, distance, of))
                at, distance, of = at[order], distance[order], of[order]
                begin = firsts(of, distance, at - np.arange(len(at)))
                if len(begin):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id").take(pa.array(of[begin])), pa.array(distance[begin].astype(np.int32)), pa.array((at - ends[of] + 1)[begin].astype(np.int32)), pa.array(np.diff(np.append(begin, len(at))) + k - 1)],
                        ["id", "distance", "pos", "length"],
                    )

    return seqs.filter("seq is not null").select("id", "seq").mapInArrow(run, f"id {seqs.schema['id'].dataType.simpleString()}, distance int, pos int, length bigint")


def _repeats_by_window(seqs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id", "word").orderBy("pos")
    chained = words(seqs, k).withColumn("before", F.lag("pos").over(w)).filter("before is not null").withColumn("distance", F.col("pos") - F.col("before"))
    d = Window.partitionBy("id", "distance").orderBy("pos")
    island = chained.withColumn("island", F.col("pos") - F.row_number().over(d))
    return island.groupBy("id", "distance", "island").agg((F.min("pos") + 1).alias("pos"), (F.count("*") + k - 1).alias("length")).select("id", "distance", "pos", "length")


def exact_matches(seqs: DataFrame, probes: DataFrame, k: int, least: int) -> DataFrame:
    """Maximal exact matches between sequences and probes: equal words grouped by diagonal into islands (S38: D24, D27)."""
    a = words(seqs, k).select(F.col("id").alias("id1"), F.col("pos").alias("p1"), "word")
    b = words(probes, k).select(F.col("id").alias("id2"), F.col("pos").alias("p2"), "word")
    hits = met(a, b).withColumn("diagonal", F.col("p1") - F.col("p2"))
    w = Window.partitionBy("id1", "id2", "diagonal").orderBy("p1")
    island = hits.withColumn("island", F.col("p1") - F.row_number().over(w))
    runs = island.groupBy("id1", "id2", "diagonal", "island").agg((F.min("p1") + 1).alias("pos1"), (F.min("p2") + 1).alias("pos2"), (F.count("*") + k - 1).alias("length"))
    return runs.filter(F.col("length") >= least).select("id1", "id2", "pos1", "pos2", "length")


def screened(seqs: DataFrame, probes: DataFrame, min_match: int) -> DataFrame:
    """Ids of sequences with an exact match of ``min_match`` bases to any probe."""
    bad = words(probes, min_match).select("word").distinct()
    return met(words(seqs, min_match), bad, "left_semi").select("id").distinct()


def word_probability(counts: DataFrame, k: int) -> Column:
    return F.pow(F.sum(F.pow(F.col("share"), 2)), F.lit(k))


def significant_hits(seqs: DataFrame, k: int, max_prob: float = 1e-6) -> DataFrame:
    """Chance of a word match at one place, and the expected matches of each sequence with itself."""
    counts = [S.count_letter(F.col("seq"), b) for b in "ACGT"]
    total = sum(counts[1:], counts[0])
    p = sum((F.pow(c / F.nullif(total, F.lit(0)), F.lit(2)) for c in counts[1:]), F.pow(counts[0] / F.nullif(total, F.lit(0)), F.lit(2)))
    chance = F.pow(p, F.lit(k))
    return seqs.filter(F.length("seq") >= k).select("id", F.round(F.log10(chance), 6).alias("log_chance"), F.round(chance * F.length("seq"), 9).alias("expected"))


def diagonal_hits(seqs: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Equal words by pair of sequences and diagonal, len1 - p1 + p2 - 1, with both lengths and the chance p that two bases agree."""
    shares = sum((F.pow(S.count_letter(F.col("seq"), b), F.lit(2)) for b in "CGT"), F.pow(S.count_letter(F.col("seq"), "A"), F.lit(2))) / F.pow(F.length("seq"), F.lit(2))
    a = words(seqs.filter("length(seq) > 0").withColumn("len1", F.length("seq")).withColumn("p", shares), k, ["id", "len1", "p"]).withColumnsRenamed({"id": "id1", "pos": "p1"})
    b = words(probes.withColumn("len2", F.length("seq")), k, ["id", "len2"]).withColumnsRenamed({"id": "id2", "pos": "p2"})
    diagonal = F.col("len1") - F.col("p1") + F.col("p2") - 1
    return met(a, b).groupBy("id1", "id2", diagonal.alias("diagonal"), "len1", "len2", "p").agg(F.count("*").alias("n"))


def intercepts(diagonal: Column, len1: Column) -> list[Column]:
    """Where a diagonal meets the axes, x along the first sequence."""
    inside = diagonal < len1
    return [F.when(inside, len1 - diagonal - 1).otherwise(0).alias("x"), F.when(inside, 0).otherwise(diagonal + 1 - len1).alias("y")]


def significant_diagonals(hits: DataFrame, k: int, max_prob: float) -> DataFrame:
    """Diagonals whose hits are over chance (S31: D22): the Poisson tail with the diagonal's length times p**k as mean.

    Each term of the tail is the one before it times mean / hits.
    """
    length = F.least(F.col("diagonal") + 1, F.col("len1"), F.col("len2"), F.col("len1") + F.col("len2") - 1 - F.col("diagonal"))
    start = F.struct(F.exp(-F.col("mean")).alias("term"), F.exp(-F.col("mean")).alias("total"))
    more = lambda s, i: F.struct((s["term"] * F.col("mean") / i).alias("term"), (s["total"] + s["term"] * F.col("mean") / i).alias("total"))
    places = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(places, start, more, lambda s: s["total"])
    return hits.withColumn("length", length).withColumn("mean", F.col("length") * F.pow(F.col("p"), F.lit(k))).withColumn("chance", F.greatest(1 - below, F.lit(0.0))).filter(F.col("chance") < max_prob)


def best_intercepts(diagonals: DataFrame) -> DataFrame:
    """One diagonal of each pair and where it meets the axes (D23): id1, id2, diagonal, x, y.

    The diagonals' centre is weighted by hits over length; the one furthest from it goes (of equally
    far ones the smallest), and again from a new centre, until one is left. A pair's significant
    diagonals are few, they come together in one row.
    """
    own = diagonals.groupBy("id1", "id2").agg(F.max("len1").alias("len1"), F.array_sort(F.collect_list(F.struct(F.col("diagonal").alias("d"), (F.col("n") / F.col("length")).alias("s")))).alias("ds"))
    total = lambda left, f: F.aggregate(left, F.lit(0.0), lambda acc, x: acc + f(x))

    def fewer(left: Column, _: Column) -> Column:
        centre = total(left, lambda x: x["d"] * x["s"]) / total(left, lambda x: x["s"])
        far = F.transform(F.array(centre), lambda c: F.transform(left, lambda x: F.abs(c - x["d"])))[0]
        place = F.transform(F.array(far), lambda f: F.array_position(f, F.array_max(f)))[0]
        return F.transform(F.array(place), lambda p: F.filter(left, lambda x, i: i + 1 != p))[0]

    rounds = F.when(F.size("ds") > 1, F.sequence(F.lit(1), F.size("ds") - 1)).otherwise(F.array().cast("array<int>"))
    one = own.withColumn("diagonal", F.aggregate(rounds, F.col("ds"), fewer)[0]["d"])
    return one.select("id1", "id2", "diagonal", *intercepts(F.col("diagonal"), F.col("len1")))


def diagonal_zscores(hits: DataFrame, least: float = 3.0) -> DataFrame:
    """Diagonals with a z-score of ``least`` or more among the diagonals of their pair that have hits."""
    sums = hits.groupBy("id1", "id2").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    # z is a quotient of whole numbers, k * n - s, and the root of one, so a score of exactly ``least`` is not lost to rounding
    spread = F.col("k") * F.col("q") - F.col("s") * F.col("s")
    stats = sums.withColumn("spread", spread).filter("spread > 0").select("id1", "id2", "k", "s", "spread")
    z = (F.col("k") * F.col("n") - F.col("s")) / F.sqrt("spread")
    return hits.join(stats, ["id1", "id2"]).filter(z >= least).select("id1", "id2", "diagonal", "n", F.round(z, 5).alias("z"))


def met(a: DataFrame, b: DataFrame, how: str = "inner", most_rows: int = 2_000_000) -> DataFrame:
    """A join by word; ``b`` is broadcast if its measured rows are within ``most_rows``, so the words of ``a`` need no shuffle."""
    return a.join(F.broadcast(b) if b.limit(most_rows + 1).count() <= most_rows else b, "word", how)
