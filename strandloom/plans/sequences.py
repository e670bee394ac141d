"""Queries over sequences: composition, codons, frames, sites, words, matches; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import composition as C
from strandloom.operators import joins
from strandloom.operators import kmers as K
from strandloom.operators import lists
from strandloom.sources import adapters as A

SEQ = f"WITH {A.SEQ} "
BOTH = f"WITH {A.SEQ}, {A.BENCH} "
IUB_SQL = f"'{S.IUB}', '{S.IUB_COMPLEMENT}'"
CODE = S.GENETIC_CODE
TRIPLET = "instr('TCAG', substr({c}, 1, 1)) * 16 + instr('TCAG', substr({c}, 2, 1)) * 4 + instr('TCAG', substr({c}, 3, 1)) - 20"


def words_sql(k: int, source: str = "seqs", name: str = "words") -> str:
    return f"{name} AS (SELECT id, pos, substr(seq, pos + 1, {k}) AS word FROM (SELECT id, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM {source} WHERE length(seq) >= {k}))"


def codons_sql(frame: int = 0) -> str:
    return f"codon AS (SELECT id, i, substr(seq, CAST(i * 3 + 1 + {frame} AS BIGINT), 3) AS codon FROM (SELECT id, seq, unnest(range(0, CAST(floor((length(seq) - {frame}) / 3) AS BIGINT))) AS i FROM seqs))"


MATRIX = [{"A": 3, "G": 1}, {"C": 2, "T": 1}, {"A": 2, "C": 2}, {"G": 4}, {"T": 3, "A": 1}, {"A": 1, "C": 1, "G": 1}]


def matrix_sql() -> str:
    return " + ".join("CASE substr(word, %d, 1) %s ELSE 0 END" % (i + 1, " ".join(f"WHEN '{b}' THEN {w}" for b, w in column.items())) for i, column in enumerate(MATRIX))


def frames_sql(frame: int, least: int) -> str:
    return f"""SELECT id, {frame} AS frame, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, codons FROM (
      SELECT id, min(i) * 3 + 1 + {frame} AS low, min(i) * 3 + {frame} + 3 * count(*) FILTER (WHERE NOT stop) AS high, count(*) AS codons FROM (
        SELECT id, i, stop, coalesce(sum(stop::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (
          SELECT id, i, substr(seq, CAST(i * 3 + 1 + {frame} AS BIGINT), 3) IN ('TAA', 'TAG', 'TGA') AS stop FROM (SELECT id, seq, unnest(range(0, CAST(floor((length(seq) - {frame}) / 3) AS BIGINT))) AS i FROM seqs)))
      GROUP BY id, run) WHERE codons > {least}"""


#: Shared words of both strands, those in over 30 places left out, and their runs along diagonals.
BLOCKS = SEQ + ", known AS (SELECT id, seq FROM seqs WHERE length(seq) >= 50), turned AS (SELECT id, '+' AS strand, seq FROM known UNION ALL SELECT id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM known)" + """
, w AS (SELECT id, strand, pos, substr(seq, pos + 1, 12) AS word FROM (SELECT id, strand, seq, unnest(range(0, length(seq) - 11)) AS pos FROM turned))
, rare AS (SELECT word FROM w WHERE strand = '+' GROUP BY 1 HAVING count(*) <= 30)
, h AS (SELECT a.id AS id1, b.id AS id2, b.strand, a.pos AS p1, b.pos AS p2 FROM w a JOIN rare USING (word) JOIN w b USING (word) WHERE a.strand = '+' AND a.id < b.id)
, i AS (SELECT *, p1 - row_number() OVER (PARTITION BY id1, id2, strand, p1 - p2 ORDER BY p1) AS island FROM h)
, block AS (SELECT id1, id2, strand, min(p1) AS pos1, min(p2) AS pos2, count(*) + 11 AS length FROM i GROUP BY id1, id2, strand, p1 - p2, island HAVING count(*) + 11 >= 20)
"""


def _blocks(s, d):
    return joins.seed_blocks(A.seq(s, d).filter("length(seq) >= 50"), 12, 30, 20)


QUERIES = {
    # an alignment with traceback is no SQL: tests/test_joins.py has a plain version; d12 and d25 have SQL for what leads to it
    "d11_internal_joins": (lambda s, d: joins.internal_joins(A.seq(s, d)), None),
    "d12_seed_blocks": (lambda s, d: _blocks(s, d), BLOCKS + "SELECT id1, id2, strand, pos1, pos2, length FROM block"),
    "d25_candidate_pairs": (
        lambda s, d: joins.candidates(_blocks(s, d)),
        BLOCKS + "SELECT id1, id2, strand, count(*) AS blocks, max(length) AS longest, CAST(sum(length) AS BIGINT) AS bases, min(pos1 - pos2) AS least_diagonal, max(pos1 - pos2) AS largest_diagonal FROM block GROUP BY 1, 2, 3",
    ),
    "i2_reverse_complement": (lambda s, d: A.seq(s, d).select("id", S.reverse_complement(F.col("seq")).alias("seq")), SEQ + f"SELECT id, reverse(translate(seq, {IUB_SQL})) AS seq FROM seqs"),
    "i4_complement": (lambda s, d: A.seq(s, d).select("id", S.complement(F.col("seq")).alias("seq")), SEQ + f"SELECT id, translate(seq, {IUB_SQL}) AS seq FROM seqs"),
    "i5_rotate": (
        lambda s, d: A.seq(s, d).filter("length(seq) > 0").select("id", S.rotate(F.col("seq"), F.col("id") + 5).alias("seq")),
        SEQ + "SELECT id, substr(seq, CAST((id + 4) % length(seq) + 1 AS BIGINT)) || substr(seq, 1, CAST((id + 4) % length(seq) AS BIGINT)) AS seq FROM seqs WHERE length(seq) > 0",
    ),
    "i6_depad": (lambda s, d: A.padded(s, d).select("id", S.depad(F.col("seq")).alias("seq")), f"WITH {A.PADDED} SELECT id, replace(seq, '*', '') AS seq FROM padded"),
    "i8_pad_map": (
        lambda s, d: C.pad_map(A.padded(s, d)).groupBy("id").agg(F.max("padded").alias("padded"), F.max("unpadded").alias("unpadded"), F.sum(F.col("padded") - F.col("unpadded")).alias("shift")),
        f"WITH {A.PADDED}, w AS (SELECT id, pos, substr(seq, pos, 1) AS b FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM padded)), m AS (SELECT id, pos, b, sum((b <> '*')::INT) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS u FROM w) SELECT id, max(pos) AS padded, CAST(max(u) AS BIGINT) AS unpadded, CAST(sum(pos - u) AS BIGINT) AS shift FROM m WHERE b <> '*' GROUP BY 1",
    ),
    "i24_identity_with_reverse": (
        lambda s, d: A.seq(s, d).select("id", S.identity_count(F.col("seq"), F.reverse("seq")).alias("same")),
        SEQ + "SELECT id, len(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) = substr(reverse(seq), i, 1))) AS same FROM seqs",
    ),
    "i30_inexact_matches": (
        lambda s, d: C.inexact_matches(A.seq(s, d), "GATTACAG", 7),
        SEQ + ", " + words_sql(8) + ", m AS (SELECT id, pos + 1 AS pos, " + " + ".join(f"(substr(word, {i + 1}, 1) = '{c}')::INT" for i, c in enumerate("GATTACAG")) + " AS score FROM words) SELECT * FROM m WHERE score >= 7",
    ),
    "i32_best_match": (
        lambda s, d: C.best_matches(A.seq(s, d), "GATTACAG", 4),
        SEQ + ", " + words_sql(8) + ", m AS (SELECT id, pos + 1 AS pos, " + " + ".join(f"(substr(word, {i + 1}, 1) = '{c}')::INT" for i, c in enumerate("GATTACAG")) + " AS score FROM words) SELECT id, pos, score FROM m WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) = 1",
    ),
    "i45_open_frames": (lambda s, d: C.open_frames(A.seq(s, d), 30), SEQ + " UNION ALL ".join(frames_sql(f, 30) for f in range(3))),
    "i48_translate": (
        lambda s, d: A.seq(s, d).select("id", S.translate(F.col("seq")).alias("protein")),
        SEQ + ", " + codons_sql() + f", aa AS (SELECT id, i, substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS a FROM codon) SELECT seqs.id, coalesce(string_agg(a, '' ORDER BY i), '') AS protein FROM seqs LEFT JOIN aa ON seqs.id = aa.id GROUP BY seqs.id",
    ),
    "i49_stop_codons": (
        lambda s, d: C.stop_codons(A.seq(s, d)),
        SEQ + f", both_ AS (SELECT id, '+' AS strand, seq FROM seqs UNION ALL SELECT id, '-', reverse(translate(seq, {IUB_SQL})) FROM seqs) "
        + " UNION ALL ".join(f"SELECT id, strand, {f} AS frame, len(list_filter(range(0, CAST(greatest(0, floor((length(seq) - {f}) / 3)) AS BIGINT)), lambda i: substr(seq, i * 3 + 1 + {f}, 3) IN ('TAA', 'TAG', 'TGA'))) AS stops FROM both_" for f in range(3)),
    ),
    "i53_matrix_hits": (
        lambda s, d: C.matrix_hits(A.seq(s, d), MATRIX, 14, 2),
        SEQ + ", " + words_sql(6) + f", m AS (SELECT id, pos + 2 AS pos, {matrix_sql()} AS score FROM words) SELECT * FROM m WHERE score >= 14",
    ),
    "i59_restriction_sites": (
        lambda s, d: C.restriction_sites(A.seq(s, d)).select("id", "enzyme", "cut"),
        SEQ + " UNION ALL ".join(f"SELECT id, '{n}' AS enzyme, p + {c} AS cut FROM (SELECT id, seq, unnest(range(1, length(seq) - {len(t) - 2})) AS p FROM seqs WHERE length(seq) >= {len(t)}) WHERE substr(seq, p, {len(t)}) = '{t}'" for n, t, c in C.ENZYMES),
    ),
    "g15_fragments": (
        lambda s, d: C.fragments(C.restriction_sites(A.seq(s, d))),
        SEQ + ", sites AS (" + " UNION ALL ".join(f"SELECT id, length(seq) AS length, '{n}' AS enzyme, p + {c} AS cut FROM (SELECT id, seq, unnest(range(1, length(seq) - {len(t) - 2})) AS p FROM seqs WHERE length(seq) >= {len(t)}) WHERE substr(seq, p, {len(t)}) = '{t}'" for n, t, c in C.ENZYMES)
        + ") SELECT id, enzyme, cut, cut - coalesce(lag(cut) OVER (PARTITION BY id, enzyme ORDER BY cut), 1) AS size FROM sites UNION ALL SELECT id, enzyme, max(length) + 1, max(length) - max(cut) + 1 FROM sites GROUP BY 1, 2",
    ),
    "i77_melting_temperature": (
        lambda s, d: A.seq(s, d, "benchmark", "item_id").filter("length(seq) > 0").select("id", F.round(S.melting_temperature(F.col("seq")), 5).alias("tm")),
        f"WITH {A.BENCH} SELECT id, round(81.5::DOUBLE + 16.6::DOUBLE * log10(0.05::DOUBLE) + 41.0::DOUBLE * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::DOUBLE / length(seq) - 600.0::DOUBLE / length(seq), 5) AS tm FROM probe WHERE length(seq) > 0",
    ),
    "i79_symmetric_words": (
        lambda s, d: C.words(A.seq(s, d), 10).filter(S.is_symmetric(F.col("word"))).select("id", "pos", "word"),
        SEQ + ", " + words_sql(10) + f"SELECT id, pos, word FROM words WHERE word = reverse(translate(word, {IUB_SQL}))",
    ),
    "i82_longest_run": (
        lambda s, d: A.seq(s, d).select("id", S.longest_run(F.col("seq")).alias("run")),
        SEQ + "SELECT id, coalesce(list_max(list_transform(regexp_extract_all(seq, '(A+|C+|G+|T+)'), lambda x: length(x))), 0) AS run FROM seqs",
    ),
    "e41_base_counts": (
        lambda s, d: C.base_counts(A.seq(s, d)),
        SEQ + ", c AS (SELECT id, length(seq) AS length, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b.lower()}" for b in "ACGT") + " FROM seqs) SELECT *, round((n_g + n_c)::DOUBLE / nullif(length, 0), 6) AS gc, round(n_a * 313.20954::DOUBLE + n_c * 289.18454::DOUBLE + n_g * 329.20894::DOUBLE + n_t * 304.19618::DOUBLE + 1.00794::DOUBLE - 62.97256::DOUBLE, 4) AS mass FROM c",
    ),
    "e44_dinucleotides": (
        lambda s, d: C.dinucleotides(A.seq(s, d)),
        SEQ + ", " + words_sql(2) + ", p AS (SELECT word, count(*) AS n FROM words GROUP BY 1), t AS (SELECT sum(n) AS total FROM p), f AS (SELECT substr(word, 1, 1) AS b, sum(n) AS m FROM p GROUP BY 1) SELECT word, n, round(100 * n / total, 6) AS observed, round(100 * (x.m / total) * (y.m / total), 6) AS expected FROM p, t, f x, f y WHERE x.b = substr(word, 1, 1) AND y.b = substr(word, 2, 1)",
    ),
    "e46_codon_usage": (
        lambda s, d: C.codon_usage(A.seq(s, d)),
        SEQ + ", " + codons_sql() + f", u AS (SELECT codon, count(*) AS n, substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS acid FROM codon GROUP BY 1) SELECT codon, n, acid, round(100 * n / sum(n) OVER (PARTITION BY acid), 6) AS share FROM u",
    ),
    "e48_codon_marginals": (
        lambda s, d: C.codon_marginals(C.codon_usage(A.seq(s, d))),
        SEQ + ", " + codons_sql() + " SELECT place, substr(codon, place, 1) AS base, count(*) AS n FROM (SELECT codon, unnest([1, 2, 3]) AS place FROM codon) GROUP BY 1, 2",
    ),
    "f1_composition_peaks": (
        lambda s, d: C.composition_peaks(A.seq(s, d), "GC", 31),
        SEQ + ", " + words_sql(1) + ", r AS (SELECT id, pos, CAST(sum((word IN ('G', 'C'))::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS BIGINT) AS score FROM words) SELECT id, pos, score FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) = 1",
    ),
    "e50_word_counts": (
        lambda s, d: K.word_counts(A.seq(s, d), 8, both=True),
        SEQ + ", " + words_sql(8) + f"SELECT word, count(*) AS n FROM (SELECT word FROM words UNION ALL SELECT reverse(translate(word, {IUB_SQL})) FROM words) GROUP BY 1",
    ),
    "e11_word_uniqueness": (
        lambda s, d: K.count_spectrum(K.word_counts(A.seq(s, d), 12, both=True, cap=255)),
        SEQ + ", " + words_sql(12) + f", c AS (SELECT word, least(count(*), 255) AS n FROM (SELECT word FROM words UNION ALL SELECT reverse(translate(word, {IUB_SQL})) FROM words) GROUP BY 1) SELECT n, count(*) AS words FROM c GROUP BY 1",
    ),
    "e51_common_word_cover": (
        lambda s, d: K.common_word_cover(A.seq(s, d), 12, 40),
        SEQ + ", " + words_sql(12) + ", o AS (SELECT word FROM words GROUP BY 1 HAVING count(*) > 40), h AS (SELECT DISTINCT id, pos FROM words WHERE word IN (SELECT word FROM o)), g AS (SELECT id, coalesce(least(pos - lag(pos) OVER (PARTITION BY id ORDER BY pos), 12), 12) AS adds FROM h) SELECT id, CAST(sum(adds) AS BIGINT) AS covered FROM g GROUP BY 1",
    ),
    "d15_repeats": (
        lambda s, d: K.previous_repeats(A.seq(s, d), 20),
        SEQ + ", " + words_sql(20) + ", c AS (SELECT id, pos, pos - lag(pos) OVER (PARTITION BY id, word ORDER BY pos) AS distance FROM words), i AS (SELECT *, pos - row_number() OVER (PARTITION BY id, distance ORDER BY pos) AS isl FROM c WHERE distance IS NOT NULL) SELECT id, distance, min(pos) + 1 AS pos, count(*) + 19 AS length FROM i GROUP BY id, distance, isl",
    ),
    "d24_exact_matches": (
        lambda s, d: K.exact_matches(A.seq(s, d), A.seq(s, d, "benchmark", "item_id"), 16, 25),
        BOTH + ", " + words_sql(16) + ", " + words_sql(16, "probe", "pw") + ", h AS (SELECT a.id AS id1, b.id AS id2, a.pos AS p1, b.pos AS p2 FROM words a JOIN pw b ON a.word = b.word), i AS (SELECT *, p1 - row_number() OVER (PARTITION BY id1, id2, p1 - p2 ORDER BY p1) AS isl FROM h) SELECT id1, id2, min(p1) + 1 AS pos1, min(p2) + 1 AS pos2, count(*) + 15 AS length FROM i GROUP BY id1, id2, p1 - p2, isl HAVING count(*) + 15 >= 25",
    ),
    "d29_diagonal_scores": (
        lambda s, d: K.exact_matches(A.seq(s, d), A.seq(s, d, "benchmark", "item_id"), 12, 12).groupBy("id2", (F.col("pos1") - F.col("pos2")).alias("diagonal")).agg(F.count("*").alias("n"), F.sum("length").alias("bases")),
        BOTH + ", " + words_sql(12) + ", " + words_sql(12, "probe", "pw") + ", h AS (SELECT a.id AS id1, b.id AS id2, a.pos AS p1, b.pos AS p2 FROM words a JOIN pw b ON a.word = b.word), i AS (SELECT *, p1 - row_number() OVER (PARTITION BY id1, id2, p1 - p2 ORDER BY p1) AS isl FROM h), m AS (SELECT id1, id2, min(p1) - min(p2) AS diagonal, count(*) + 11 AS length FROM i GROUP BY id1, id2, p1 - p2, isl) SELECT id2, diagonal, count(*) AS n, CAST(sum(length) AS BIGINT) AS bases FROM m GROUP BY 1, 2",
    ),
    "d32_screen": (
        lambda s, d: K.screened(A.seq(s, d), A.seq(s, d, "benchmark", "item_id"), 25),
        BOTH + ", " + words_sql(25) + ", " + words_sql(25, "probe", "pw") + "SELECT DISTINCT id FROM words WHERE word IN (SELECT word FROM pw)",
    ),
    "p30_screen_stage": (
        lambda s, d: A.seq(s, d).select("id").join(K.screened(A.seq(s, d), A.seq(s, d, "benchmark", "item_id"), 25).withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("failed")).groupBy("failed").agg(F.count("*").alias("n")),
        BOTH + ", " + words_sql(25) + ", " + words_sql(25, "probe", "pw") + ", bad AS (SELECT DISTINCT id FROM words WHERE word IN (SELECT word FROM pw)) SELECT id IN (SELECT id FROM bad) AS failed, count(*) AS n FROM seqs GROUP BY 1",
    ),
    "d22_word_significance": (
        lambda s, d: K.significant_hits(A.seq(s, d), 8),
        SEQ + ", c AS (SELECT id, length(seq) AS n, (power(length(replace(seq, 'A', '')) - length(seq), 2) + power(length(replace(seq, 'C', '')) - length(seq), 2) + power(length(replace(seq, 'G', '')) - length(seq), 2) + power(length(replace(seq, 'T', '')) - length(seq), 2)) / power(length(seq), 2) AS p FROM seqs WHERE length(seq) >= 8) SELECT id, round(log10(power(p, 8)), 6) AS log_chance, round(power(p, 8) * n, 9) AS expected FROM c",
    ),
    "b4_cigars": (
        lambda s, d: C.cigars(A.padded(s, d)),
        f"WITH {A.PADDED} SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_replace(seq, '\\*+$', ''), '([^*]+|\\*+)'), lambda r: CAST(length(r) AS VARCHAR) || CASE WHEN r[1] = '*' THEN 'D' ELSE 'M' END), '') AS cigar FROM padded",
    ),
    "b7_fastq": (
        lambda s, d: lists.fastq(A.padded(s, d), "id", "seq", F.repeat(F.lit("I"), F.length(S.depad(F.col("seq"))))),
        f"WITH {A.PADDED} SELECT '@' || id || chr(10) || replace(seq, '*', '') || chr(10) || '+' || chr(10) || repeat('I', length(replace(seq, '*', ''))) AS value FROM padded",
    ),
    "b8_fasta": (
        lambda s, d: lists.fasta(A.seq(s, d), "id", "seq"),
        SEQ + "SELECT id, '>' || id || chr(10) || array_to_string(list_transform(range(0, greatest(1, CAST(ceil(length(seq) / 60) AS BIGINT))), lambda i: substr(seq, i * 60 + 1, 60)), chr(10)) AS value FROM seqs",
    ),
}
