"""Queries on ambiguity, pads, codes, probabilities and notes, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import composition as C
from strandloom.operators import lists, ranges
from strandloom.operators import matching as M
from strandloom.sources import adapters as A

from .sequences import CODE, IUB_SQL, MATRIX, SEQ, TRIPLET, codons_sql, frames_sql, matrix_sql, words_sql

PADDED = f"WITH {A.PADDED} "
BITS = f"greatest(0, instr('{S.AMBIGUITY}', {{c}}) - 1)"
LETTERS = "letters AS (SELECT DISTINCT upper(substr(p_name, CAST(1 + p_partkey % 5 AS BIGINT), 1)) AS code FROM part)"
IUB_WORD = "GRYNAT"
EDITED = M.edited_code({"TGA": "W", "ATA": "M"})


def _letters(s, d):
    return A.table(s, d, "part").select(F.upper(F.expr("substring(p_name, cast(1 + p_partkey % 5 as int), 1)")).alias("code")).distinct()


def iub_score_sql(word: str) -> str:
    return " + ".join(f"(substr(word, {i + 1}, 1) IN ({', '.join(repr(x) for x in M.compatible(c))}))::INT" for i, c in enumerate(word))


def _distribution(s, d):
    shares = M.base_shares(A.seq(s, d))
    return M.score_distribution(shares, np.eye(4, dtype=int), 11)


def _rows(s, values, name):
    return s.createDataFrame([(i, round(float(v), 9)) for i, v in enumerate(values)], f"score int, {name} double")


BINOMIAL = f"""WITH {A.SEQ}, n AS (SELECT {', '.join(f"sum(length(seq) - length(replace(seq, '{b}', '')))::DOUBLE AS {b.lower()}" for b in 'ACGT')} FROM seqs),
p AS (SELECT (a * a + c * c + g * g + t * t) / power(a + c + g + t, 2) AS p FROM n), dist AS (SELECT k, (factorial(11) / (factorial(k) * factorial(11 - k)))::DOUBLE * power(p, k) * power(1 - p, 11 - k) AS v FROM p, (SELECT unnest(range(0, 12))::INT AS k)) """
NOTES = """notes AS (SELECT event_id, upper(substr(event_type, 1, 4)) AS type, date_trunc('second', ts) AS created, date_trunc('second', ts) + INTERVAL 90 MINUTE AS changed, 'by ' || user_id AS text FROM events)"""


def _notes(s, d):
    t = F.date_trunc("second", F.col("ts"))
    return A.table(s, d, "events").select("event_id", F.upper(F.substring("event_type", 1, 4)).alias("type"), t.alias("created"), (t + F.expr("interval 90 minutes")).alias("changed"), F.concat(F.lit("by "), "user_id").alias("text"))


def _note(s, d):
    return _notes(s, d).select("event_id", M.note_text(F.col("type"), F.col("created"), F.col("changed"), F.col("text")).alias("note"))


QUERIES = {
    "i1_complement_letters": (lambda s, d: _letters(s, d).select("code", S.complement(F.col("code")).alias("complement")), f"WITH {LETTERS} SELECT code, translate(code, {IUB_SQL}) AS complement FROM letters"),
    "i3_reverse": (lambda s, d: A.seq(s, d).select("id", F.reverse("seq").alias("seq")), SEQ + "SELECT id, reverse(seq) AS seq FROM seqs"),
    "i7_depad_lengths": (
        lambda s, d: A.padded(s, d).select("id", F.length("seq").alias("padded"), F.length(S.depad(F.col("seq"))).alias("unpadded"), F.size(F.regexp_extract_all("seq", F.lit(r"(\*+)"), 1)).alias("gaps")),
        PADDED + "SELECT id, length(seq) AS padded, length(replace(seq, '*', '')) AS unpadded, len(regexp_extract_all(seq, '\\*+')) AS gaps FROM padded",
    ),
    "i9_unpadded_to_padded": (
        lambda s, d: C.pad_map(A.padded(s, d)).filter("unpadded % 40 = 1"),
        PADDED + ", b AS (SELECT id, pos AS padded, substr(seq, pos, 1) AS c FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM padded)), u AS (SELECT id, padded, row_number() OVER (PARTITION BY id ORDER BY padded) AS unpadded FROM b WHERE c <> '*') SELECT id, padded, unpadded FROM u WHERE unpadded % 40 = 1",
    ),
    "i12_repad": (lambda s, d: M.repadded(A.padded(s, d).select("id", S.depad(F.col("seq")).alias("seq")), M.gap_lists(A.padded(s, d))), PADDED + "SELECT id, seq FROM padded"),
    "i16_base_at_position": (
        lambda s, d: A.seq(s, d).filter("length(seq) > 30").select("id", M.base_at(F.col("seq"), (F.col("id") % 30 + 1).cast("int"), F.col("id") % 2 == 1).alias("base")),
        SEQ + f"SELECT id, CASE WHEN id % 2 = 1 THEN translate(substr(seq, CAST(length(seq) - id % 30 AS BIGINT), 1), {IUB_SQL}) ELSE substr(seq, CAST(id % 30 + 1 AS BIGINT), 1) END AS base FROM seqs WHERE length(seq) > 30",
    ),
    "i18_orient_positions": (
        lambda s, d: A.item(s, d).select("rec", F.when(F.col("comp"), F.col("length") - F.col("lclip") + 1).otherwise(F.col("lclip")).alias("place")),
        f"WITH {A.ITEM} SELECT rec, CASE WHEN comp THEN length - lclip + 1 ELSE lclip END AS place FROM item",
    ),
    "i19_oriented_quality": (
        lambda s, d: A.item(s, d).withColumn("q", F.transform(F.sequence("start", "end"), lambda p: ((F.col("rec") * 7 + p * 3) % 41).cast("int"))).withColumn("q", F.when(F.col("comp"), F.reverse("q")).otherwise(F.col("q"))).select("rec", F.element_at("q", 1).alias("first"), F.element_at("q", -1).alias("last")),
        f'WITH {A.ITEM} SELECT rec, CAST((rec * 7 + (CASE WHEN comp THEN "end" ELSE "start" END) * 3) % 41 AS INT) AS first, CAST((rec * 7 + (CASE WHEN comp THEN "start" ELSE "end" END) * 3) % 41 AS INT) AS last FROM item',
    ),
    "i20_ambiguity_codes": (
        lambda s, d: A.seq(s, d).select("id", S.ambiguity_code(*[F.contains(F.substring("seq", 1, 5), F.lit(b)) for b in "ACGT"]).alias("code")),
        SEQ + f"SELECT id, substr('{S.AMBIGUITY}', " + " + ".join(f"contains(substr(seq, 1, 5), '{b}')::INT * {8 >> i}" for i, b in enumerate("ACGT")) + " + 1, 1) AS code FROM seqs",
    ),
    "i21_codes_to_bases": (
        lambda s, d: _letters(s, d).select("code", M.bases_of(F.col("code")).alias("bases")),
        f"WITH {LETTERS}, b AS (SELECT code, {BITS.format(c='code')} AS b FROM letters) SELECT code, " + " || ".join(f"CASE WHEN b & {8 >> i} > 0 THEN '{x}' ELSE '' END" for i, x in enumerate("ACGT")) + " AS bases FROM b",
    ),
    "i22_ambiguity_bits": (lambda s, d: _letters(s, d).select("code", M.bits_of(F.col("code")).alias("bits")), f"WITH {LETTERS} SELECT code, {BITS.format(c='code')} AS bits FROM letters"),
    "i23_same_characters": (
        lambda s, d: A.padded(s, d).select("id", M.same_characters(F.col("seq"), F.lower(F.reverse(F.translate("seq", "*", ".")))).alias("same")),
        PADDED + "SELECT id, len(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) = substr(reverse(seq), i, 1))) AS same FROM padded",
    ),
    "i25_iub_identities": (
        lambda s, d: A.seq(s, d).select("id", M.iub_identities(F.col("seq"), F.reverse(F.translate("seq", "AC", "RM"))).alias("same")),
        SEQ + ", x AS (SELECT id, seq AS a, reverse(translate(seq, 'AC', 'RM')) AS b FROM seqs) SELECT id, len(list_filter(range(1, length(a) + 1), lambda i: (" + BITS.format(c="substr(a, i, 1)") + " & " + BITS.format(c="substr(b, i, 1)") + ") > 0)) AS same FROM x",
    ),
    "i26_words_at": (
        lambda s, d: A.seq(s, d).filter(F.substring("seq", 11, 3) == "ATA").select("id"),
        SEQ + "SELECT id FROM seqs WHERE substr(seq, 11, 3) = 'ATA'",
    ),
    "i27_iub_words": (
        lambda s, d: C.words(A.seq(s, d), len(IUB_WORD)).filter(F.col("word").rlike(f"^{M.iub_pattern(IUB_WORD)}$")).groupBy("id").agg(F.count("*").alias("n"), F.min("pos").alias("first")),
        SEQ + ", " + words_sql(len(IUB_WORD)) + f"SELECT id, count(*) AS n, min(pos) AS first FROM words WHERE regexp_full_match(word, '{M.iub_pattern(IUB_WORD)}') GROUP BY 1",
    ),
    "i28_padded_iub_words": (
        lambda s, d: A.padded(s, d).select("id", M.first_place(F.col("seq"), M.iub_pattern(IUB_WORD, True)).alias("place")).filter("place > 0"),
        PADDED + f", m AS (SELECT id, seq, regexp_extract(seq, '{M.iub_pattern(IUB_WORD, True)}') AS hit FROM padded) SELECT id, instr(seq, hit) AS place FROM m WHERE hit <> ''",
    ),
    "i29_match_lengths": (
        lambda s, d: M.match_lengths(A.seq(s, d).select("id", F.col("seq").alias("a"), S.rotate(F.col("seq"), F.lit(2)).alias("b"))).filter("n > 0"),
        SEQ + ", r AS (SELECT id, length(seq) AS l, length(regexp_extract(seq, '^(A+|C+|G+|T+)')) AS run FROM seqs), m AS (SELECT id, CASE WHEN run = l THEN l ELSE run - 1 END AS n FROM r) SELECT id, n FROM m WHERE n > 0",
    ),
    "i31_iub_inexact": (
        lambda s, d: M.iub_inexact(A.seq(s, d), "GATRYWNAC", 9),
        SEQ + ", " + words_sql(9) + ", m AS (SELECT id, pos + 1 AS pos, " + iub_score_sql("GATRYWNAC") + " AS score FROM words) SELECT * FROM m WHERE score >= 9",
    ),
    "i33_padded_inexact": (
        lambda s, d: M.padded_inexact(A.padded(s, d), "GATTACAG", 7),
        PADDED + ", seqs AS (SELECT id, replace(seq, '*', '') AS seq FROM padded), " + words_sql(8) + ", m AS (SELECT id, pos + 1 AS u, " + " + ".join(f"(substr(word, {i + 1}, 1) = '{c}')::INT" for i, c in enumerate("GATTACAG")) + " AS score FROM words), b AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS u FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM padded) WHERE substr(seq, pos, 1) <> '*') SELECT m.id, b.pos AS padded, score FROM m JOIN b ON m.id = b.id AND m.u = b.u WHERE score >= 7",
    ),
    "i34_padded_exact": (
        lambda s, d: A.padded(s, d).select("id", M.first_place(F.col("seq"), r"\**".join("ATACA")).alias("place")).filter("place > 0"),
        PADDED + r", m AS (SELECT id, seq, regexp_extract(seq, 'A\**T\**A\**C\**A') AS hit FROM padded) SELECT id, instr(seq, hit) AS place FROM m WHERE hit <> ''",
    ),
    "i35_within_budget": (
        lambda s, d: C.inexact_matches(A.padded(s, d).select("id", S.depad(F.col("seq")).alias("seq")), "ATACATGA", 6).groupBy("id").agg(F.min("pos").alias("pos")),
        PADDED + ", seqs AS (SELECT id, replace(seq, '*', '') AS seq FROM padded), " + words_sql(8) + ", m AS (SELECT id, pos + 1 AS pos, " + " + ".join(f"(substr(word, {i + 1}, 1) = '{c}')::INT" for i, c in enumerate("ATACATGA")) + " AS score FROM words) SELECT id, min(pos) AS pos FROM m WHERE score >= 6 GROUP BY 1",
    ),
    "i36_last_match": (
        lambda s, d: C.inexact_matches(A.seq(s, d), "ATACATGA", 6).groupBy("id").agg(F.max("pos").alias("pos"), F.max_by("score", "pos").alias("score")),
        SEQ + ", " + words_sql(8) + ", m AS (SELECT id, pos + 1 AS pos, " + " + ".join(f"(substr(word, {i + 1}, 1) = '{c}')::INT" for i, c in enumerate("ATACATGA")) + " AS score FROM words) SELECT id, max(pos) AS pos, max_by(score, pos) AS score FROM m WHERE score >= 6 GROUP BY 1",
    ),
    "i38_scrambled_composition": (
        lambda s, d: C.base_counts(M.scrambled(A.seq(s, d), 5)).select("id", "length", "n_a", "n_c", "n_g", "n_t"),
        SEQ + "SELECT id, length(seq) AS length, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b.lower()}" for b in "ACGT") + " FROM seqs",
    ),
    "i39_codons_to_acids": (
        lambda s, d: C.codon_usage(A.seq(s, d)).select("codon", "acid"),
        SEQ + ", " + codons_sql() + f" SELECT DISTINCT codon, substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS acid FROM codon",
    ),
    "i40_complement_codons": (
        lambda s, d: C.codon_usage(A.seq(s, d)).select("codon", S.amino_acid(S.reverse_complement(F.col("codon"))).alias("acid")),
        SEQ + ", " + codons_sql() + f", r AS (SELECT DISTINCT codon, reverse(translate(codon, {IUB_SQL})) AS r FROM codon) SELECT codon, substr('{CODE}', {TRIPLET.format(c='r')}, 1) AS acid FROM r",
    ),
    "i41_three_letters": (
        lambda s, d: C.codon_usage(A.seq(s, d)).select("codon", F.element_at(F.create_map(*[F.lit(x) for kv in M.THREE_LETTERS.items() for x in kv]), F.col("acid")).alias("name")),
        SEQ + ", " + codons_sql() + f", a AS (SELECT DISTINCT codon, substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS acid FROM codon) SELECT codon, CASE acid " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in M.THREE_LETTERS.items()) + " END AS name FROM a",
    ),
    "i43_legal_codons": (
        lambda s, d: A.seq(s, d).select("id", F.expr("substring(seq, 1, 3)").alias("codon")).withColumn("legal", S.codon_index(F.col("codon")).isNotNull()).groupBy("legal").agg(F.count("*").alias("n")),
        SEQ + "SELECT regexp_full_match(substr(seq, 1, 3), '[ACGT]{3}') AS legal, count(*) AS n FROM seqs GROUP BY 1",
    ),
    "i44_edited_code": (
        lambda s, d: C.codon_usage(A.seq(s, d)).select("codon", S.amino_acid(F.col("codon"), EDITED).alias("acid")),
        SEQ + ", " + codons_sql() + f" SELECT DISTINCT codon, CASE codon WHEN 'TGA' THEN 'W' WHEN 'ATA' THEN 'M' ELSE substr('{CODE}', {TRIPLET.format(c='codon')}, 1) END AS acid FROM codon",
    ),
    "i46_reverse_frames": (
        lambda s, d: C.open_frames(A.seq(s, d).select("id", S.reverse_complement(F.col("seq")).alias("seq")), 30),
        SEQ.replace("seqs AS (", "forward_ AS (") + f", seqs AS (SELECT id, reverse(translate(seq, {IUB_SQL})) AS seq FROM forward_) " + " UNION ALL ".join(frames_sql(f, 30) for f in range(3)),
    ),
    "i47_frames_as_features": (
        lambda s, d: C.open_frames(A.seq(s, d), 30).select("id", F.concat(F.lit("FT   CDS             "), "low", F.lit(".."), "high").alias("line")),
        SEQ + ", frames AS (" + " UNION ALL ".join(frames_sql(f, 30) for f in range(3)) + ") SELECT id, 'FT   CDS             ' || low || '..' || high AS line FROM frames",
    ),
    "i51_start_codons": (
        lambda s, d: A.seq(s, d).select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("frame"), F.size(F.filter(S.codons(F.col("seq"), f), lambda c: c == "ATG")).alias("starts")) for f in range(3)])).alias("x")).select("id", "x.frame", "x.starts"),
        SEQ + " UNION ALL ".join(f"SELECT id, {f} AS frame, len(list_filter(range(0, CAST(greatest(0, floor((length(seq) - {f}) / 3)) AS BIGINT)), lambda i: substr(seq, i * 3 + 1 + {f}, 3) = 'ATG')) AS starts FROM seqs" for f in range(3)),
    ),
    "i52_string_search_plot": (
        lambda s, d: C.inexact_matches(A.seq(s, d), "ATACATGA", 6).groupBy(F.expr("pos div 100").alias("bucket")).agg(F.count("*").alias("n")),
        SEQ + ", " + words_sql(8) + ", m AS (SELECT id, pos + 1 AS pos, " + " + ".join(f"(substr(word, {i + 1}, 1) = '{c}')::INT" for i, c in enumerate("ATACATGA")) + " AS score FROM words) SELECT pos // 100 AS bucket, count(*) AS n FROM m WHERE score >= 6 GROUP BY 1",
    ),
    "i54_masked_matrix_hits": (
        lambda s, d: C.matrix_hits(A.seq(s, d).filter(F.contains("seq", F.lit("G"))), MATRIX, 10, 2).join(C.words(A.seq(s, d), 6).filter("substring(word, 4, 1) = 'G' and substring(word, 5, 1) = 'T'").select("id", (F.col("pos") + 2).alias("pos")), ["id", "pos"]),
        SEQ + ", " + words_sql(6) + f", m AS (SELECT id, pos + 2 AS pos, word, {matrix_sql()} AS score FROM words) SELECT id, pos, score FROM m WHERE score >= 10 AND substr(word, 4, 2) = 'GT'",
    ),
    "i56_matrix_best": (
        lambda s, d: C.matrix_hits(A.seq(s, d), MATRIX, 10, 2).groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("n")),
        SEQ + ", " + words_sql(6) + f", m AS (SELECT id, {matrix_sql()} AS score FROM words) SELECT id, max(score) AS score, count(*) AS n FROM m WHERE score >= 10 GROUP BY 1",
    ),
    "i61_sites_with_cuts": (
        lambda s, d: C.restriction_sites(A.seq(s, d)).groupBy("enzyme").agg(F.count("*").alias("n")).withColumn(
            "shown", F.element_at(F.create_map(*[F.lit(x) for n, t, c in C.ENZYMES for x in (n, f"{t[:c]}'{t[c:]}")]), F.col("enzyme"))
        ),
        SEQ + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS enzyme, '{t[:c]}''{t[c:]}' AS shown, CAST(sum((length(seq) - length(replace(seq, '{t}', ''))) // {len(t)}) AS BIGINT) AS n FROM seqs" for n, t, c in C.ENZYMES) + ") WHERE n > 0",
    ),
    "i63_vector_cut_sites": (
        lambda s, d: A.seq(s, d, "benchmark", "item_id").select("id", (F.instr("seq", "AGCT") + 1).alias("cut")).filter("cut > 1"),
        f"WITH {A.BENCH} SELECT id, instr(seq, 'AGCT') + 1 AS cut FROM probe WHERE instr(seq, 'AGCT') > 0",
    ),
    "i64_sequence_mass": (
        lambda s, d: A.seq(s, d).select("id", F.round(S.mass(F.col("seq")), 4).alias("mass")),
        SEQ + "SELECT id, round(" + " + ".join(f"(length(seq) - length(replace(seq, '{b}', ''))) * {m}::DOUBLE" for b, m in S.MASS.items()) + " + 1.00794::DOUBLE - 62.97256::DOUBLE, 4) AS mass FROM seqs",
    ),
    "i65_score_distribution": (lambda s, d: _rows(s, _distribution(s, d), "probability"), BINOMIAL + "SELECT k AS score, round(v, 9) AS probability FROM dist"),
    "i66_match_probability": (lambda s, d: _rows(s, M.tail(_distribution(s, d)), "at_least"), BINOMIAL + "SELECT k AS score, round(sum(v) OVER (ORDER BY k DESC), 9) AS at_least FROM dist"),
    "i67_word_probability": (
        lambda s, d: A.seq(s, d).agg(*[F.sum(S.count_letter(F.col("seq"), b)).cast("double").alias(b) for b in "ACGT"]).select(F.round(F.log10(F.expr("pow((A * A + C * C + G * G + T * T) / pow(A + C + G + T, 2), 8)")), 6).alias("log_chance")),
        BINOMIAL + "SELECT round(log10(power(p, 8)), 6) AS log_chance FROM p",
    ),
    "i68_score_threshold": (
        lambda s, d: s.createDataFrame([(M.threshold(_distribution(s, d), 1000.0, 1.0),)], "score int"),
        BINOMIAL + ", t AS (SELECT k, sum(v) OVER (ORDER BY k DESC) AS p FROM dist) SELECT min(k) AS score FROM t WHERE p * 1000 <= 1",
    ),
    "i70_packed_types": (
        lambda s, d: A.tag(s, d).select("type").distinct().select("type", M.packed_type(F.col("type")).alias("packed")),
        f"WITH {A.TAG} SELECT DISTINCT type, " + " + ".join(f"ascii(substr(type, {i + 1}, 1))::BIGINT * {1 << (8 * (3 - i))}" for i in range(4)) + " AS packed FROM tag",
    ),
    "i72_tag_strings": (
        lambda s, d: A.tag(s, d).select("tag_id", lists.format_tag().alias("text")),
        f"""WITH {A.TAG} SELECT tag_id, type || ' ' || dir || ' ' || "start" || '..' || "end" || chr(10) || comment AS text FROM tag""",
    ),
    "i73_note_strings": (_note, f"WITH {NOTES} SELECT event_id, type || ' ctime=' || strftime(created, '%Y-%m-%d %H:%M:%S') || ' mtime=' || strftime(changed, '%Y-%m-%d %H:%M:%S') || chr(10) || text AS note FROM notes"),
    "i74_parsed_notes": (lambda s, d: _note(s, d).select("event_id", M.parse_note(F.col("note")).alias("n")).select("event_id", "n.type", F.unix_timestamp("n.created").alias("created"), F.unix_timestamp("n.changed").alias("changed"), "n.text"), f"WITH {NOTES} SELECT event_id, type, CAST(epoch(created) AS BIGINT) AS created, CAST(epoch(changed) AS BIGINT) AS changed, text FROM notes"),
    "i75_times": (lambda s, d: _notes(s, d).select("event_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("text")), f"WITH {NOTES} SELECT event_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS text FROM notes"),
    "i76_parsed_times": (lambda s, d: _notes(s, d).select("event_id", F.unix_timestamp(F.to_timestamp(F.date_format("changed", "yyyy-MM-dd HH:mm:ss"))).alias("seconds")), f"WITH {NOTES} SELECT event_id, CAST(epoch(changed) AS BIGINT) AS seconds FROM notes"),
    "i81_read_error_chance": (
        lambda s, d: A.bases(A.item(s, d)).groupBy("rec").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.pow(F.lit(10.0), -F.greatest(F.lit(1), F.col("qual")) / 10)))), 6).alias("chance")),
        f"WITH {A.ITEM}, {A.BASES} SELECT rec, round(1 - exp(sum(ln(1 - power(10.0::DOUBLE, -greatest(1, qual) / 10)))), 6) AS chance FROM bases GROUP BY 1",
    ),
    "i84_translated_mapping": (
        lambda s, d: A.seq(s, d).filter("length(seq) >= 30").select("id", F.posexplode(S.codons(F.expr("substring(seq, 1, 30)"))).alias("acid_no", "codon")).select("id", "acid_no", (F.col("acid_no") * 3 + 1).alias("base"), S.amino_acid(F.col("codon")).alias("acid")),
        SEQ + ", c AS (SELECT id, seq, unnest(range(0, 10)) AS acid_no FROM seqs WHERE length(seq) >= 30), x AS (SELECT id, acid_no, substr(seq, acid_no * 3 + 1, 3) AS codon FROM c) SELECT id, acid_no, acid_no * 3 + 1 AS base, " + f"substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS acid FROM x",
    ),
    "i85_exons_at": (
        lambda s, d: ranges.interval_join(A.tag(s, d).filter("type = 'CLIC'").select("tag_id", "contig_id", "start", F.col("start").alias("end")), A.tag(s, d).filter("type = 'VIEW'").select("contig_id", F.col("tag_id").alias("exon"), F.col("start").alias("rstart"), F.col("end").alias("rend")), "contig_id").select("tag_id", "exon"),
        f"WITH {A.TAG} SELECT a.tag_id, b.tag_id AS exon FROM tag a JOIN tag b ON a.contig_id = b.contig_id AND a.\"start\" BETWEEN b.\"start\" AND b.\"end\" WHERE a.type = 'CLIC' AND b.type = 'VIEW'",
    ),
}
