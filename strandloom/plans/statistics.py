"""Queries on diagonals, templates, libraries, proteins and texts of formats, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import clipping, lists, pairs, ranges
from strandloom.operators import composition as C
from strandloom.operators import consensus as K
from strandloom.operators import kmers
from strandloom.operators import matching as M
from strandloom.operators import tiles
from strandloom.sources import adapters as A
from strandloom.sources import formats as T

from .consensus import BASES, FREQ, _bayes, bayes_sql
from .reads import PAIRS
from .sequences import BOTH, CODE, SEQ, TRIPLET, codons_sql, words_sql

ITEM = f"WITH {A.ITEM} "
TEMPLATES = ITEM + """, t AS (SELECT template, count(*) AS n_reads, count(DISTINCT contig_id) AS n_contigs, count(DISTINCT comp) AS n_strands, max("end") - min("start") AS span FROM item GROUP BY 1) """
HITS = BOTH + ", " + words_sql(12) + ", " + words_sql(12, "probe", "pw") + f""", l1 AS (SELECT id, length(seq) AS len, (power(length(seq) - length(replace(seq, 'A', '')), 2) + power(length(seq) - length(replace(seq, 'C', '')), 2) + power(length(seq) - length(replace(seq, 'G', '')), 2) + power(length(seq) - length(replace(seq, 'T', '')), 2)) / power(length(seq), 2) AS p FROM seqs WHERE length(seq) > 0), l2 AS (SELECT id, length(seq) AS len FROM probe)
, h AS (SELECT a.id AS id1, b.id AS id2, l1.len - a.pos + b.pos - 1 AS diagonal, l1.len AS len1, l2.len AS len2, p, count(*) AS n FROM words a JOIN pw b ON a.word = b.word JOIN l1 ON a.id = l1.id JOIN l2 ON b.id = l2.id GROUP BY ALL)
, m AS (SELECT *, least(diagonal + 1, len1, len2, len1 + len2 - 1 - diagonal) AS length, least(diagonal + 1, len1, len2, len1 + len2 - 1 - diagonal) * power(p, 12) AS mean FROM h)
, tail AS (SELECT *, greatest(0.0::DOUBLE, 1 - list_sum(list_transform(range(0, n), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1))))) AS chance FROM m) """


def _diagonals(s, d):
    return kmers.diagonal_hits(A.seq(s, d), A.seq(s, d, "benchmark", "item_id"), 12)


def _freq(s, d):
    return K.frequency_consensus(tiles.pileup(A.item(s, d), A.base_arrays))


def _summary(s, d):
    return pairs.template_summary(A.item(s, d))


def poly_sql(tail: str) -> str:
    """The rule of clipping.poly_clip in terms of the text ``tail``, whose beginning is clipped."""
    return f"""WITH {A.SEQ}, t AS (SELECT id, {tail} AS tail FROM seqs WHERE length(seq) >= 10), l AS (SELECT *, 10 - length(replace(substr(tail, 1, 10), 'A', '')) AS a, 10 - length(replace(substr(tail, 1, 10), 'T', '')) AS t FROM t),
        w AS (SELECT *, CASE WHEN a > t THEN 'A' ELSE 'T' END AS b FROM l WHERE greatest(a, t) >= 4),
        s AS (SELECT *, coalesce(list_position(list_transform(range(1, length(tail) - 9), lambda i: 10 - length(replace(substr(tail, i, 10), b, '')) < 4), true), 0) AS stop FROM w)
        SELECT id, CAST(CASE WHEN stop = 0 THEN length(tail) ELSE stop - 1 + 10 - length(ltrim(substr(tail, stop, 10), b)) END AS INT) AS clip FROM s WHERE stop = 0 OR stop - 1 + 10 - length(ltrim(substr(tail, stop, 10), b)) > 0"""


def _lines(s, d):
    """Consensus lines of 60 columns: contig_id, line, text."""
    f = _freq(s, d).withColumn("line", F.expr("pos div 60"))
    return f.groupBy("contig_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "percent"))), lambda x: F.char(33 + F.least(F.lit(93), x["percent"]))), "").alias("quality"))


PROTEIN = SEQ + ", " + codons_sql() + f", aa AS (SELECT id, substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS acid FROM codon) "
SAMPLE = "x AS (SELECT rec, CASE rec % 5 WHEN 0 THEN 'ILLUMINA' WHEN 1 THEN 'ls454' WHEN 2 THEN 'Solid' WHEN 3 THEN 'ABI' ELSE 'other' END AS platform FROM item)"


ENZYME_SQL = "SELECT replace(p_brand, '#', '') || '_' || p_partkey AS enzyme, site, p_size % length(site) AS cut FROM (SELECT *, substr(regexp_replace(upper(translate(p_name, 'eiounhrs', 'ACGTACGT')), '[^ACGT]', '', 'g'), 1, 6) AS site FROM part) WHERE length(site) > 0"


def _enzymes(s, d):
    """Made-up enzymes of the parts: a site of up to six letters of the name, cut somewhere inside."""
    site = F.substring(F.regexp_replace(F.upper(F.translate("p_name", "eiounhrs", "ACGTACGT")), "[^ACGT]", ""), 1, 6)
    named = A.table(s, d, "part").withColumn("site", site).filter("length(site) > 0")
    return named.select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.col("p_partkey").cast("string")).alias("enzyme"), "site", (F.col("p_size") % F.length("site")).cast("int").alias("cut"))


def _platforms(s, d):
    r = F.col("rec")
    platform = F.when(r % 5 == 0, "ILLUMINA").when(r % 5 == 1, "ls454").when(r % 5 == 2, "Solid").when(r % 5 == 3, "ABI").otherwise("other")
    name = (
        F.when(r % 7 == 0, F.concat(F.lit("HWI:1:2:3:"), r)).when(r % 7 == 1, F.concat(F.lit("VAB_"), r)).when(r % 7 == 2, F.lpad(r.cast("string"), 14, "e")).when(r % 7 == 3, F.concat(F.lit("IL"), r % 40, F.lit("_"), r))
        .when(r % 7 == 4, F.concat(F.lit("xb"), r, F.lit(".p1k"))).when(r % 7 == 5, F.concat(F.lit("a:b:c:d:e:"), r)).otherwise(F.concat(F.lit("xb"), r, F.lit(".s1")))
    )
    return A.item(s, d).select("rec", platform.alias("platform"), name.alias("name"))


def _annotations(tags, block: int = 512):
    """Tags written as annotation texts and read again. A contig's tags are texts of ``block`` numbers each, so that none grows with the input."""
    safe = lambda c: reduce(lambda x, y: F.replace(x, F.lit(y), F.lit(f"%{ord(y):02X}")), "% |;", F.col(c)).alias(c)
    own = tags.select("contig_id", F.floor(F.col("tag_id") / block).alias("block"), F.struct("tag_id", "start", "end", "dir", safe("type"), safe("comment")).alias("tag"))
    line = lambda x: F.concat_ws(";", x["start"].cast("string"), x["end"].cast("string"), x["dir"], x["type"], F.concat(F.lit("Note="), x["comment"]))
    texts = own.groupBy("contig_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag")), line), "|").alias("text"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("contig_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    placed = texts.withColumn("before", F.coalesce(before, F.lit(0)))
    return placed.select("contig_id", "before", F.posexplode(T.annotation_tags(F.col("text"))).alias("i", "t")).select("contig_id", (F.col("before") + F.col("i")).cast("int").alias("place"), "t.*")


QUERIES = {
    "d21_axis_intercepts": (
        lambda s, d: _diagonals(s, d).select("id1", "id2", "diagonal", *kmers.intercepts(F.col("diagonal"), F.col("len1"))),
        HITS + "SELECT id1, id2, diagonal, CASE WHEN diagonal < len1 THEN len1 - diagonal - 1 ELSE 0 END AS x, CASE WHEN diagonal < len1 THEN 0 ELSE diagonal + 1 - len1 END AS y FROM h",
    ),
    "d22_diagonal_significance": (
        lambda s, d: kmers.significant_diagonals(_diagonals(s, d), 12, 1e-4).select("id1", "id2", "diagonal", "n", F.round("chance", 9).alias("chance")),
        HITS + "SELECT id1, id2, diagonal, n, round(chance, 9) AS chance FROM tail WHERE chance < 1e-4",
    ),
    "d23_best_intercepts": (
        lambda s, d: kmers.best_intercepts(kmers.significant_diagonals(_diagonals(s, d), 12, 1e-4)),
        HITS + """, g AS (SELECT id1, id2, any_value(len1) AS len1, list({'d': diagonal, 's': n / length} ORDER BY diagonal) AS ds FROM tail WHERE chance < 1e-4 GROUP BY 1, 2)
        , r AS (SELECT id1, id2, len1, list_reduce(list_prepend(ds, list_transform(range(1, len(ds)), lambda i: ds[1:0])), lambda left_, unused: list_filter(left_, lambda x, i: i <> list_position(
            list_transform(left_, lambda y: abs(list_sum(list_transform(left_, lambda z: z.d * z.s)) / list_sum(list_transform(left_, lambda z: z.s)) - y.d)),
            list_max(list_transform(left_, lambda y: abs(list_sum(list_transform(left_, lambda z: z.d * z.s)) / list_sum(list_transform(left_, lambda z: z.s)) - y.d)))))) AS one FROM g)
        SELECT id1, id2, one[1].d AS diagonal, CASE WHEN one[1].d < len1 THEN len1 - one[1].d - 1 ELSE 0 END AS x, CASE WHEN one[1].d < len1 THEN 0 ELSE one[1].d + 1 - len1 END AS y FROM r""",
    ),
    "d29_diagonal_zscores": (
        lambda s, d: kmers.diagonal_zscores(_diagonals(s, d)),
        HITS + ", g AS (SELECT id1, id2, avg(n) AS mean, stddev_pop(n) AS dev FROM h GROUP BY 1, 2) SELECT h.id1, h.id2, diagonal, n, CASE WHEN dev > 0 THEN round((n - mean) / dev, 5) END AS z FROM h JOIN g ON h.id1 = g.id1 AND h.id2 = g.id2 WHERE dev > 0 AND (n - mean) / dev >= 3.0",
    ),
    "d31_self_matches": (
        lambda s, d: kmers.exact_matches(A.seq(s, d, "benchmark", "item_id"), A.seq(s, d, "benchmark", "item_id"), 10, 10).filter("id1 < id2 or id1 = id2 and pos1 < pos2"),
        f"WITH {A.BENCH}, " + words_sql(10, "probe", "pw") + ", h AS (SELECT a.id AS id1, b.id AS id2, a.pos AS p1, b.pos AS p2 FROM pw a JOIN pw b ON a.word = b.word), i AS (SELECT *, p1 - row_number() OVER (PARTITION BY id1, id2, p1 - p2 ORDER BY p1) AS isl FROM h), m AS (SELECT id1, id2, min(p1) + 1 AS pos1, min(p2) + 1 AS pos2, count(*) + 9 AS length FROM i GROUP BY id1, id2, p1 - p2, isl) SELECT * FROM m WHERE id1 < id2 OR id1 = id2 AND pos1 < pos2",
    ),
    "e3_heterozygous_calls": (lambda s, d: _bayes(s, d, "contig_id", "pos", "phred", "het_call").filter("phred < 10").select("contig_id", "pos", "het_call"), bayes_sql() + "SELECT contig_id, pos, het_call FROM bayes WHERE phred < 10"),
    "e20_confidence_graph": (
        lambda s, d: _bayes(s, d, "contig_id", "pos", "phred").groupBy("contig_id", F.expr("pos div 100").alias("bucket")).agg(F.min("phred").alias("least"), F.sum("phred").alias("total")),
        bayes_sql() + "SELECT contig_id, pos // 100 AS bucket, min(phred) AS least, CAST(sum(phred) AS BIGINT) AS total FROM bayes GROUP BY 1, 2",
    ),
    "e21_confidence_histogram": (
        lambda s, d: _bayes(s, d, "phred").groupBy(F.floor(F.least("phred", F.lit(100)) + 0.499).cast("int").alias("bin")).agg(F.count("*").alias("n")),
        bayes_sql() + "SELECT CAST(floor(least(phred, 100) + 0.499) AS INT) AS bin, count(*) AS n FROM bayes GROUP BY 1",
    ),
    "e25_match_rates_bayes": (
        lambda s, d: tiles.match_rates(A.item(s, d), A.base_arrays, "bayes"),
        bayes_sql() + "SELECT qual, count(*) FILTER (WHERE code = instr('ACGT*', base) - 1) AS matches, count(*) FILTER (WHERE code <> instr('ACGT*', base) - 1) AS mismatches FROM bases JOIN bayes USING (contig_id, pos) WHERE base NOT IN ('-', 'N') GROUP BY 1",
    ),
    "e26_insert_bins": (
        lambda s, d: A.table(s, d, "orders").select((F.col("o_orderkey") * 37 % 1_100_000).alias("size")).distinct().select("size", pairs.insert_bin(F.col("size")).alias("bin")),
        "WITH z AS (SELECT DISTINCT o_orderkey * 37 % 1100000 AS size FROM orders), y AS (SELECT size, least(size, 1048576) AS x, greatest(0, CAST(floor(log2(greatest(least(size, 1048576), 1) + 0.5)) AS INT) - 7) AS y FROM z) SELECT size, CAST(y * 128 + (x >> y) AS INT) AS bin FROM y",
    ),
    "e27_bin_sizes": (
        lambda s, d: A.table(s, d, "part").select((F.col("p_partkey") % 1700).cast("int").alias("bin")).distinct().select("bin", pairs.bin_size(F.col("bin")).alias("low")),
        "SELECT DISTINCT CAST(p_partkey % 1700 AS INT) AS bin, CAST((p_partkey % 1700 - greatest(0, p_partkey % 1700 // 128 - 1) * 128) << greatest(0, p_partkey % 1700 // 128 - 1) AS BIGINT) AS low FROM part",
    ),
    # rounds until they keep still, and a rule of their end for three orientations at once, are no SQL: tests/test_mended.py
    "e29_library_sizes": (lambda s, d: pairs.library_sizes(pairs.insert_histogram(pairs.template_status(pairs.mates(A.item(s, d))))), None),
    "e31_largest_insert": (lambda s, d: pairs.largest_insert(pairs.library_sizes(pairs.insert_histogram(pairs.template_status(pairs.mates(A.item(s, d)))))), None),
    "e32_database_summary": (
        lambda s, d: A.item(s, d).agg(F.count("*").alias("reads"), F.countDistinct("contig_id").alias("contigs"), F.countDistinct("template").alias("templates"), F.countDistinct("library").alias("libraries"), F.sum("length").alias("bases")),
        ITEM + "SELECT count(*) AS reads, count(DISTINCT contig_id) AS contigs, count(DISTINCT template) AS templates, count(DISTINCT library) AS libraries, CAST(sum(length) AS BIGINT) AS bases FROM item",
    ),
    "e33_average_read_length": (lambda s, d: A.visible(A.item(s, d)).groupBy("library").agg(F.round(F.avg("length"), 6).alias("length"), F.round(F.avg(F.col("vend") - F.col("vstart") + 1), 6).alias("used")), ITEM + f", {A.VISIBLE} SELECT library, round(avg(length), 6) AS length, round(avg(vend - vstart + 1), 6) AS used FROM vis GROUP BY 1"),
    "e36_template_strands": (
        lambda s, d: pairs.strand_conflicts(A.item(s, d)),
        ITEM + "SELECT template, contig_id, count(*) FILTER (WHERE comp = (end_no % 2 = 0)) AS plus, count(*) FILTER (WHERE comp <> (end_no % 2 = 0)) AS minus FROM item GROUP BY 1, 2 HAVING plus > 0 AND minus > 0",
    ),
    "e37_template_positions": (
        lambda s, d: A.item(s, d).groupBy("template", "contig_id", "comp").agg((F.max("start") - F.min("start")).alias("spread")).filter("spread > 1000"),
        ITEM + """SELECT template, contig_id, comp, max("start") - min("start") AS spread FROM item GROUP BY 1, 2, 3 HAVING spread > 1000""",
    ),
    "e38_template_lengths": (lambda s, d: _summary(s, d).filter("n_contigs = 1").select("template", "span", F.expr("span between 50 and 2000").alias("good")), TEMPLATES + "SELECT template, span, span BETWEEN 50 AND 2000 AS good FROM t WHERE n_contigs = 1"),
    "e39_without_singletons": (lambda s, d: _summary(s, d).filter("n_reads > 1").select("template", "n_reads"), TEMPLATES + "SELECT template, n_reads FROM t WHERE n_reads > 1"),
    "e40_spanning_templates": (lambda s, d: _summary(s, d).filter("n_contigs > 1").select("template", "n_contigs"), TEMPLATES + "SELECT template, n_contigs FROM t WHERE n_contigs > 1"),
    "e42_acid_composition": (lambda s, d: A.seq(s, d).select(F.explode(F.filter(F.split(S.translate(F.col("seq")), ""), lambda c: c != "")).alias("acid")).groupBy("acid").agg(F.count("*").alias("n")), PROTEIN + "SELECT acid, count(*) AS n FROM aa GROUP BY 1"),
    "e43_acid_mass": (
        lambda s, d: A.seq(s, d).withColumn("p", S.translate(F.col("seq"))).select("id", F.round(sum((S.count_letter(F.col("p"), a).cast("long") * F.lit(round(m * 10_000)) for a, m in M.ACID_MASS.items()), F.lit(0).cast("long")) / F.lit(10_000.0), 4).alias("mass")),
        PROTEIN + ", w AS (SELECT id, sum(CASE acid " + " ".join(f"WHEN '{a}' THEN {round(m * 10000)}" for a, m in M.ACID_MASS.items()) + " ELSE 0 END) AS m FROM aa GROUP BY 1) SELECT seqs.id, round(coalesce(m, 0) / 10000.0::DOUBLE, 4) AS mass FROM seqs LEFT JOIN w ON seqs.id = w.id",
    ),
    "e45_expected_dinucleotides": (
        lambda s, d: C.dinucleotides(A.seq(s, d)).select("word", "expected"),
        SEQ + ", " + words_sql(2) + ", f AS (SELECT substr(word, 1, 1) AS b, count(*) AS m FROM words GROUP BY 1), t AS (SELECT sum(m) AS total FROM f), p AS (SELECT DISTINCT word FROM words) SELECT word, round(100 * (x.m / total) * (y.m / total), 6) AS expected FROM p, t, f x, f y WHERE x.b = substr(word, 1, 1) AND y.b = substr(word, 2, 1)",
    ),
    "e47_codons_per_thousand": (
        lambda s, d: C.codon_usage(A.seq(s, d)).select("codon", F.expr("round(1000 * n / sum(n) over (), 4)").alias("per_thousand")),
        SEQ + ", " + codons_sql() + ", u AS (SELECT codon, count(*) AS n FROM codon GROUP BY 1) SELECT codon, round(1000 * n / sum(n) OVER (), 4) AS per_thousand FROM u",
    ),
    "e53_pair_check_regions": (
        lambda s, d: pairs.region_support(pairs.mates(A.item(s, d)), 250, 3000),
        PAIRS + """, inside AS (SELECT contig_id1 AS contig_id, unnest(range(least(start1, start2) // 250 + 1, greatest(end1, end2) // 250 + 1)) AS boundary, 1 AS s FROM pairs WHERE contig_id1 = contig_id2 AND comp1 <> comp2 AND greatest(end1, end2) - least(start1, start2) <= 3000 AND (CASE WHEN comp1 THEN start2 <= start1 ELSE start1 <= start2 END)),
        outside AS (SELECT contig_id1 AS contig_id, comp1 AS c, start1 AS st, end1 AS en FROM pairs WHERE contig_id1 <> contig_id2 UNION ALL SELECT contig_id2, comp2, start2, end2 FROM pairs WHERE contig_id1 <> contig_id2),
        all_ AS (SELECT * FROM inside UNION ALL SELECT contig_id, CASE WHEN c THEN st // 250 ELSE en // 250 + 1 END, -1 FROM outside) SELECT contig_id, boundary, CAST(sum(s) AS BIGINT) AS score FROM all_ GROUP BY 1, 2""",
    ),
    "e54_template_spans": (
        lambda s, d: pairs.template_depth(A.item(s, d)).withColumn("bucket", F.explode(F.sequence(F.expr("start div 500"), F.expr("end div 500")))).groupBy("contig_id", "bucket").agg(F.count("*").alias("templates")),
        ITEM + """, t AS (SELECT contig_id, template, min("start") AS s, max("end") AS e FROM item GROUP BY 1, 2), b AS (SELECT contig_id, unnest(range(s // 500, e // 500 + 1)) AS bucket FROM t) SELECT contig_id, bucket, count(*) AS templates FROM b GROUP BY 1, 2""",
    ),
    "e62_duplicated_templates": (
        lambda s, d: A.item(s, d).groupBy("contig_id", "start", "end", "comp").agg(F.countDistinct("template").alias("n")).filter("n > 1"),
        ITEM + """SELECT contig_id, "start", "end", comp, count(DISTINCT template) AS n FROM item GROUP BY 1, 2, 3, 4 HAVING n > 1""",
    ),
    "e67_called_base_quality": (
        lambda s, d: A.bases(A.item(s, d)).filter("code < 4").groupBy("rec").agg(F.round(F.avg("qual"), 5).alias("aq")),
        BASES + "SELECT rec, round(avg(qual), 5) AS aq FROM bases WHERE code < 4 GROUP BY 1",
    ),
    "f17_poly_clip_left": (
        lambda s, d: clipping.poly_clip(A.seq(s, d).select("id", F.reverse("seq").alias("seq")), 10, 4),
        poly_sql("seq"),
    ),
    "f18_bad_data_starts": (
        lambda s, d: clipping.unknown_density(A.item(s, d), A.base_arrays, 24, 1),
        BASES + ', r AS (SELECT rec, row_number() OVER w AS i, sum((code = 5)::INT) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS n FROM bases WINDOW w AS (PARTITION BY rec ORDER BY pos)) SELECT rec, min(i) - 23 AS "left" FROM r WHERE i >= 24 AND n > 1 GROUP BY 1',
    ),
    "a2_formats_of_names": (
        lambda s, d: A.table(s, d, "part").select("p_partkey", T.sniffed(F.concat(F.lit("reads."), F.element_at(F.array(*map(F.lit, ("fa.gz", "FASTQ", "sam", "gff3.bz2", "agp", "exp", "txt"))), (F.col("p_partkey") % 7 + 1).cast("int")))).alias("format")),
        "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'fasta' WHEN 1 THEN 'fastq' WHEN 2 THEN 'sam' WHEN 3 THEN 'gff' WHEN 4 THEN 'agp' WHEN 5 THEN 'exp' ELSE '' END AS format FROM part",
    ),
    "a4_fasta_round_trip": (lambda s, d: T.parse_fasta(lists.fasta(A.seq(s, d), "id", "seq")).select(F.col("name").cast("long").alias("id"), "seq"), SEQ + "SELECT id, seq FROM seqs"),
    "a15_platforms": (lambda s, d: _platforms(s, d).select("rec", T.platform_code(F.col("platform")).alias("tech")), ITEM + f", {SAMPLE} SELECT rec, CASE lower(platform) WHEN 'abi' THEN 1 WHEN 'illumina' THEN 2 WHEN 'solid' THEN 3 WHEN 'ls454' THEN 4 ELSE 0 END AS tech FROM x"),
    "a16_platforms_by_name": (lambda s, d: _platforms(s, d).select("rec", T.platform_of_name(F.col("name")).alias("tech")), ITEM + ", y AS (SELECT rec, CASE rec % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS tech FROM item) SELECT rec, tech FROM y"),
    "a17_annotation_tags": (
        lambda s, d: _annotations(A.tag(s, d)),
        f"""WITH {A.TAG} SELECT contig_id, CAST(row_number() OVER (PARTITION BY contig_id ORDER BY tag_id) - 1 AS INT) AS place, "start", "end", dir AS strand, type, comment AS note FROM tag""",
    ),
    "a20_cigar_lengths": (
        lambda s, d: C.cigars(A.padded(s, d)).select("id", T.reference_length(F.col("cigar")).alias("length"), F.size(T.cigar_ops(F.col("cigar"))).alias("ops")),
        f"WITH {A.PADDED}, c AS (SELECT id, regexp_replace(seq, '\\*+$', '') AS s FROM padded) SELECT id, length(s) AS length, len(regexp_extract_all(s, '([^*]+|\\*+)')) AS ops FROM c",
    ),
    "a41_assembly_positions": (
        lambda s, d: A.item(s, d).select(F.concat_ws(" ", F.concat(F.lit("r"), "rec"), F.when(F.col("comp"), "-").otherwise("+"), "start", F.lit("-1")).alias("value")).select(T.parse_position(F.col("value")).alias("p")).select("p.*"),
        ITEM + """SELECT 'r' || rec AS name, CASE WHEN comp THEN '-' ELSE '+' END AS sense, "start" AS "offset", -1 AS tolerance FROM item""",
    ),
    "a47_enzyme_lines": (
        lambda s, d: T.parse_enzymes(_enzymes(s, d).select(F.expr("concat(enzyme, '/', substring(site, 1, cut), '\\'', substring(site, cut + 1, 100), '/\\'', reverse(site), '//')").alias("value"))),
        f"WITH e AS ({ENZYME_SQL}) SELECT enzyme, site, CAST(cut AS INT) AS cut FROM e UNION ALL SELECT enzyme, reverse(site), 0 FROM e",
    ),
    "i42_one_letter": (
        lambda s, d: A.seq(s, d).select(F.explode(F.filter(F.split(S.translate(F.col("seq")), ""), lambda c: c.rlike("[A-Z]"))).alias("a")).groupBy(F.element_at(F.create_map(*[F.lit(x) for kv in M.THREE_LETTERS.items() for x in kv]), F.col("a")).alias("name")).agg(F.count("*").alias("n"))
        .select("name", F.element_at(F.create_map(*[F.lit(x) for a, n in M.THREE_LETTERS.items() if a.isalpha() for x in (n, a)]), F.col("name")).alias("acid"), "n"),
        PROTEIN + ", t(name, acid) AS (VALUES " + ", ".join(f"('{n}', '{a}')" for a, n in M.THREE_LETTERS.items() if a.isalpha()) + ") SELECT name, t.acid, count(*) AS n FROM aa JOIN t ON aa.acid = t.acid GROUP BY 1, 2",
    ),
    "a31_agp_round_trip": (
        lambda s, d: T.parse_agp(lists.agp(A.scaffold_member(s, d)).select(F.concat_ws("\t", F.col("scaffold_id").cast("string"), F.lit("1"), F.lit("1"), F.col("part").cast("string"), "kind", F.when(F.col("kind") == "N", F.col("size").cast("string")).otherwise(F.col("contig_id").cast("string"))).alias("value"))).select(F.col("scaffold").cast("long").alias("scaffold_id"), F.col("contig").cast("long").alias("contig_id"), "gap_size"),
        f"WITH {A.SCAFFOLD} SELECT scaffold_id, contig_id, CASE WHEN idx > 1 THEN gap_size ELSE 0 END AS gap_size FROM member",
    ),
    "b9_baf_records": (
        lambda s, d: A.item(s, d).select("rec", F.concat(F.lit("RD=r"), "rec", F.lit("\nDR="), F.when(F.col("comp"), -1).otherwise(1), F.lit("\nAP="), "start", F.lit("\nQL="), F.col("lclip") - 1, F.lit("\nQR="), F.col("rclip") + 1).alias("value")),
        ITEM + """SELECT rec, 'RD=r' || rec || chr(10) || 'DR=' || CASE WHEN comp THEN -1 ELSE 1 END || chr(10) || 'AP=' || "start" || chr(10) || 'QL=' || (lclip - 1) || chr(10) || 'QR=' || (rclip + 1) AS value FROM item""",
    ),
    "b12_gff_lines": (lambda s, d: T.parse_gff(T.gff_lines(A.tag(s, d))).groupBy("type", "strand").agg(F.count("*").alias("n"), F.max("end").alias("last")), f"""WITH {A.TAG} SELECT type, CASE WHEN dir IN ('+', '-') THEN dir ELSE '.' END AS strand, count(*) AS n, max("end") + 1 AS last FROM tag GROUP BY 1, 2"""),
    "b14_consensus_lines": (lambda s, d: _lines(s, d).select("contig_id", "line", "text"), FREQ + "SELECT contig_id, pos // 60 AS line, string_agg(base, '' ORDER BY pos) AS text FROM freq GROUP BY 1, 2"),
    "b15_consensus_qualities": (lambda s, d: _lines(s, d).select("contig_id", "line", "quality"), FREQ + "SELECT contig_id, pos // 60 AS line, string_agg(chr(CAST(33 + least(93, percent) AS INT)), '' ORDER BY pos) AS quality FROM freq GROUP BY 1, 2"),
    "b18_codon_table_lines": (
        lambda s, d: C.codon_usage(A.seq(s, d)).select(F.concat_ws(" ", "acid", "codon", F.col("n").cast("string")).alias("value")),
        SEQ + ", " + codons_sql() + f", u AS (SELECT codon, count(*) AS n, substr('{CODE}', {TRIPLET.format(c='codon')}, 1) AS acid FROM codon GROUP BY 1) SELECT acid || ' ' || codon || ' ' || n AS value FROM u",
    ),
}
