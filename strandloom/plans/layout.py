"""Queries over the layout of reads: columns, pad shuffling, pileups of alignments; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import consensus, contig_order, coverage, extension, haplotypes, pileups, ranges, shuffling, spans, tiles
from strandloom.operators import pairs as P
from strandloom.operators.composition import words
from strandloom.sources import adapters as A
from strandloom.sources import bam
from strandloom.sources.shared import fresh_path, written
from strandloom.streaming import pileup as stream

COLUMNS = f"WITH {A.ITEM}, {A.BASES}, col AS (SELECT contig_id, pos, " + ", ".join(
    f"count(*) FILTER (WHERE code = {i}) AS n_{name}" for i, name in enumerate(("a", "c", "g", "t", "pad", "other"))
) + ", count(*) AS n FROM bases GROUP BY 1, 2) "
SQUARES = " + ".join(f"n_{x} * n_{x}" for x in ("a", "c", "g", "t", "pad", "other"))


def _reads(s, d):
    return A.padded_reads(A.item(s, d))


#: Columns of the alignments; the inserted base of a read lies after the position before it, what follows one to the left.
PILEUP = f"""WITH {A.ALIGNED}, moved AS (
  SELECT rec, contig_id, b, k, i, p + 1 - (bool_or(k = 'I') OVER (PARTITION BY rec ORDER BY i))::INT AS pos, CASE WHEN k = 'I' THEN 1 ELSE 0 END AS nth FROM kind
), seen AS (
  SELECT *, pos < max(pos) FILTER (WHERE nth = 0) OVER (PARTITION BY rec) AS goes_on FROM moved
), tally AS (
  SELECT contig_id::VARCHAR AS contig, pos, nth, count(*) FILTER (WHERE b = 'A') AS n_a, count(*) FILTER (WHERE b = 'C') AS n_c, count(*) FILTER (WHERE b = 'G') AS n_g, count(*) FILTER (WHERE b = 'T') AS n_t,
         count(*) FILTER (WHERE b = '*') AS n_pad, count(*) FILTER (WHERE b = 'N') AS n_other, count(*) AS n, count(*) FILTER (WHERE goes_on) AS n_on FROM seen GROUP BY 1, 2, 3
), passed AS (
  SELECT *, CASE WHEN nth > 0 THEN greatest(coalesce(max(n_on) FILTER (WHERE nth = 0) OVER (PARTITION BY contig, pos), 0) - n, 0) ELSE 0 END AS missing FROM tally
) SELECT contig, pos, nth, n_a, n_c, n_g, n_t, n_pad + missing AS n_pad, n_other, n + missing AS depth FROM passed"""


def _alignments(s, d):
    return A.alignments(A.item(s, d))


def _through_bam(s, d):
    path = fresh_path(s, "bam")
    bam.write_bam(_alignments(s, d), path)
    return bam.read_bam(s, path).select("name", "flag", "contig", "pos", "mqual", "cigar", "next_contig", "next_pos", "tlen", "seq", "qual", F.col("aux")["LB"].alias("library"))


def _streamed(s, d, steps: int = 4):
    """The alignments as a stream of sorted files that come in steps, with one beyond all others at its end.

    The stream takes all files of a step as one batch and goes on from its checkpoint at the next, so a step is as many files and tasks as it needs.
    """
    source, out, progress = fresh_path(s, "sorted"), fresh_path(s, "columns"), fresh_path(s, "progress")
    files = steps * -(-int(s.conf.get("spark.sql.shuffle.partitions")) // steps)
    items = A.item(s, d).select("contig_id", "rec", "start", "end").repartitionByRange(files, "contig_id", "start").sortWithinPartitions("contig_id", "start")
    reads = A.aligned_reads(items).select("contig_no", "contig", "pos", "cigar", "seq")
    ranged = written(reads.withColumn("step", F.floor(F.spark_partition_id() * steps / files)), "ranged")
    longest = ranged.agg(F.max(F.length("seq") + 1000)).first()[0]
    for step in range(steps):
        ranged.filter(F.col("step") == step).drop("step").write.mode("append").parquet(source)
        if step == steps - 1:
            s.createDataFrame([(1 << 22, "end", 1, "1M", "A")], reads.schema).coalesce(1).write.mode("append").parquet(source)
        columns = stream.stream_columns(s.readStream.schema(reads.schema).parquet(source), longest)
        stream.write_columns(columns, out, progress).awaitTermination()
    return s.read.parquet(out).drop("batch").filter("contig <> 'end'")


#: Greedy coverage, read by read.
COVERAGE = f"""WITH RECURSIVE {A.ITEM}, ranked AS (
  SELECT contig_id, rec, "start", "end", row_number() OVER (PARTITION BY contig_id ORDER BY "start", rec) AS r FROM item
), chain AS (
  SELECT contig_id, rec, "start", "end", r, 1::BIGINT AS place FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.contig_id, n.rec, n."start", n."end", n.r, n.place FROM (
    SELECT x.*, c.place + 1 AS place, row_number() OVER (PARTITION BY c.contig_id ORDER BY CASE WHEN x."start" < c."end" THEN 0 ELSE 1 END, CASE WHEN x."start" < c."end" THEN -x."end" ELSE x.r END, x.r) AS pick
    FROM chain c JOIN ranked x ON x.contig_id = c.contig_id AND x.r > c.r AND x."end" > c."end") n WHERE pick = 1
) SELECT contig_id, place, rec, "start", "end" FROM chain"""
#: Differences of used bases from the commonest base, the least different window, and scores outward from its middle.
DIFFERENCES = f"""WITH {A.ITEM}, {A.BASES}, {A.VISIBLE}, pile AS (
  SELECT contig_id, pos, count(*) AS depth, {", ".join(f"count(*) FILTER (WHERE code = {i}) AS c{i}" for i in range(5))} FROM bases GROUP BY 1, 2
), called AS (
  SELECT contig_id, pos, CASE WHEN 100 * greatest(c0, c1, c2, c3, c4) // depth < 50 THEN '-' WHEN c0 = greatest(c0, c1, c2, c3, c4) THEN 'A' WHEN c1 = greatest(c0, c1, c2, c3, c4) THEN 'C'
         WHEN c2 = greatest(c0, c1, c2, c3, c4) THEN 'G' WHEN c3 = greatest(c0, c1, c2, c3, c4) THEN 'T' ELSE '*' END AS base FROM pile
), used AS (
  SELECT b.rec, b.pos - v.vstart AS u, v.vend - v.vstart + 1 AS n, v.vstart - v."start" AS first, (substr('ACGT*N', b.code + 1, 1) <> c.base)::INT AS d
  FROM bases b JOIN vis v ON b.rec = v.rec AND b.pos BETWEEN v.vstart AND v.vend JOIN called c ON b.contig_id = c.contig_id AND b.pos = c.pos
), rolled AS (
  SELECT *, sum(d) OVER (PARTITION BY rec ORDER BY u ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS w FROM used
), chosen AS (
  SELECT rec, any_value(n) AS n, any_value(first) AS first, arg_min(u, w * 1000 + u) AS middle, max(w) AS worst FROM rolled WHERE u >= 15 AND u <= n - 17 GROUP BY rec HAVING max(w) >= 31 * 0.25
), scored AS (
  SELECT c.rec, c.first, c.middle, r.u, CASE WHEN r.u >= c.middle THEN sum(1 - 3 * r.d) OVER (PARTITION BY c.rec, r.u >= c.middle ORDER BY r.u) END AS rs FROM chosen c JOIN used r ON c.rec = r.rec
), scored2 AS (
  SELECT c.rec, r.u, sum(1 - 3 * r.d) OVER (PARTITION BY c.rec ORDER BY r.u DESC) AS ls FROM chosen c JOIN used r ON c.rec = r.rec AND r.u <= c.middle
), ends AS (
  SELECT rec, any_value(first) AS first, any_value(middle) AS middle, max(rs) AS best, arg_max(u, rs * 1000 - u) AS u FROM scored WHERE rs IS NOT NULL GROUP BY rec
), starts AS (
  SELECT rec, max(ls) AS best, arg_max(u, ls * 1000 + u) AS u FROM scored2 GROUP BY rec
), clip AS (
  SELECT e.rec, e.first, CASE WHEN s.best > 0 THEN s.u ELSE e.middle END AS l, CASE WHEN e.best > 0 THEN e.u ELSE e.middle END AS r FROM ends e JOIN starts s ON e.rec = s.rec
) SELECT rec, CAST(l + first AS INT) AS "left", CAST(greatest(r + 2, l + 2) + first AS INT) AS "right" FROM clip"""


def _difference_clips(s, d):
    return coverage.difference_clips(A.visible(A.item(s, d)), A.base_arrays)


#: Sites of two alleles, each divided by what stands near it; a template's base at a site outweighs all its others.
SITES = f"""WITH {A.ITEM}, {A.BASES}, q AS (
  SELECT contig_id, pos, code, CAST(sum(qual) AS BIGINT) AS q FROM bases WHERE code < 4 GROUP BY 1, 2, 3
), r AS (
  SELECT *, row_number() OVER (PARTITION BY contig_id, pos ORDER BY q DESC, code) AS r FROM q
), candidate AS (
  SELECT contig_id, pos, least(1000, max(q) FILTER (WHERE r = 1) * max(q) FILTER (WHERE r = 2)) AS score FROM r GROUP BY 1, 2 HAVING max(q) FILTER (WHERE r = 2) >= 40
), site AS (
  SELECT a.contig_id, a.pos, a.score / (sum(3 - abs(a.pos - b.pos)) / 3.0::DOUBLE) AS score
  FROM candidate a JOIN candidate b ON a.contig_id = b.contig_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 GROUP BY a.contig_id, a.pos, a.score
), by_code AS (
  SELECT contig_id, pos, template, code, CAST(sum(qual) AS BIGINT) AS conf FROM bases JOIN site USING (contig_id, pos) WHERE qual >= 15 AND code < 5 GROUP BY 1, 2, 3, 4
), of_template AS (
  SELECT contig_id, pos, template, arg_max(code, conf * 8 - code) AS code, CAST(2 * max(conf) - sum(conf) AS BIGINT) AS conf FROM by_code GROUP BY 1, 2, 3 HAVING 2 * max(conf) - sum(conf) >= 15
) """
CHIMERA = SITES + """, edge AS (
  SELECT a.contig_id, a.template, b.template AS other, power((abs(sum(CASE WHEN a.code = b.code THEN s.score ELSE -s.score END)) + 500) / (sum(s.score) + 500), 2) AS purity
  FROM of_template a JOIN of_template b ON a.contig_id = b.contig_id AND a.pos = b.pos AND a.template <> b.template JOIN site s ON a.contig_id = s.contig_id AND a.pos = s.pos GROUP BY 1, 2, 3
), every AS (SELECT DISTINCT contig_id, template FROM of_template)
SELECT contig_id, template, count(other) AS edges, round(coalesce(min(purity) * (sum(purity) + 5) / (count(other) + 5), 1), 6) AS chimera FROM every LEFT JOIN edge USING (contig_id, template) GROUP BY 1, 2"""


def _sites(s, d):
    return haplotypes.spaced_sites(tiles.snp_candidates(A.item(s, d), A.base_arrays, 40).select("contig_id", "pos", "score"))


def _haplotypes(s, d):
    """Sites, bases of templates at them, and the tenth of a weight for templates whose strands conflict."""
    items = A.item(s, d)
    sites = written(_sites(s, d), "sites")
    weights = P.strand_conflicts(items).select("contig_id", "template", F.lit(0.1).alias("weight")).distinct()
    return sites, tiles.template_bases(items, A.base_arrays, 40, 15), weights


def _chimera(s, d):
    sites, found, _ = _haplotypes(s, d)
    return haplotypes.chimera_scores(sites, found).withColumn("chimera", F.round("chimera", 6))


#: Reads 1 and 2, 3 and 4, .. of a template within 800 columns of contig ends, seen from both contigs.
EDGES = f"""WITH {A.ITEM}, ends AS (SELECT contig_id, min("start") AS f, max("end") AS l FROM item GROUP BY 1), near AS (
  SELECT item.*, "start" - f <= 800 OR l - "end" <= 800 AS at_end FROM item JOIN ends USING (contig_id)
) SELECT a.contig_id, b.contig_id AS mate_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE a.comp) > count(*) FILTER (WHERE NOT a.comp) THEN -1 ELSE 1 END AS side
FROM near a JOIN near b ON a.template = b.template AND (a.end_no - 1) // 2 = (b.end_no - 1) // 2 AND a.contig_id <> b.contig_id AND a.at_end AND b.at_end GROUP BY 1, 2"""
#: Windows of 15 letters, over the ends too; the two pads differ, so they agree with nothing.
SPANS = f"""WITH {A.SEQ}, {A.BENCH}, w1 AS (
  SELECT id, p, substr('-------' || seq || '-------', CAST(p + 7 AS BIGINT), 15) AS w FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) - 7 AS p FROM seqs WHERE length(seq) >= 15)
), w2 AS (
  SELECT id, p, substr('#######' || seq || '#######', CAST(p + 7 AS BIGINT), 15) AS w FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) - 7 AS p FROM probe WHERE length(seq) >= 15)
), shared AS (
  SELECT DISTINCT a.id AS id1, b.id AS id2 FROM (SELECT DISTINCT id, substr(seq, CAST(unnest(range(1, length(seq) - 14)) AS BIGINT), 16) AS w FROM seqs WHERE length(seq) >= 16) a
  JOIN (SELECT DISTINCT id, substr(seq, CAST(unnest(range(1, length(seq) - 14)) AS BIGINT), 16) AS w FROM probe WHERE length(seq) >= 16) b USING (w)
) SELECT id1, id2, w1.p AS pos1, w2.p AS pos2, 15 - hamming(w1.w, w2.w) AS score FROM shared JOIN w1 ON w1.id = id1 JOIN w2 ON w2.id = id2 WHERE hamming(w1.w, w2.w) <= 2"""


def _similar_spans(s, d):
    seqs, probes = A.seq(s, d), A.seq(s, d, "benchmark", "item_id")
    return spans.similar_spans(seqs, probes, spans.sharing_pairs(words(seqs, 16), words(probes, 16)), 15, 13)


def _signed_edges(s, d):
    items = A.item(s, d)
    return contig_order.signed_edges(P.mates(items), ranges.contig_ranges(A.visible(items)), 800)


#: Both ends of contigs, the left one mirrored; clipped parts against the calls, columns behind the end, sums along reads.
EXTENSION = f"""WITH {A.ITEM}, {A.BASES}, {A.VISIBLE}, pile AS (
  SELECT b.contig_id, b.pos, count(*) AS depth, {", ".join(f"count(*) FILTER (WHERE code = {i}) AS c{i}" for i in range(5))} FROM bases b JOIN vis v ON b.rec = v.rec AND b.pos BETWEEN v.vstart AND v.vend GROUP BY 1, 2
), calls AS (
  SELECT contig_id, pos, CASE WHEN 100 * greatest(c0, c1, c2, c3, c4) // depth < 50 THEN '-' WHEN c0 = greatest(c0, c1, c2, c3, c4) THEN 'A' WHEN c1 = greatest(c0, c1, c2, c3, c4) THEN 'C'
         WHEN c2 = greatest(c0, c1, c2, c3, c4) THEN 'G' WHEN c3 = greatest(c0, c1, c2, c3, c4) THEN 'T' ELSE '*' END AS base FROM pile
), sided AS (
  SELECT contig_id, 'right' AS side, rec, "start" AS s, "end" AS e, vend FROM vis UNION ALL SELECT contig_id, 'left', rec, -"end", -"start", -vstart FROM vis
), reads AS (
  SELECT * FROM (SELECT *, max(vend) OVER (PARTITION BY contig_id, side) AS last FROM sided) WHERE s <= last AND last <= e AND last - vend < 1024
), seen AS (
  SELECT r.*, b.pos, b.code AS told, CASE WHEN side = 'left' AND b.code < 4 THEN 3 - b.code ELSE b.code END AS code, CASE WHEN side = 'left' THEN -b.pos ELSE b.pos END - last AS place FROM reads r JOIN bases b ON r.rec = b.rec
), bad AS (
  SELECT contig_id, side, rec FROM seen LEFT JOIN calls USING (contig_id, pos) WHERE place > vend - last AND place <= 0 GROUP BY 1, 2, 3
  HAVING 100 * count(*) FILTER (WHERE coalesce(substr('ACGT*N', told + 1, 1) <> base, true)) // count(*) > 5
), kept AS (
  SELECT * FROM seen ANTI JOIN bad USING (contig_id, side, rec) WHERE place BETWEEN 1 AND 1024
), cols AS (
  SELECT contig_id, side, place, count(*) AS depth, {", ".join(f"count(*) FILTER (WHERE code = {i}) AS n{i}" for i in range(4))} FROM kept WHERE code < 4 GROUP BY 1, 2, 3 HAVING count(*) >= 2
), scored AS (
  SELECT *, CASE greatest(n0, n1, n2, n3) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END AS call, row_number() OVER (PARTITION BY contig_id, side ORDER BY place) AS i,
         CAST(round((2 * greatest(n0, n1, n2, n3) - depth) / depth::DOUBLE * 1e9::DOUBLE) AS BIGINT) AS gain FROM cols
), summed AS (
  SELECT *, CAST(sum(gain) OVER (PARTITION BY contig_id, side ORDER BY place) AS BIGINT) AS score FROM scored WHERE i = place
), best AS (
  SELECT contig_id, side, place AS grown FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, side ORDER BY score DESC, place DESC) AS r FROM summed WHERE score >= 0) WHERE r = 1
), fresh AS (
  SELECT s.*, grown FROM summed s JOIN best b ON s.contig_id = b.contig_id AND s.side = b.side AND s.place <= grown
), along AS (
  SELECT k.contig_id, k.side, k.rec, k.place, k.code = f.call AS same, sum(CASE WHEN k.code = f.call THEN 1 ELSE -3 END) OVER (PARTITION BY k.contig_id, k.side, k.rec ORDER BY k.place) AS total
  FROM kept k JOIN fresh f ON k.contig_id = f.contig_id AND k.side = f.side AND k.place = f.place
) """
GROWN = EXTENSION + "SELECT contig_id, side, CAST(any_value(grown) AS BIGINT) AS grown, string_agg(substr('ACGT', call + 1, 1), '' ORDER BY place) AS sequence FROM fresh GROUP BY 1, 2"
SHOWN = EXTENSION + "SELECT contig_id, side, rec, CAST(place AS BIGINT) AS clip FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, side, rec ORDER BY total DESC, place DESC) AS r FROM along WHERE same AND total >= 0) WHERE r = 1"


def _extensions(s, d):
    items = A.visible(A.item(s, d))
    reads = written(extension.end_reads(items), "end-reads")
    near = items.join(reads.select("rec").distinct(), "rec", "left_semi")
    # only what lies within reach of the contigs' ends is called
    last = reads.groupBy("contig_id").agg(F.max(F.when(F.col("side") == "right", F.col("last"))).alias("high"), F.min(F.when(F.col("side") == "left", -F.col("last"))).alias("low"))
    shown = items.join(last, "contig_id").filter((F.col("vend") > F.col("high") - extension.REACH) | (F.col("vstart") < F.col("low") + extension.REACH))
    calls = consensus.frequency_consensus(consensus.pileup(A.column_bases(shown.withColumns({"start": F.col("vstart"), "end": F.col("vend")}))))
    return extension.extensions(reads, A.bases(near), calls, 2)


QUERIES = {
    "j16_contig_extension": (lambda s, d: _extensions(s, d)[0], GROWN),
    "j16_extension_clips": (lambda s, d: _extensions(s, d)[1], SHOWN),
    "d40_signed_edges": (_signed_edges, EDGES),
    # paths are searched through each component in turn: tests/test_spans_order.py
    "d41_contig_order": (lambda s, d: contig_order.contig_order(written(_signed_edges(s, d), "contig-edges")), None),
    "d30_similar_spans": (_similar_spans, SPANS),
    "e56_spaced_sites": (lambda s, d: _sites(s, d).withColumn("score", F.round("score", 6)), SITES + "SELECT contig_id, pos, round(score, 6) AS score FROM site"),
    "e58_template_bases": (lambda s, d: _haplotypes(s, d)[1], SITES + "SELECT * FROM of_template"),
    "e59_chimera_scores": (_chimera, CHIMERA),
    # a search that works out links anew after each merge is no SQL: tests/test_haplotypes.py
    "d53_haplotype_sets": (lambda s, d: haplotypes.haplotype_sets(*_haplotypes(s, d), least=100.0, offset=0.5), None),
    "f34_minimal_coverage": (lambda s, d: coverage.minimal_coverage(A.item(s, d)), COVERAGE),
    "f10_difference_clips": (_difference_clips, DIFFERENCES),
    "a8_bam_round_trip": (_through_bam, f"WITH {A.ALIGNED} SELECT * FROM aligned"),
    "b6_alignment_records": (
        lambda s, d: _alignments(s, d).select(F.concat_ws("\t", "name", F.col("flag").cast("string"), "contig", F.col("pos").cast("string"), F.col("mqual").cast("string"), "cigar", F.when((F.col("next_contig") == F.col("contig")), "=").otherwise(F.col("next_contig")), F.col("next_pos").cast("string"), F.col("tlen").cast("string"), "seq", "qual", F.concat(F.lit("LB:Z:"), F.col("aux")["LB"])).alias("value")),
        f"WITH {A.ALIGNED} SELECT concat_ws(chr(9), name, flag, contig, pos, mqual, cigar, CASE WHEN next_contig = contig THEN '=' ELSE next_contig END, next_pos, tlen, seq, qual, 'LB:Z:' || library) AS value FROM aligned",
    ),
    "a19_column_pileup": (lambda s, d: pileups.placed_pileup(A.alignment_places(A.item(s, d)), A.placed_alignments), PILEUP),
    "n6_stream_pileup": (_streamed, PILEUP),
    "j13_alignment_columns": (lambda s, d: shuffling.columns_of(_reads(s, d)), COLUMNS + "SELECT * FROM col"),
    "j14_difference_scores": (
        lambda s, d: shuffling.difference_scores(shuffling.columns_of(_reads(s, d))),
        COLUMNS + f"SELECT contig_id, count(*) AS columns, CAST(sum(n) AS BIGINT) AS characters, round(sum(n - ({SQUARES}) / n::DOUBLE), 6) AS score FROM col GROUP BY 1",
    ),
    # rounds of alignments are no SQL: tests/test_shuffling.py
    "j11_shuffled_pads": (lambda s, d: shuffling.shuffled_pads(_reads(s, d), least_gain=0.01), None),
}
