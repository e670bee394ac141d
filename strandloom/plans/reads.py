"""Queries over reads, pairs, tags and scaffolds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import lists, pairs, ranges
from strandloom.sources import adapters as A

W = "WITH "
VIS = f"WITH {A.ITEM}, {A.VISIBLE} "
PAIRS = f"""WITH {A.ITEM}, pairs AS (
  SELECT template, max(library) AS library, {', '.join(f'max(CASE WHEN end_no % 2 = {n % 2} THEN {c} END) AS {d}{n}' for n in (1, 2) for c, d in (('rec', 'rec'), ('contig_id', 'contig_id'), ('"start"', 'start'), ('"end"', 'end'), ('comp', 'comp'), ('mqual', 'mqual')))}
  FROM item GROUP BY template, (end_no - 1) // 2 HAVING count(*) = 2
), status AS (
  SELECT template, library, CASE WHEN contig_id1 = contig_id2 THEN greatest(end1, end2) - least(start1, start2) END AS distance,
         CASE WHEN comp1 = comp2 THEN 'SAME' WHEN (CASE WHEN NOT comp1 AND comp2 THEN start1 < end2 ELSE start2 < end1 END) THEN 'INWARD' ELSE 'OUTWARD' END AS orientation,
         CASE WHEN contig_id1 <> contig_id2 THEN 'SPANNING' WHEN comp1 = comp2 THEN 'ORIENT' WHEN greatest(end1, end2) - least(start1, start2) > 3000 THEN 'DISTANCE' ELSE 'PAIRED' END AS status
  FROM pairs
), binned AS (
  SELECT library, orientation, greatest(0, CAST(floor(log2(greatest(least(distance, 1048576), 1) + 0.5)) AS INT) - 7) AS y, greatest(0, least(distance, 1048576)) AS x FROM status WHERE distance IS NOT NULL
), histogram AS (
  SELECT library, orientation, CAST(y * 128 + (x >> y) AS INT) AS bin, count(*) AS n FROM binned GROUP BY ALL
), sized AS (
  SELECT *, CAST((bin - greatest(0, bin // 128 - 1) * 128) << greatest(0, bin // 128 - 1) AS BIGINT) AS low FROM histogram
) """
STEPS = """ev AS (
  SELECT contig_id, pos, sum(d) AS d FROM (SELECT contig_id, "start" AS pos, 1 AS d FROM item UNION ALL SELECT contig_id, "end" + 1, -1 FROM item) GROUP BY ALL
), steps AS (
  SELECT contig_id, pos AS low, lead(pos) OVER w - 1 AS high, CAST(sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY contig_id ORDER BY pos)
)"""
BUCKETS = """parts AS (SELECT *, unnest(range("start" // 64, "end" // 64 + 1)) AS bucket FROM item)"""


def _items(spark, d):
    return A.item(spark, d)


def _visible(spark, d):
    return A.visible(A.item(spark, d))


def _pairs(spark, d):
    return pairs.mates(A.item(spark, d))


def _tags(spark, d):
    return A.tag(spark, d)


def _holes_sql(low: str, high: str, source: str) -> str:
    return f"""far AS (SELECT contig_id, {low} AS lo, max({high}) AS hi FROM {source} GROUP BY ALL),
  reach AS (SELECT *, max(hi) OVER (PARTITION BY contig_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM far),
  isl AS (SELECT *, sum(CASE WHEN r IS NULL OR lo > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM reach),
  islands AS (SELECT contig_id, CAST(island AS BIGINT) AS island, min(lo) AS low, max(hi) AS high FROM isl GROUP BY contig_id, island)"""


QUERIES = {
    "c1_reads_in_range": (
        lambda s, d: ranges.overlapping(_items(s, d), 1000, 2000).select("contig_id", "rec", "start", "end"),
        W + A.ITEM + 'SELECT contig_id, rec, "start", "end" FROM item WHERE "start" <= 2000 AND "end" >= 1000',
    ),
    "c17_clipped_position": (lambda s, d: _visible(s, d).select("rec", "vstart", "vend"), VIS + "SELECT rec, vstart, vend FROM vis"),
    "c28_tag_type": (lambda s, d: _tags(s, d).filter("type = 'PURC'").groupBy("contig_id").agg(F.min("start").alias("start")), W + A.TAG + """SELECT contig_id, min("start") AS "start" FROM tag WHERE type = 'PURC' GROUP BY 1"""),
    "c29_tag_comment": (lambda s, d: _tags(s, d).filter(F.col("comment").rlike("^(click|error) by .*7$")).select("tag_id", "comment"), W + A.TAG + "SELECT tag_id, comment FROM tag WHERE regexp_matches(comment, '^(click|error) by .*7$')"),
    "c38_tags_by_type": (lambda s, d: _tags(s, d).filter(F.col("type").isin("ERRO", "SIGN")).groupBy("contig_id", "type").agg(F.count("*").alias("n")), W + A.TAG + "SELECT contig_id, type, count(*) AS n FROM tag WHERE type IN ('ERRO', 'SIGN') GROUP BY 1, 2"),
    "e10_contig_ranges": (
        lambda s, d: ranges.contig_ranges(_visible(s, d)),
        VIS + 'SELECT contig_id, min("start") AS first_base, max("end") AS last_base, min(vstart) AS first_visible, max(vend) AS last_visible, count(*) AS n_reads, CAST(sum(length) AS BIGINT) AS n_bases, round(avg(vend - vstart + 1), 6) AS mean_used FROM vis GROUP BY contig_id',
    ),
    "e13_depth_windows": (
        lambda s, d: ranges.bucket_depth(_items(s, d), 64),
        W + A.ITEM + ", " + BUCKETS + 'SELECT contig_id, bucket, CAST(sum(least("end", bucket * 64 + 63) - greatest("start", bucket * 64) + 1) AS BIGINT) AS n_bases, CAST(sum(least("end", bucket * 64 + 63) - greatest("start", bucket * 64) + 1) AS BIGINT) // 64 AS avg_depth FROM parts GROUP BY 1, 2',
    ),
    "e14_depth_range": (
        lambda s, d: ranges.bucket_range(_items(s, d), 64),
        W + A.ITEM + ", " + STEPS + ", b AS (SELECT *, unnest(range(low // 64, high // 64 + 1)) AS bucket FROM steps WHERE high IS NOT NULL) SELECT contig_id, bucket, min(depth) AS min_depth, max(depth) AS max_depth, round(sum(depth * (least(high, bucket * 64 + 63) - greatest(low, bucket * 64) + 1)) / sum(least(high, bucket * 64 + 63) - greatest(low, bucket * 64) + 1), 6) AS mean_depth FROM b GROUP BY 1, 2",
    ),
    "e15_depth_levels": (
        lambda s, d: ranges.depth_levels(_items(s, d), [64, 256, 1024]),
        W + A.ITEM + ", " + BUCKETS + ', b AS (SELECT contig_id, bucket, CAST(sum(least("end", bucket * 64 + 63) - greatest("start", bucket * 64) + 1) AS BIGINT) AS n FROM parts GROUP BY 1, 2) ' + " UNION ALL ".join(f"SELECT {w} AS width, contig_id, bucket // {w // 64} AS bucket, CAST(sum(n) AS BIGINT) // {w} AS avg_depth FROM b GROUP BY ALL" for w in (64, 256, 1024)),
    ),
    "e16_depth_steps": (lambda s, d: ranges.depth_steps(_items(s, d)), W + A.ITEM + ", " + STEPS + "SELECT contig_id, low, high, depth FROM steps WHERE high IS NOT NULL"),
    "e19_strand_coverage": (
        lambda s, d: ranges.strand_coverage(_items(s, d), 64),
        W + A.ITEM + ", " + BUCKETS + "SELECT contig_id, bucket, count(*) FILTER (WHERE NOT comp) AS forward, count(*) FILTER (WHERE comp) AS reverse, count(*) FILTER (WHERE NOT comp) = 0 OR count(*) FILTER (WHERE comp) = 0 AS single_strand FROM parts GROUP BY 1, 2",
    ),
    "f31_contig_holes": (
        lambda s, d: ranges.holes(_visible(s, d), "vstart", "vend"),
        VIS + ", " + _holes_sql("vstart", "vend", "vis") + ", g AS (SELECT contig_id, high + 1 AS hole_start, lead(low) OVER (PARTITION BY contig_id ORDER BY low) - 1 AS hole_end FROM islands) SELECT * FROM g WHERE hole_end IS NOT NULL",
    ),
    "f32_islands": (lambda s, d: ranges.covered_islands(_visible(s, d), "vstart", "vend"), VIS + ", " + _holes_sql("vstart", "vend", "vis") + "SELECT * FROM islands"),
    "f33_visible_start": (lambda s, d: _visible(s, d).groupBy("contig_id").agg(F.min("vstart").alias("vstart")), VIS + "SELECT contig_id, min(vstart) AS vstart FROM vis GROUP BY 1"),
    "f35_single_read_contigs": (
        lambda s, d: ranges.single_read_contigs(_items(s, d).withColumn("contig_id", F.col("template"))),
        W + A.ITEM + "SELECT template AS contig_id, min(rec) AS rec FROM item GROUP BY 1 HAVING count(*) = 1",
    ),
    "d1_mates": (lambda s, d: _pairs(s, d).select("template", "rec1", "rec2", "contig_id1", "contig_id2"), PAIRS + "SELECT template, rec1, rec2, contig_id1, contig_id2 FROM pairs"),
    "d2_spanning_pairs": (
        lambda s, d: pairs.spanning_pairs(_pairs(s, d), 5, 2),
        PAIRS + """, signed AS (SELECT CASE WHEN comp1 THEN -contig_id1 ELSE contig_id1 END AS s1, CASE WHEN comp2 THEN -contig_id2 ELSE contig_id2 END AS s2, contig_id1 > contig_id2 AS flip FROM pairs WHERE contig_id1 <> contig_id2 AND least(mqual1, mqual2) >= 5)
        SELECT CASE WHEN flip THEN s2 ELSE s1 END AS contig_a, CASE WHEN flip THEN s1 ELSE s2 END AS contig_b, count(*) AS n_pairs FROM signed GROUP BY 1, 2 HAVING count(*) >= 2""",
    ),
    "d3_library_pairs": (
        lambda s, d: pairs.spanning_pairs(_pairs(s, d), 0, 1, ["O"]).select(F.col("contig_a"), "contig_b", "n_pairs"),
        PAIRS + """, signed AS (SELECT CASE WHEN comp1 THEN -contig_id1 ELSE contig_id1 END AS s1, CASE WHEN comp2 THEN -contig_id2 ELSE contig_id2 END AS s2, contig_id1 > contig_id2 AS flip FROM pairs WHERE contig_id1 <> contig_id2 AND library = 'O' AND least(mqual1, mqual2) >= 0)
        SELECT CASE WHEN flip THEN s2 ELSE s1 END AS contig_a, CASE WHEN flip THEN s1 ELSE s2 END AS contig_b, count(*) AS n_pairs FROM signed GROUP BY 1, 2""",
    ),
    "d6_template_info": (lambda s, d: pairs.template_status(_pairs(s, d)), PAIRS + "SELECT * FROM status"),
    "d13_linked_contigs": (
        lambda s, d: _items(s, d).join(_pairs(s, d).filter("contig_id1 <> contig_id2").select(F.explode(F.array("contig_id1", "contig_id2")).alias("contig_id")).distinct(), "contig_id", "left_semi").groupBy("contig_id").agg(F.count("*").alias("n")),
        PAIRS + "SELECT contig_id, count(*) AS n FROM item WHERE contig_id IN (SELECT contig_id1 FROM pairs WHERE contig_id1 <> contig_id2 UNION SELECT contig_id2 FROM pairs WHERE contig_id1 <> contig_id2) GROUP BY 1",
    ),
    "d39_contig_graph": (
        lambda s, d: pairs.contig_graph(_pairs(s, d), ranges.contig_ranges(_visible(s, d)), 800),
        PAIRS + """, ends AS (SELECT contig_id, min("start") AS f, max("end") AS l FROM item GROUP BY 1)
        SELECT least(contig_id1, contig_id2) AS contig_a, greatest(contig_id1, contig_id2) AS contig_b, count(*) AS n, CAST(sum(CASE WHEN comp1 = comp2 THEN -1 ELSE 1 END) AS BIGINT) AS sense
        FROM pairs JOIN ends a ON contig_id1 = a.contig_id JOIN ends b ON contig_id2 = b.contig_id
        WHERE contig_id1 <> contig_id2 AND (start1 - a.f <= 800 OR a.l - end1 <= 800) AND (start2 - b.f <= 800 OR b.l - end2 <= 800) GROUP BY 1, 2""",
    ),
    "d48_scaffold_contigs": (lambda s, d: A.scaffold_member(s, d).select("scaffold_id", "idx", "contig_id"), W + A.SCAFFOLD + "SELECT scaffold_id, idx, contig_id FROM member"),
    "d49_tags_on_reads": (
        lambda s, d: ranges.interval_join(_items(s, d).select("contig_id", "rec", "start", "end"), _tags(s, d).select("contig_id", "type", F.col("start").alias("rstart"), F.col("end").alias("rend")), "contig_id").groupBy("contig_id", "type").agg(F.count("*").alias("n_hits"), F.countDistinct("rec").alias("n_reads")),
        W + A.ITEM + ", " + A.TAG + 'SELECT item.contig_id, type, count(*) AS n_hits, count(DISTINCT rec) AS n_reads FROM item JOIN tag ON item.contig_id = tag.contig_id AND item."start" <= tag."end" AND item."end" >= tag."start" GROUP BY 1, 2',
    ),
    "e18_template_depth": (
        lambda s, d: ranges.depth_steps(pairs.template_depth(_items(s, d))),
        W + A.ITEM + ', item AS (SELECT contig_id, template, min("start") AS "start", max("end") AS "end" FROM item GROUP BY 1, 2), ' .replace(", item AS", ", spans AS") + STEPS.replace("FROM item", "FROM spans") + "SELECT contig_id, low, high, depth FROM steps WHERE high IS NOT NULL",
    ),
    "e28_insert_histogram": (lambda s, d: pairs.insert_histogram(pairs.template_status(_pairs(s, d))), PAIRS + "SELECT library, orientation, bin, n, low FROM sized"),
    "e29_library_quartiles": (
        lambda s, d: pairs.library_quartiles(pairs.insert_histogram(pairs.template_status(_pairs(s, d)))),
        PAIRS + """, run AS (SELECT *, sum(n) OVER (PARTITION BY library, orientation ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY library, orientation) AS total FROM sized)
        SELECT library, orientation, CAST(max(total) AS BIGINT) AS n, min(low) FILTER (WHERE cum >= ceil(total * 0.25)) AS q1, min(low) FILTER (WHERE cum >= ceil(total * 0.5)) AS median, min(low) FILTER (WHERE cum >= ceil(total * 0.75)) AS q3,
        round((min(low) FILTER (WHERE cum >= ceil(total * 0.75)) - min(low) FILTER (WHERE cum >= ceil(total * 0.25))) / 1.349, 6) AS sd FROM run GROUP BY 1, 2""",
    ),
    "e30_library_types": (
        lambda s, d: pairs.library_types(pairs.insert_histogram(pairs.template_status(_pairs(s, d)))),
        PAIRS + ", t AS (SELECT library, orientation AS lib_type, CAST(sum(n) AS BIGINT) AS n FROM sized GROUP BY 1, 2) SELECT library, lib_type, n, CAST(sum(n) OVER (PARTITION BY library) AS BIGINT) AS total FROM t QUALIFY row_number() OVER (PARTITION BY library ORDER BY n DESC, lib_type) = 1",
    ),
    "e34_template_summary": (
        lambda s, d: pairs.template_summary(_items(s, d)),
        W + A.ITEM + """SELECT template, count(*) AS n_reads, count(DISTINCT contig_id) AS n_contigs, count(DISTINCT comp) AS n_strands, max("end") - min("start") AS span, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT contig_id) > 1 THEN 'spanning' WHEN count(DISTINCT comp) = 2 THEN 'paired' ELSE 'one strand' END AS kind FROM item GROUP BY 1""",
    ),
    "e35_template_score": (
        lambda s, d: pairs.template_score(pairs.template_summary(_items(s, d))),
        W + A.ITEM + """, t AS (SELECT template, count(DISTINCT comp) AS st, CAST(greatest(max("end") - min("start"), 1) AS DOUBLE) AS span FROM item GROUP BY 1)
        SELECT template, round((CASE WHEN st = 2 THEN 1.0 ELSE 0.5 END)::DOUBLE * greatest(0.5::DOUBLE, CASE WHEN span < 200 THEN span / 200.0::DOUBLE WHEN span > 2000 THEN 2000.0::DOUBLE / span ELSE 1.0::DOUBLE END), 6) AS score FROM t""",
    ),
    "e63_status_counts": (lambda s, d: pairs.template_status(_pairs(s, d)).groupBy("library", "status").agg(F.count("*").alias("n")), PAIRS + "SELECT library, status, count(*) AS n FROM status GROUP BY 1, 2"),
    "e65_read_sizes": (lambda s, d: _items(s, d).groupBy("length").agg(F.count("*").alias("n")), W + A.ITEM + "SELECT length, count(*) AS n FROM item GROUP BY 1"),
    "k4_shift_right": (
        lambda s, d: ranges.shift_items(_items(s, d), 2500, 7).select("rec", "new_start", "new_end"),
        W + A.ITEM + 'SELECT rec, CASE WHEN "start" >= 2500 THEN "start" + 7 ELSE "start" END AS new_start, CASE WHEN "end" >= 2500 THEN "end" + 7 ELSE "end" END AS new_end FROM item',
    ),
    "k9_break_contigs": (
        lambda s, d: ranges.break_contigs(_visible(s, d), 2500, F.col("contig_id") + 1_000_000).select("contig_id", "rec"),
        VIS + ", snap AS (SELECT contig_id, min(vstart) FILTER (WHERE vstart >= 2500) AS cpos, min(vstart) AS least FROM vis GROUP BY 1) SELECT CASE WHEN vstart >= cpos AND least < cpos THEN vis.contig_id + 1000000 ELSE vis.contig_id END AS contig_id, rec FROM vis JOIN snap ON vis.contig_id = snap.contig_id",
    ),
    "k11_disassemble": (
        lambda s, d: ranges.disassemble(_items(s, d), _items(s, d).filter("mqual < 10"))[0].groupBy("contig_id").agg(F.count("*").alias("n"), F.min("start").alias("first_base")),
        W + A.ITEM + 'SELECT contig_id, count(*) AS n, min("start") AS first_base FROM item WHERE rec NOT IN (SELECT rec FROM item WHERE mqual < 10) GROUP BY 1',
    ),
    "k13_complement_contigs": (
        lambda s, d: ranges.complement_contigs(_items(s, d)).select("rec", "new_start", "new_end", "new_comp"),
        W + A.ITEM + ', u AS (SELECT contig_id, min("start") + max("end") AS m FROM item GROUP BY 1) SELECT rec, m - "end" AS new_start, m - "start" AS new_end, NOT comp AS new_comp FROM item JOIN u ON item.contig_id = u.contig_id',
    ),
    "k14_complement_scaffold": (
        lambda s, d: lists.complement_scaffold(A.scaffold_member(s, d)),
        W + A.SCAFFOLD + "SELECT scaffold_id, row_number() OVER w AS idx, -contig_id AS contig_id, coalesce(lag(gap_size) OVER w, 0) AS gap_size FROM member WINDOW w AS (PARTITION BY scaffold_id ORDER BY idx DESC)",
    ),
    "k17_delete_tags": (lambda s, d: _tags(s, d).filter(~F.col("type").isin("CLIC", "VIEW")).groupBy("type").agg(F.count("*").alias("n")), W + A.TAG + "SELECT type, count(*) AS n FROM tag WHERE type NOT IN ('CLIC', 'VIEW') GROUP BY 1"),
    "k27_check_reads": (
        lambda s, d: ranges.violations(_items(s, d)).groupBy("problem").agg(F.count("*").alias("n")),
        W + A.ITEM + """, p AS (SELECT 'no_quality' AS problem FROM item WHERE mqual <= 0 UNION ALL SELECT 'short' FROM item WHERE rclip - lclip < 4 UNION ALL SELECT 'empty' FROM item WHERE length < 1 UNION ALL SELECT 'span' FROM item WHERE "end" - "start" + 1 <> length UNION ALL SELECT 'left_clip' FROM item WHERE lclip < 1 OR lclip > length UNION ALL SELECT 'right_clip' FROM item WHERE rclip < lclip OR rclip > length) SELECT problem, count(*) AS n FROM p GROUP BY 1""",
    ),
    "h2_last_occurrence": (
        lambda s, d: lists.last_occurrences(A.table(s, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("place0")), "item", "place0"),
        "SELECT o_custkey AS item, max(o_orderkey) AS place FROM orders GROUP BY 1",
    ),
    "h4_list_subtract": (
        lambda s, d: lists.subtract(A.table(s, d, "customer").select("c_custkey"), A.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "h12_template_intersection": (
        lambda s, d: A.item(s, d).filter("comp").select("template").intersect(A.item(s, d).filter("not comp").select("template")),
        W + A.ITEM + "SELECT template FROM item WHERE comp INTERSECT SELECT template FROM item WHERE NOT comp",
    ),
    "h14_prune_tags": (
        lambda s, d: lists.prune_tags(_tags(s, d), F.when(F.col("type") == "ERRO", 0).when(F.col("type") == "PURC", 1).otherwise(2)).select("contig_id", "start", "tag_id", "type"),
        W + A.TAG + """SELECT contig_id, "start", tag_id, type FROM tag QUALIFY row_number() OVER (PARTITION BY contig_id, "start" ORDER BY CASE type WHEN 'ERRO' THEN 0 WHEN 'PURC' THEN 1 ELSE 2 END, tag_id) = 1""",
    ),
    "i71_tag_round_trip": (
        lambda s, d: _tags(s, d).select("tag_id", lists.parse_tag(lists.format_tag()).alias("t")).select("tag_id", "t.type", "t.strand", "t.start", "t.end", "t.comment"),
        W + A.TAG + """SELECT tag_id, type, CASE dir WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END AS strand, "start", "end", comment FROM tag""",
    ),
    "b13_agp": (
        lambda s, d: lists.agp(A.scaffold_member(s, d)),
        W + A.SCAFFOLD + """, p AS (SELECT *, CASE WHEN idx > 1 THEN gap_size ELSE 0 END AS gap, coalesce(sum(CASE WHEN idx > 1 THEN gap_size ELSE 0 END + length) OVER (PARTITION BY scaffold_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS a FROM member)
        SELECT scaffold_id, 2 * idx - 2 AS part, a AS low, a + gap - 1 AS high, 'N' AS kind, CAST(NULL AS BIGINT) AS contig_id, gap AS size FROM p WHERE gap > 0
        UNION ALL SELECT scaffold_id, 2 * idx - 1, a + gap, a + gap + length - 1, 'W', contig_id, length FROM p""",
    ),
    "b20_bam_bins": (
        lambda s, d: _items(s, d).select("rec", S.bam_bin(F.col("start") * 97, F.col("end") * 97 + 1).alias("bin")),
        W + A.ITEM + """, b AS (SELECT rec, "start" * 97 AS lo, "end" * 97 AS hi FROM item) SELECT rec, CASE WHEN lo >> 14 = hi >> 14 THEN 4681 + (lo >> 14) WHEN lo >> 17 = hi >> 17 THEN 585 + (lo >> 17) WHEN lo >> 20 = hi >> 20 THEN 73 + (lo >> 20) WHEN lo >> 23 = hi >> 23 THEN 9 + (lo >> 23) WHEN lo >> 26 = hi >> 26 THEN 1 + (lo >> 26) ELSE 0 END AS bin FROM b""",
    ),
}
