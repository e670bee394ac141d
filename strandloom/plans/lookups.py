"""Queries that look up, search, order and list, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import composition as C
from strandloom.operators import lookups as L
from strandloom.operators import pairs, ranges
from strandloom.sources import adapters as A

from .reads import PAIRS

NAMED = f"WITH {A.ITEM}, named AS (SELECT *, 'r' || rec AS name, 't' || template AS template_name, 'ctg' || contig_id AS contig_name FROM item) "
REFS = "refs AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN '#' || (o_orderkey * 1000 + 1) WHEN 1 THEN '=' || (o_custkey % 200) WHEN 2 THEN 'ctg' || (o_custkey % 200) ELSE 'r' || (o_orderkey * 1000 + 2) END AS ref FROM orders)"
NAMES = "refs AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey ELSE 'r' || (o_orderkey * 1000 + 2) END AS ref FROM orders)"
SPECS = """specs AS (SELECT event_id, user_id % 100 + 1 AS contig_id, CASE event_id % 4 WHEN 0 THEN '@' WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '' END || (event_id * 7 % 1000) AS spec FROM events)"""
ENDS = """ends AS (SELECT contig_id, min("start") AS first_base, max("end") AS last_base FROM item GROUP BY 1)"""
MARKS = "marks AS (SELECT user_id % 100 + 1 AS contig_id, event_id * 13 % 5000 AS pos, event_id * 13 % 5000 * 2 + event_id % 5 AS ref_pos, CASE event_id % 3 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'REF' END AS kind FROM events)"


def _named(s, d):
    return L.named(A.item(s, d))


def _refs(s, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = F.when(o % 4 == 0, F.concat(F.lit("#"), o * 1000 + 1)).when(o % 4 == 1, F.concat(F.lit("="), c % 200)).when(o % 4 == 2, F.concat(F.lit("ctg"), c % 200)).otherwise(F.concat(F.lit("r"), o * 1000 + 2))
    return A.table(s, d, "orders").select(ref.alias("ref"))


def _names(s, d):
    o = F.col("o_orderkey")
    return A.table(s, d, "orders").select(F.when(o % 2 == 0, F.concat(F.lit("t"), o)).otherwise(F.concat(F.lit("r"), o * 1000 + 2)).alias("ref"))


def _specs(s, d):
    e = F.col("event_id")
    sign = F.when(e % 4 == 0, "@").when(e % 4 == 1, "+").when(e % 4 == 2, "-").otherwise("")
    return A.table(s, d, "events").select("event_id", (F.col("user_id") % 100 + 1).alias("contig_id"), F.concat(sign, e * 7 % 1000).alias("spec"))


def _ends(s, d):
    return A.item(s, d).groupBy("contig_id").agg(F.min("start").alias("first_base"), F.max("end").alias("last_base"))


def _marks(s, d):
    """Reference markers on contigs: pos, ref_pos, kind."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "INS").when(e % 3 == 1, "DEL").otherwise("REF")
    return A.table(s, d, "events").select((F.col("user_id") % 100 + 1).alias("contig_id"), (e * 13 % 5000).alias("pos"), (e * 13 % 5000 * 2 + e % 5).alias("ref_pos"), kind.alias("kind"))


def _pairs(s, d):
    return pairs.mates(A.item(s, d))


def _sizes(s, d):
    return A.item(s, d).groupBy("contig_id").agg(F.count("*").alias("n_reads"), (F.max("end") - F.min("start") + 1).alias("size"))


SIZES = """sizes AS (SELECT contig_id, count(*) AS n_reads, max("end") - min("start") + 1 AS size FROM item GROUP BY 1)"""

QUERIES = {
    "c9_read_by_name": (lambda s, d: _named(s, d).filter("name = 'r3001'").select("name", "rec", "contig_id"), NAMED + "SELECT name, rec, contig_id FROM named WHERE name = 'r3001'"),
    "c10_reads_by_prefix": (lambda s, d: _named(s, d).filter(F.col("name").startswith("r12")).select("name", "rec"), NAMED + "SELECT name, rec FROM named WHERE name LIKE 'r12%'"),
    "c11_reads_of_a_name": (lambda s, d: _named(s, d).filter("template_name = 't7'").select("template_name", "rec"), NAMED + "SELECT template_name, rec FROM named WHERE template_name = 't7'"),
    "c12_contigs_by_prefix": (lambda s, d: _named(s, d).filter(F.col("contig_name").startswith("ctg1")).select("contig_name", "contig_id").distinct(), NAMED + "SELECT DISTINCT contig_name, contig_id FROM named WHERE contig_name LIKE 'ctg1%'"),
    "c13_scaffold_by_name": (
        lambda s, d: A.scaffold_member(s, d).withColumn("name", F.concat(F.lit("scaf"), "scaffold_id")).filter("name in ('scaf3', 'scaf4')").groupBy("name").agg(F.count("*").alias("n")),
        f"WITH {A.SCAFFOLD} SELECT 'scaf' || scaffold_id AS name, count(*) AS n FROM member WHERE 'scaf' || scaffold_id IN ('scaf3', 'scaf4') GROUP BY 1",
    ),
    "c14_resolve_contigs": (
        lambda s, d: L.resolve_contigs(_refs(s, d), A.item(s, d)),
        NAMED + f", {REFS}, reads AS (SELECT '#' || rec AS ref, contig_id FROM item UNION ALL SELECT name, contig_id FROM named UNION ALL SELECT DISTINCT '=' || contig_id, contig_id FROM item UNION ALL SELECT DISTINCT contig_name, contig_id FROM named) SELECT refs.ref, contig_id FROM refs LEFT JOIN reads ON refs.ref = reads.ref",
    ),
    "c15_resolve_records": (
        lambda s, d: L.resolve_records(_names(s, d), A.item(s, d)),
        NAMED + f", {NAMES}, known AS (SELECT name AS ref, rec FROM named UNION ALL SELECT template_name, min(rec) FROM named GROUP BY 1) SELECT refs.ref, rec FROM refs LEFT JOIN known ON refs.ref = known.ref",
    ),
    "c16_read_positions": (
        lambda s, d: _named(s, d).select("name", "contig_id", F.col("start").alias("low"), F.col("end").alias("high"), F.when(F.col("comp"), -1).otherwise(1).alias("orientation")),
        NAMED + 'SELECT name, contig_id, "start" AS low, "end" AS high, CASE WHEN comp THEN -1 ELSE 1 END AS orientation FROM named',
    ),
    "c19_position_search": (
        lambda s, d: _specs(s, d).join(_ends(s, d), "contig_id").withColumn("place", L.searched_position(F.col("spec"), 500, F.col("first_base"))).filter("place between first_base and last_base").select("event_id", "contig_id", "place"),
        f"WITH {A.ITEM}, {ENDS}, {SPECS}, p AS (SELECT event_id, specs.contig_id, first_base, last_base, CASE event_id % 4 WHEN 0 THEN first_base + event_id * 7 % 1000 WHEN 1 THEN 500 + event_id * 7 % 1000 WHEN 2 THEN 500 - event_id * 7 % 1000 ELSE event_id * 7 % 1000 END AS place FROM specs JOIN ends ON specs.contig_id = ends.contig_id) SELECT event_id, contig_id, place FROM p WHERE place BETWEEN first_base AND last_base",
    ),
    "c20_unpadded_position": (
        lambda s, d: C.pad_map(A.padded(s, d)).filter("unpadded = 25").select("id", "padded"),
        f"WITH {A.PADDED}, b AS (SELECT id, pos FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM padded) WHERE substr(seq, pos, 1) <> '*') SELECT id, pos AS padded FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 25",
    ),
    "c27_names_in_contig": (
        lambda s, d: _named(s, d).filter((F.col("contig_id") <= 20) & (F.col("name").startswith("r1") | (F.col("rec") == 2001))).groupBy("contig_id").agg(F.min("start").alias("first"), F.count("*").alias("n")),
        NAMED + """SELECT contig_id, min("start") AS first, count(*) AS n FROM named WHERE contig_id <= 20 AND (name LIKE 'r1%' OR rec = 2001) GROUP BY 1""",
    ),
    "c30_indel_markers": (lambda s, d: _marks(s, d).filter("kind in ('INS', 'DEL') and pos >= 100").groupBy("contig_id", "kind").agg(F.min("pos").alias("pos")), f"WITH {MARKS} SELECT contig_id, kind, min(pos) AS pos FROM marks WHERE kind IN ('INS', 'DEL') AND pos >= 100 GROUP BY 1, 2"),
    "c31_edited_bases": (
        lambda s, d: A.bases(A.item(s, d)).filter("qual = 0 and code < 4").groupBy("contig_id").agg(F.min("pos").alias("pos"), F.count("*").alias("n")),
        f"WITH {A.ITEM}, {A.BASES} SELECT contig_id, min(pos) AS pos, count(*) AS n FROM bases WHERE qual = 0 AND code < 4 GROUP BY 1",
    ),
    "c37_plot_filter": (
        lambda s, d: L.plot_filter(_pairs(s, d), 0, 20, 90),
        PAIRS + ", q AS (SELECT rec1, rec2, CAST(greatest(0, least(255, 3 * ((mqual1 + mqual2) // 2))) AS INT) AS quality, contig_id1 <> contig_id2 AS spans FROM pairs) SELECT * FROM q WHERE quality BETWEEN 20 AND 90",
    ),
    "c39_feature_qualifiers": (
        lambda s, d: A.tag(s, d).select("tag_id", L.qualifiers(F.concat(F.lit('/gene="'), "type", F.lit('" /note="'), "comment", F.lit('"'))).alias("q")).filter("element_at(q, 'gene') = 'SIGN'").select("tag_id", F.col("q")["note"].alias("note")),
        f"WITH {A.TAG} SELECT tag_id, comment AS note FROM tag WHERE type = 'SIGN'",
    ),
    "d10_pair_reading_list": (
        lambda s, d: L.with_mates(A.item(s, d).filter("mqual >= 36"), _pairs(s, d)),
        PAIRS + ", chosen AS (SELECT rec FROM item WHERE mqual >= 36), m AS (SELECT rec1 AS rec, rec2 AS mate FROM pairs UNION ALL SELECT rec2, rec1 FROM pairs) SELECT rec FROM chosen UNION SELECT mate FROM m WHERE rec IN (SELECT rec FROM chosen)",
    ),
    "d46_contig_links": (
        lambda s, d: L.contig_links(_pairs(s, d), _ends(s, d)),
        PAIRS + f", {ENDS} SELECT template, rec1, contig_id1, (start1 - a.first_base > a.last_base - start1)::INT AS end1, least(start1 - a.first_base, a.last_base - start1) AS pos1, contig_id2, (start2 - b.first_base > b.last_base - start2)::INT AS end2, least(start2 - b.first_base, b.last_base - start2) AS pos2 FROM pairs JOIN ends a ON contig_id1 = a.contig_id JOIN ends b ON contig_id2 = b.contig_id WHERE contig_id1 <> contig_id2",
    ),
    "d47_link_positions": (
        lambda s, d: L.link_positions(L.contig_links(_pairs(s, d), _ends(s, d)), _ends(s, d)),
        PAIRS + "SELECT template, rec1, start1 AS at1, start2 AS at2 FROM pairs WHERE contig_id1 <> contig_id2",
    ),
    "g1_contigs_by_size": (
        lambda s, d: L.ranked(_sizes(s, d), [F.desc("size"), F.col("contig_id")], 20).select("place", "contig_id", "size"),
        f"WITH {A.ITEM}, {SIZES} SELECT row_number() OVER (ORDER BY size DESC, contig_id) AS place, contig_id, size FROM sizes ORDER BY size DESC, contig_id LIMIT 20",
    ),
    "g1_contigs_by_reads": (
        lambda s, d: L.ranked(_sizes(s, d), [F.desc("n_reads"), F.col("contig_id")], 20).select("place", "contig_id", "n_reads"),
        f"WITH {A.ITEM}, {SIZES} SELECT row_number() OVER (ORDER BY n_reads DESC, contig_id) AS place, contig_id, n_reads FROM sizes ORDER BY n_reads DESC, contig_id LIMIT 20",
    ),
    "g7_equal_sequences": (
        lambda s, d: A.seq(s, d).groupBy(F.md5("seq").alias("digest")).agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("first", "n"),
        f"WITH {A.SEQ} SELECT min(id) AS first, count(*) AS n FROM seqs GROUP BY seq HAVING count(*) > 1",
    ),
    "g8_scaffold_order": (
        lambda s, d: L.ranked(A.scaffold_member(s, d), [F.desc("length"), F.col("contig_id")], 1 << 30, ["scaffold_id"]).select("scaffold_id", "contig_id", "place"),
        f"WITH {A.SCAFFOLD} SELECT scaffold_id, contig_id, row_number() OVER (PARTITION BY scaffold_id ORDER BY length DESC, contig_id) AS place FROM member",
    ),
    "g9_names_in_order": (
        lambda s, d: L.ranked(_named(s, d).select("name", "rec"), [F.col("name"), F.col("rec")], 100),
        NAMED + "SELECT row_number() OVER (ORDER BY name, rec) AS place, name, rec FROM named ORDER BY name, rec LIMIT 100",
    ),
    "g10_pairs_in_order": (
        lambda s, d: L.ranked(_pairs(s, d).select("template", "rec1", "rec2"), [F.col("rec2").desc(), F.col("rec1")], 100),
        PAIRS + "SELECT row_number() OVER (ORDER BY rec2 DESC, rec1) AS place, template, rec1, rec2 FROM pairs ORDER BY rec2 DESC, rec1 LIMIT 100",
    ),
    "g11_templates_by_problem": (
        lambda s, d: L.ranked(pairs.template_status(_pairs(s, d)).groupBy("template").agg(F.min("status").alias("status"), F.max("distance").alias("distance")).withColumn("kind", F.when(F.col("status") == "PAIRED", 0).when(F.col("status") == "SPANNING", 1).when(F.col("status") == "DISTANCE", 2).otherwise(3)), [F.col("kind"), F.desc_nulls_last("distance"), F.col("template")], 200).select("place", "template", "kind"),
        PAIRS + """, t AS (SELECT template, min(status) AS status, max(distance) AS distance FROM status GROUP BY 1), k AS (SELECT *, CASE status WHEN 'PAIRED' THEN 0 WHEN 'SPANNING' THEN 1 WHEN 'DISTANCE' THEN 2 ELSE 3 END AS kind FROM t), r AS (SELECT row_number() OVER (ORDER BY kind, distance DESC NULLS LAST, template) AS place, template, kind FROM k) SELECT * FROM r WHERE place <= 200""",
    ),
    "g13_top_words": (
        lambda s, d: L.ranked(C.words(A.seq(s, d), 6).groupBy("word").agg(F.count("*").alias("n")), [F.desc("n"), F.col("word")], 25),
        f"WITH {A.SEQ}, w AS (SELECT substr(seq, pos, 6) AS word FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS pos FROM seqs WHERE length(seq) >= 6)), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, word) AS place, word, n FROM c ORDER BY n DESC, word LIMIT 25",
    ),
    "g17_neighbours": (
        lambda s, d: A.item(s, d).selectExpr("rec", "lag(rec) over (partition by contig_id order by start, rec) as before", "lead(rec) over (partition by contig_id order by start, rec) as after"),
        f'WITH {A.ITEM} SELECT rec, lag(rec) OVER w AS before, lead(rec) OVER w AS after FROM item WINDOW w AS (PARTITION BY contig_id ORDER BY "start", rec)',
    ),
    "h1_list_append": (
        lambda s, d: L.appended(A.item(s, d).filter("mqual > 30").select("rec"), A.item(s, d).filter("comp").select("rec")).groupBy("rec").agg(F.count("*").alias("n")),
        f"WITH {A.ITEM} SELECT rec, count(*) AS n FROM (SELECT rec FROM item WHERE mqual > 30 UNION ALL SELECT rec FROM item WHERE comp) GROUP BY 1",
    ),
    "h3_last_occurrence": (lambda s, d: A.table(s, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.max("o_orderkey").alias("place")), "SELECT o_custkey AS item, max(o_orderkey) AS place FROM orders GROUP BY 1"),
    "h4_unlisted_reads": (
        lambda s, d: A.item(s, d).select("rec").join(A.item(s, d).filter("mqual > 10").select("rec"), "rec", "left_anti"),
        f"WITH {A.ITEM} SELECT rec FROM item EXCEPT SELECT rec FROM item WHERE mqual > 10",
    ),
    "h5_contigs_to_reads": (lambda s, d: L.contig_lists(A.item(s, d), [3, 5, 8]), f"WITH {A.ITEM} SELECT contig_id, rec FROM item WHERE contig_id IN (3, 5, 8)"),
    "h6_listed_reads": (lambda s, d: L.resolve_records(_names(s, d), A.item(s, d)).filter("rec is not null").select("rec").distinct(), NAMED + f", {NAMES}, known AS (SELECT name AS ref, rec FROM named UNION ALL SELECT template_name, min(rec) FROM named GROUP BY 1) SELECT DISTINCT rec FROM refs JOIN known ON refs.ref = known.ref"),
    "h7_listed_ranges": (
        lambda s, d: L.list_items(A.table(s, d, "customer").select(F.concat_ws(" ", (F.col("c_custkey") % 150).cast("string"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") * 3).cast("string")), F.when(F.col("c_custkey") % 3 > 1, (F.col("c_custkey") * 3 + 100).cast("string"))).alias("item")), _ends(s, d)),
        f"WITH {A.ITEM}, {ENDS}, l AS (SELECT c_custkey % 150 AS contig_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 3 END AS s, CASE WHEN c_custkey % 3 > 1 THEN c_custkey * 3 + 100 END AS e FROM customer) SELECT concat_ws(' ', l.contig_id, s, e) AS item, l.contig_id, coalesce(s, first_base) AS \"start\", coalesce(e, last_base) AS \"end\" FROM l JOIN ends ON l.contig_id = ends.contig_id",
    ),
    "h8_listed_contigs": (
        lambda s, d: L.resolve_contigs(_refs(s, d), A.item(s, d)).filter("contig_id is not null").groupBy("contig_id").agg(F.count("*").alias("n")),
        NAMED + f", {REFS}, known AS (SELECT '#' || rec AS ref, contig_id FROM item UNION ALL SELECT name, contig_id FROM named UNION ALL SELECT DISTINCT '=' || contig_id, contig_id FROM item UNION ALL SELECT DISTINCT contig_name, contig_id FROM named) SELECT contig_id, count(*) AS n FROM refs JOIN known ON refs.ref = known.ref GROUP BY 1",
    ),
    "h9_scaffold_reads": (
        lambda s, d: A.item(s, d).join(A.scaffold_member(s, d).filter("scaffold_id < 12").select("contig_id", "scaffold_id", "idx"), "contig_id").groupBy("scaffold_id", "idx", "contig_id").agg(F.count("*").alias("n")),
        f"WITH {A.ITEM}, {A.SCAFFOLD} SELECT scaffold_id, idx, contig_id, count(*) AS n FROM item JOIN member USING (contig_id) WHERE scaffold_id < 12 GROUP BY ALL",
    ),
    "h10_numbers_to_names": (
        lambda s, d: A.table(s, d, "orders").select((F.col("o_orderkey") * 1000 + 1).alias("rec")).join(_named(s, d).select("rec", "name"), "rec", "left"),
        NAMED + "SELECT o_orderkey * 1000 + 1 AS rec, name FROM orders LEFT JOIN named ON o_orderkey * 1000 + 1 = rec",
    ),
    "h11_template_sets": (
        lambda s, d: L.template_sets(A.item(s, d)),
        f"WITH {A.ITEM}, t AS (SELECT contig_id, template, max(comp::INT) AS c, min(comp::INT) AS f FROM item GROUP BY 1, 2) SELECT contig_id, count(*) AS in_either, count(*) FILTER (WHERE c = 1 AND f = 0) AS in_both FROM t GROUP BY 1",
    ),
    "h15_new_sequences": (
        lambda s, d: A.seq(s, d).groupBy("seq").agg(F.min("id").alias("id")).select("id"),
        f"WITH {A.SEQ} SELECT min(id) AS id FROM seqs GROUP BY seq",
    ),
    "i13_padded_to_reference": (
        lambda s, d: L.last_marker(A.tag(s, d).select("tag_id", "contig_id", F.col("end").alias("pos")), _marks(s, d).filter("kind = 'REF'"), "pos", "pos", "ref_pos").select("tag_id", (F.col("marked") + F.col("pos") - F.col("marker")).alias("ref_pos")),
        f"WITH {A.TAG}, {MARKS}, m AS (SELECT contig_id, pos, max(ref_pos) AS ref_pos FROM marks WHERE kind = 'REF' GROUP BY 1, 2) SELECT tag_id, m.ref_pos + tag.\"end\" - m.pos AS ref_pos FROM tag ASOF LEFT JOIN m ON tag.contig_id = m.contig_id AND tag.\"end\" >= m.pos",
    ),
    "i14_reference_to_padded": (
        lambda s, d: L.last_marker(A.tag(s, d).select("tag_id", "contig_id", (F.col("start") * 2).alias("ref")), _marks(s, d).filter("kind = 'REF'"), "ref", "ref_pos", "pos").select("tag_id", (F.col("marked") + F.col("ref") - F.col("marker")).alias("pos")),
        f"WITH {A.TAG}, {MARKS}, m AS (SELECT contig_id, ref_pos, max(pos) AS pos FROM marks WHERE kind = 'REF' GROUP BY 1, 2) SELECT tag_id, m.pos + tag.\"start\" * 2 - m.ref_pos AS pos FROM tag ASOF LEFT JOIN m ON tag.contig_id = m.contig_id AND tag.\"start\" * 2 >= m.ref_pos",
    ),
}
