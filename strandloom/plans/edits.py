"""Queries that edit, each with its SQL for the table after the edit."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import edits as E
from strandloom.sources import adapters as A

ITEM = f"WITH {A.ITEM} "
SEQ = f"WITH {A.SEQ} "
TAG = f"WITH {A.TAG} "
SHIFT = """SELECT {id}, CASE WHEN "start" < 2500 THEN "start" ELSE greatest("start" + {n}, 2500) END AS new_start, CASE WHEN "end" < 2500 THEN "end" ELSE greatest("end" + {n}, {floor}) END AS new_end FROM {source}"""


def shift_sql(source: str, id_: str, n: int) -> str:
    return f"s AS ({SHIFT.format(id=id_, n=n, floor=2500 if n > 0 else 2499, source=source)}) SELECT * FROM s WHERE new_end >= new_start"



def _place():
    return (F.col("id") % 25 + 1).cast("int")


QUERIES = {
    "k1_insert_bases": (
        lambda s, d: A.seq(s, d).filter("length(seq) > 30").select("id", E.insert_bases(F.col("seq"), _place(), F.lit("NN")).alias("seq")),
        SEQ + "SELECT id, substr(seq, 1, CAST(id % 25 AS BIGINT)) || 'NN' || substr(seq, CAST(id % 25 + 1 AS BIGINT)) AS seq FROM seqs WHERE length(seq) > 30",
    ),
    "k2_delete_bases": (
        lambda s, d: A.seq(s, d).filter("length(seq) > 30").select("id", E.delete_bases(F.col("seq"), _place(), F.lit(3)).alias("seq")),
        SEQ + "SELECT id, substr(seq, 1, CAST(id % 25 AS BIGINT)) || substr(seq, CAST(id % 25 + 4 AS BIGINT)) AS seq FROM seqs WHERE length(seq) > 30",
    ),
    "k3_replace_base": (
        lambda s, d: A.seq(s, d).filter("length(seq) > 30").select("id", E.replace_base(F.col("seq"), _place(), F.lit("N")).alias("seq")),
        SEQ + "SELECT id, substr(seq, 1, CAST(id % 25 AS BIGINT)) || 'N' || substr(seq, CAST(id % 25 + 2 AS BIGINT)) AS seq FROM seqs WHERE length(seq) > 30",
    ),
    "k5_delete_columns": (lambda s, d: E.shifted(A.item(s, d), F.lit(2500), -4).select("rec", "new_start", "new_end"), ITEM + ", " + shift_sql("item", "rec", -4)),
    "k6_shift_right": (lambda s, d: E.shifted(A.item(s, d), F.lit(2500), 9).select("rec", "new_start", "new_end"), ITEM + ", " + shift_sql("item", "rec", 9)),
    "k7_move_contigs": (
        lambda s, d: E.moved_contigs(A.item(s, d), A.scaffold_member(s, d).filter("contig_id % 2 = 0").select("contig_id", F.col("gap_size").alias("offset"))),
        ITEM + f', {A.SCAFFOLD}, o AS (SELECT contig_id, gap_size FROM member WHERE contig_id % 2 = 0) SELECT rec, item.contig_id, "start" + coalesce(gap_size, 0) AS "start", "end" + coalesce(gap_size, 0) AS "end" FROM item LEFT JOIN o ON item.contig_id = o.contig_id',
    ),
    "k8_visible_start": (
        lambda s, d: E.from_visible_start(A.visible(A.item(s, d))),
        ITEM + f', {A.VISIBLE}, f AS (SELECT contig_id, min(vstart) AS first FROM vis GROUP BY 1) SELECT rec, vis.contig_id, "start" - first + 1 AS "start", "end" - first + 1 AS "end" FROM vis JOIN f ON vis.contig_id = f.contig_id',
    ),
    "k10_break_counts": (
        lambda s, d: A.visible(A.item(s, d)).groupBy("contig_id").agg(F.count(F.when(F.col("vstart") < 2500, 1)).alias("n_left"), F.count(F.when(F.col("vstart") >= 2500, 1)).alias("n_right")),
        ITEM + f", {A.VISIBLE} SELECT contig_id, count(*) FILTER (WHERE vstart < 2500) AS n_left, count(*) FILTER (WHERE vstart >= 2500) AS n_right FROM vis GROUP BY 1",
    ),
    "k12_disassemble_contigs": (
        lambda s, d: A.item(s, d).join(A.scaffold_member(s, d).filter("length > 500").select("contig_id"), "contig_id", "left_anti").groupBy("contig_id").agg(F.count("*").alias("n")),
        ITEM + f", {A.SCAFFOLD} SELECT contig_id, count(*) AS n FROM item WHERE contig_id NOT IN (SELECT contig_id FROM member WHERE length > 500) GROUP BY 1",
    ),
    "k15_scaffold_add": (
        lambda s, d: E.added_members(A.scaffold_member(s, d), A.table(s, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_nationkey").cast("long").alias("scaffold_id"), (F.col("c_custkey") + 1_000_000).alias("contig_id"))),
        f"WITH {A.SCAFFOLD}, n AS (SELECT CAST(c_nationkey AS BIGINT) AS scaffold_id, c_custkey + 1000000 AS contig_id FROM customer WHERE c_custkey % 5 = 0), l AS (SELECT scaffold_id, max(idx) AS last FROM member GROUP BY 1) SELECT scaffold_id, idx, contig_id FROM member UNION ALL SELECT n.scaffold_id, coalesce(last, 0) + row_number() OVER (PARTITION BY n.scaffold_id ORDER BY contig_id), contig_id FROM n LEFT JOIN l ON n.scaffold_id = l.scaffold_id",
    ),
    "k15_scaffold_remove": (
        lambda s, d: E.removed_members(A.scaffold_member(s, d), A.scaffold_member(s, d).filter("length < 400")),
        f"WITH {A.SCAFFOLD} SELECT scaffold_id, row_number() OVER (PARTITION BY scaffold_id ORDER BY idx) AS idx, contig_id FROM member WHERE length >= 400",
    ),
    "k16_create_tags": (
        lambda s, d: A.tag(s, d).select("contig_id", "type", "start", "end").unionByName(A.item(s, d).filter("mqual >= 38").select("contig_id", F.lit("COMM").alias("type"), "start", "end")).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("span")),
        f"""WITH {A.ITEM}, {A.TAG}, t AS (SELECT type, "end" - "start" AS l FROM tag UNION ALL SELECT 'COMM', "end" - "start" FROM item WHERE mqual >= 38) SELECT type, count(*) AS n, CAST(sum(l) AS BIGINT) AS span FROM t GROUP BY 1""",
    ),
    "k18_set_comments": (
        lambda s, d: A.tag(s, d).select("tag_id", F.when(F.col("type") == "ERRO", F.concat(F.lit("checked: "), "comment")).otherwise(F.col("comment")).alias("comment"), F.when(F.col("type") == "ERRO", "=").otherwise(F.col("dir")).alias("dir")),
        TAG + "SELECT tag_id, CASE WHEN type = 'ERRO' THEN 'checked: ' || comment ELSE comment END AS comment, CASE WHEN type = 'ERRO' THEN '=' ELSE dir END AS dir FROM tag",
    ),
    "k19_tags_after_insert": (lambda s, d: E.shifted(A.tag(s, d), F.lit(2500), 6).select("tag_id", "new_start", "new_end"), TAG + ", " + shift_sql("tag", "tag_id", 6)),
    "k19_tags_after_delete": (lambda s, d: E.shifted(A.tag(s, d), F.lit(2500), -30).select("tag_id", "new_start", "new_end"), TAG + ", " + shift_sql("tag", "tag_id", -30)),
    "k20_new_libraries": (
        lambda s, d: A.item(s, d).select("library").unionByName(A.table(s, d, "nation").select(F.upper(F.substring("n_name", 1, 1)).alias("library"))).distinct(),
        ITEM + "SELECT library FROM item UNION SELECT upper(substr(n_name, 1, 1)) FROM nation",
    ),
    "k21_renamed_contigs": (
        lambda s, d: A.item(s, d).select("contig_id").distinct().join(A.scaffold_member(s, d).select("contig_id", F.concat(F.lit("s"), "scaffold_id", F.lit("."), "idx").alias("new_name")), "contig_id", "left").select("contig_id", F.coalesce("new_name", F.concat(F.lit("ctg"), "contig_id")).alias("name")),
        ITEM + f", {A.SCAFFOLD}, c AS (SELECT DISTINCT contig_id FROM item) SELECT c.contig_id, coalesce('s' || scaffold_id || '.' || idx, 'ctg' || c.contig_id) AS name FROM c LEFT JOIN member ON c.contig_id = member.contig_id",
    ),
    "k22_edited_notes": (
        lambda s, d: A.table(s, d, "events").filter("event_type <> 'view'").select("event_id", F.when(F.col("event_type") == "error", "ERRO").otherwise("NOTE").alias("type")).groupBy("type").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN event_type = 'error' THEN 'ERRO' ELSE 'NOTE' END AS type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1",
    ),
    "k24_renumbered_reads": (
        lambda s, d: E.renumbered(A.item(s, d), [F.desc("mqual"), F.col("rec")]),
        ITEM + "SELECT contig_id, rec, row_number() OVER w AS place, lag(rec) OVER w AS left_rec, lead(rec) OVER w AS right_rec FROM item WINDOW w AS (PARTITION BY contig_id ORDER BY mqual DESC, rec)",
    ),
    "k25_split_tags": (
        lambda s, d: E.split_tags(A.tag(s, d), F.lit(2500), F.col("contig_id") + 1_000_000),
        TAG + """SELECT tag_id, contig_id, "start", least("end", 2499) AS "end" FROM tag WHERE "start" < 2500 UNION ALL SELECT tag_id, contig_id + 1000000, greatest("start", 2500) - 2500, "end" - 2500 FROM tag WHERE "end" >= 2500""",
    ),
    "k28_contig_check": (
        lambda s, d: E.contig_problems(A.item(s, d), A.scaffold_member(s, d).filter("length > 300")).groupBy("problem").agg(F.count("*").alias("n"), F.min("of").alias("first")),
        ITEM + f", {A.SCAFFOLD}, m AS (SELECT * FROM member WHERE length > 300), p AS (SELECT 'in several scaffolds' AS problem, contig_id AS o FROM m GROUP BY contig_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'contig without scaffold', contig_id FROM item WHERE contig_id NOT IN (SELECT contig_id FROM m) UNION ALL SELECT 'template on many contigs', template FROM item GROUP BY template HAVING count(DISTINCT contig_id) > 2) SELECT problem, count(*) AS n, min(o) AS first FROM p GROUP BY 1",
    ),
    "k29_read_check": (
        lambda s, d: A.item(s, d).filter("mqual = 0 or rclip - lclip < 6").groupBy("contig_id").agg(F.count("*").alias("n")),
        ITEM + "SELECT contig_id, count(*) AS n FROM item WHERE mqual = 0 OR rclip - lclip < 6 GROUP BY 1",
    ),
}
