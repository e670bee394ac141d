"""Queries that write and parse text formats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import ranges
from strandloom.sources import adapters as A
from strandloom.sources import formats as T

SAM = "SELECT rec, CASE WHEN comp THEN 16 ELSE 0 END + CASE end_no WHEN 1 THEN 65 WHEN 2 THEN 129 ELSE 0 END AS flag, contig_id, \"start\", mqual, length, library FROM item"

QUERIES = {
    "b2_sam_header": (
        lambda s, d: T.sam_header(ranges.contig_ranges(A.visible(A.item(s, d)))),
        f"WITH {A.ITEM} SELECT '@SQ' || chr(9) || 'SN:' || contig_id || chr(9) || 'LN:' || max(\"end\") AS value FROM item GROUP BY contig_id",
    ),
    "b3_sam_records": (
        lambda s, d: T.sam_records(A.item(s, d)),
        f"WITH {A.ITEM}, x AS ({SAM}) SELECT rec || chr(9) || flag || chr(9) || contig_id || chr(9) || (\"start\" + 1) || chr(9) || mqual || chr(9) || length || 'M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || 'LB:Z:' || library AS value FROM x",
    ),
    "a7_sam_round_trip": (
        lambda s, d: T.parse_sam(T.sam_records(A.item(s, d))).select(F.col("name").cast("long").alias("rec"), "comp", "end_no", (F.col("pos") - 1).alias("start"), (F.col("end") - 1).alias("end"), F.col("aux")["LB"].alias("library")),
        f"WITH {A.ITEM} SELECT rec, comp, CASE WHEN end_no <= 2 THEN end_no ELSE 0 END AS end_no, \"start\", \"end\", library FROM item",
    ),
    "a29_gff_round_trip": (
        lambda s, d: T.parse_gff(T.gff_lines(A.tag(s, d))).select(F.col("attributes")["ID"].cast("long").alias("tag_id"), "type", "strand", "start", "end", F.col("attributes")["Note"].alias("note")),
        f"WITH {A.TAG} SELECT tag_id, type, CASE WHEN dir IN ('+', '-') THEN dir ELSE '.' END AS strand, \"start\" + 1 AS \"start\", \"end\" + 1 AS \"end\", comment AS note FROM tag",
    ),
}
