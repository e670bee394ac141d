"""Queries on feature tables, each with its SQL: open frames are written as entries, read again, joined and translated."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import features as T
from strandloom.functions import sequence as S
from strandloom.operators import composition as C
from strandloom.sources import adapters as A

from .sequences import CODE, IUB_SQL, SEQ, TRIPLET, frames_sql

#: Stretches of each sequence in order, every third one complemented; odd sequences as the complement of the whole.
EXONS = SEQ + ", orf AS (" + " UNION ALL ".join(frames_sql(f, 30) for f in range(3)) + """), numbered AS (
  SELECT id, low, high, row_number() OVER (PARTITION BY id ORDER BY low, high) AS i, count(*) OVER (PARTITION BY id) AS n FROM orf
), exon AS (
  SELECT id, CASE WHEN id % 2 = 1 AND n > 1 THEN n - i + 1 ELSE i END AS place, low, high, ((id + i) % 3 = 0) <> (id % 2 = 1 AND n > 1) AS complement FROM numbered
) """
PROTEIN = EXONS + f""", joined AS (
  SELECT id, string_agg(CASE WHEN complement THEN reverse(translate(substr(seq, low, high - low + 1), {IUB_SQL})) ELSE substr(seq, low, high - low + 1) END, '' ORDER BY place) AS mrna FROM exon JOIN seqs USING (id) GROUP BY id
), codon AS (
  SELECT id, i, substr(mrna, CAST(i * 3 + 1 AS BIGINT), 3) AS codon FROM (SELECT id, mrna, unnest(range(0, length(mrna) // 3)) AS i FROM joined)
) SELECT id, 'g' || id AS gene, string_agg(substr('{CODE}', {TRIPLET.format(c='codon')}, 1), '' ORDER BY i) AS protein FROM codon GROUP BY id"""


def _tables(s, d):
    """id, seq and the feature table of each sequence with open frames."""
    seqs = A.seq(s, d)
    own = C.open_frames(seqs, 30).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("low").alias("start"), F.col("high").alias("end")))).alias("orfs"))
    intervals = F.transform("orfs", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), ((F.col("id") + i + 1) % 3 == 0).alias("complement")))
    text = T.location_text(intervals)
    location = F.when((F.col("id") % 2 == 1) & (F.size("orfs") > 1), F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text)
    entry = T.entry_text(F.lit("CDS"), location, {"gene": F.concat(F.lit("g"), F.col("id").cast("string")), "note": F.lit('an "open" frame / stretch')})
    return seqs.join(own, "id").select("id", "seq", F.concat(F.lit("ID   x\n"), entry, F.lit("\nSQ")).alias("features"))


def _read(s, d):
    return _tables(s, d).select("id", "seq", F.explode(T.entries(F.col("features"))).alias("e")).withColumn("intervals", T.location_intervals(F.col("e.location")))


QUERIES = {
    "a35_feature_tables": (
        lambda s, d: _read(s, d).select("id", F.col("e.key").alias("key"), F.col("e.qualifiers")["gene"].alias("gene"), F.col("e.qualifiers")["note"].alias("note"), F.posexplode("intervals").alias("i", "x")).select(
            "id", "key", "gene", "note", (F.col("i") + 1).alias("place"), F.col("x.start").alias("low"), F.col("x.end").alias("high"), "x.complement"
        ),
        EXONS + """SELECT id, 'CDS' AS "key", 'g' || id AS gene, 'an "open" frame / stretch' AS note, place, low, high, complement FROM exon""",
    ),
    "i84_joined_exons": (
        lambda s, d: _read(s, d).select("id", F.col("e.qualifiers")["gene"].alias("gene"), S.translate(T.spliced(F.col("seq"), F.col("intervals"))).alias("protein")),
        PROTEIN,
    ),
}
