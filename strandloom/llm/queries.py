"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, codebooks, conversations, decontaminate, language, line_dedup, resampling, sharding, simhash, suffix_dedup, toxicity, unit_dedup, vector_search
from .common import read_table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & ~toxicity.held_out()).select("doc_id")
    return resampling.resample(documents, good)


def op2_unit_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # sentences of lines, in runs of 25 words: half of a passage of 50, whose two ends may lie inside other sentences
    found = unit_dedup.dedup_units(documents, "sentence", min_words=25)
    return found.select("doc_id", "n_removed", "n_units", "removed_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored_documents(documents, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.find_contamination(documents, read_table(spark, sf_dir, "benchmark")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(texts, path).select("doc_id", "ids", "token_offsets")
    return byte_bpe.digests(byte_bpe.decode(encoded, path))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digests(line_dedup.dedup_lines(documents))


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.remove_repeats(documents))


def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, found = codebooks.compress(read_table(spark, sf_dir, "embeddings"))
    return codebooks.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_output_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identified(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op13_coalescing_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.repair(conversations.damage(found)), found)


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), keyed AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: translate(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks
  FROM lines
), hot AS (
  SELECT k FROM (SELECT DISTINCT doc_id, unnest(ks) AS k FROM keyed) WHERE k <> '' GROUP BY k HAVING count(*) >= 10
), flat AS (
  SELECT doc_id, unnest(ls) AS l, unnest(ks) AS k, unnest(range(len(ls))) AS i FROM keyed
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
         sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
  FROM flat LEFT JOIN hot ON flat.k = hot.k GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM kept
"""


def op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Assignments and means, round after round; codebooks as (part, entry, components)."""
    assigned = """
SELECT vec_id, p, arg_min(x, d * 256 + e) AS x, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d
FROM (SELECT vec_id, k.p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts k JOIN book{0} b ON k.p = b.p)
GROUP BY vec_id, p"""
    means = """
SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{1} b LEFT JOIN (
  SELECT p, e, list(mean ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM chosen{1}) GROUP BY p, e, i) GROUP BY p, e
) m ON b.p = m.p AND b.e = m.e"""
    steps = []
    for r in range(rounds + 1):
        if r:
            steps.append(f"book{r} AS MATERIALIZED ({means.format(r, r - 1)})")
        steps.append(f"chosen{r} AS MATERIALIZED ({assigned.format(r)})")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, e, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts) WHERE e < {entries}
), {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM chosen{rounds} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded c JOIN kept k ON c.vec_id = k.vec_id"""


OP13_SQL = r"""
WITH RECURSIVE kinds AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), bits AS (  -- the key's bits, lowest first
  SELECT *, list_transform(range(8 * len(k)), lambda i: (ascii(k[i // 8 + 1]) >> (i % 8)::INT) & 1) AS b FROM kinds
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda s, x: CASE WHEN xor(s, x) & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT) % 20 AS kind
  FROM bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), judged AS MATERIALIZED (
  SELECT conv_id, n, turn, role, text, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS r0,
         CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), turns(state, r, after) AS (VALUES (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, 's', 1)),
ahead AS (  -- up to two turns inserted before a row
  SELECT a.s AS state, a.s AS there, '' AS edits, 0 AS cost FROM (VALUES (0), (1), (2), (3)) a(s)
  UNION ALL SELECT state, after, 'I', 5 FROM turns WHERE r <> 's'
  UNION ALL SELECT x.state, y.after, 'II', 10 FROM turns x JOIN turns y ON x.after = y.state WHERE x.r <> 's' AND y.r <> 's'
), edits AS (  -- edit of a row: D, K by its role's initial, R to a turn of user or assistant
  SELECT state, '?' AS r, 'D' AS e, there AS after, edits, cost + 2 AS cost FROM ahead
  UNION ALL SELECT h.state, t.r, 'K', t.after, h.edits, h.cost FROM ahead h JOIN turns t ON h.there = t.state
  UNION ALL SELECT h.state, '?', 'R', t.after, h.edits, h.cost + 1 FROM ahead h JOIN turns t ON h.there = t.state WHERE t.r <> 's'
), search AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state, {'c': 0::BIGINT, 'a': ''} AS best FROM judged
  UNION ALL
  SELECT j.conv_id, j.n, e.after, min({'c': s.best.c + e.cost + CASE WHEN j.fault = 'truncated' AND e.e <> 'D' THEN 5 ELSE 0 END, 'a': s.best.a || e.edits || e.e})
  FROM search s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.n = s.n + 1
  JOIN edits e ON e.state = s.state AND e.r IN ('?', j.r) AND (e.e = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
  GROUP BY j.conv_id, j.n, e.after
), ended AS (
  SELECT s.conv_id, min({'c': s.best.c + z.cost, 'a': s.best.a || z.edits}) AS best
  FROM search s JOIN (SELECT conv_id, max(n) AS n FROM judged GROUP BY conv_id) m ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.n = m.n
  JOIN ahead z ON z.state = s.state AND z.there IN (0, 3) GROUP BY s.conv_id
), spelled AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS e, unnest(range(len(best.a))) AS i FROM ended WHERE best.a <> ''
), placed AS (
  SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS k FROM spelled
), lines AS (
  SELECT p.conv_id, p.k, j.role, p.e, CASE WHEN p.e = 'I' THEN '' ELSE j.text END AS text,
         max(CASE WHEN p.k = 1 AND p.e = 'K' AND j.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND p.n = j.n AND p.e <> 'I' WHERE p.e <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS digest FROM lines GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.best.c, 0) AS cost, coalesce(e.best.a, '') AS audit, coalesce(t.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": op1_importance_resampling,
        "op2_unit_hash_dedup": op2_unit_hash_dedup,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_subword_toxicity": op4_subword_toxicity,
        "op5_wu_manber_decontamination": op5_wu_manber_decontamination,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_feistel_shards": op7_feistel_shards,
        "op8_line_dedup": op8_line_dedup,
        "op9_anisotropic_search": op9_anisotropic_search,
        "op10_suffix_sort_dedup": op10_suffix_sort_dedup,
        "op11_cover_tree_codes": op11_cover_tree_codes,
        "op12_output_code_language": op12_output_code_language,
        "op13_coalescing_viterbi": op13_coalescing_viterbi,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op11_cover_tree_codes": op11_sql(), "op13_coalescing_viterbi": OP13_SQL}
