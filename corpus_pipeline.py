"""A training-data pipeline over ``documents``; each stage calls one operator of strandloom.llm.

Toxicity (rejected documents go), line dedup (lines found in ten documents go), near-dedup
(of documents that share 0.8 of their five-word shingles one stays), benchmark decontamination (documents with a benchmark window go),
byte-level BPE (token ids of what is left, and the digest of the decoded bytes). Each stage works
on all that the one before it kept; ``run`` writes every stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from strandloom.llm.common import Scratch, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"
#: SQL can't express a trained model, fingerprints in groups or pair merging; tests/llm compares with brute force.
ORACLE_SQL = None
#: Rows alone (10,000 by default) don't bound an Arrow batch of long texts.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "2m") -> None:
    """Batches between Spark and Python end after about ``most`` bytes, unless the session sets a size itself."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.scored_documents(docs, labels).filter("predicted = 0").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = line_dedup.dedup_lines(docs).drop("text", "n_chars")
    return cleaned.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one_copy(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_words") == 0).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    path = ranks_path or public_tokenizers.path(RANKS)
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), path, token_offsets=False).select("doc_id", "ids")
    decoded = byte_bpe.decode(encoded, path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
