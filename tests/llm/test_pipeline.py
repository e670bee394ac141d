import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

import __spark_entry__
import corpus_pipeline
from strandloom.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from tests.llm.test_near_copies import expected

SMALL = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]

    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), ~toxicity.held_out())
    rows = [(r["doc_id"], r["text"]) for r in table if model.score(r["text"], {}) < 0.3]
    kept = by_name["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(rows) == sorted((r.doc_id, r.text) for r in kept.collect())
    assert 0 < len(rows) < len(table)

    cleaned = by_name["line_dedup"](spark, kept, SMALL)
    digests = {i: d for i, _, _, d in line_dedup.brute_force(rows)}
    got = cleaned.collect()
    assert cleaned.columns == docs.columns
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in got} == digests
    assert all(r.n_chars == len(r.text) for r in got)

    rows = [(r.doc_id, r.text) for r in got]
    single = by_name["simhash_near_dedup"](spark, cleaned, SMALL)
    want = expected(rows)
    assert sorted(r.doc_id for r in single.collect()) == sorted(want) and len(want) < len(rows)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    clean = by_name["decontamination"](spark, single, SMALL)
    want = {r[0] for r in decontaminate.brute_force(rows, bench) if not r[5]}
    assert {r.doc_id for r in clean.collect()} == want

    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t for i, t in rows if i in want}
    tokens = {r.doc_id: r for r in by_name["byte_bpe"](spark, clean, SMALL).collect()}
    assert set(tokens) == set(texts)
    for i, r in tokens.items():
        assert r.ids == library.encode_ordinary(texts[i]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
    assert corpus_pipeline.run(spark, SMALL).count() == len(tokens)


def test_keep_one_with_odd_rows(spark):
    text = "a few words that are the same in all of them"
    df = spark.createDataFrame([(None, text, "x"), (7, text, "x"), (3, text.upper(), "x"), (3, text.upper(), "y"), (None, None, "x"), (None, "", "x")], "doc_id long, text string, source string")
    got = simhash.keep_one(df).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == [("3", text.upper()), ("None", "")]


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
