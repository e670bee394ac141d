import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, decontaminate

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(PATH))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    letters = "aab'''strevmlld  \n\t 1é\xa0　!?.Ωж中𝔘½"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    return [*made, "", None, "'s", " 's", "''s", "a" * 5000, " " * 3000, "x \n y  ", "don't we'll'd", "<|endoftext|>", "word " * 20000]


def test_encode_like_the_library_and_back(spark, library):
    rows = [(i, t, "clash", None) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, `odd name` int").repartition(4)
    encoded = byte_bpe.encode(df, PATH)
    got = {r.doc_id: r for r in byte_bpe.decode(encoded, PATH).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(texts()):
        raw = (text or "").encode()
        assert got[i].ids == library.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == raw
        cuts = [*got[i].token_offsets, len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(cuts, cuts[1:])) == raw
        assert [raw[a:b] for a, b in zip(cuts, cuts[1:])] == library.decode_tokens_bytes(got[i].ids)
    assert byte_bpe.encode(df.limit(0), PATH).count() == 0


def test_long_texts_in_stretches(library):
    import numpy as np

    merge = byte_bpe.Merger(byte_bpe.parse_ranks(byte_bpe.read_ranks(PATH)))
    for text in [" ".join(t for t in texts() if t), "a b" * 400, "x" * 500, "don't  we 'll \n be a  c d'e f" * 50]:
        for most in (1, 7, 100):
            data = text.encode()
            cuts = byte_bpe.stretches(data, most)
            assert cuts[0] == 0 and cuts[-1] == len(data) and cuts == sorted(set(cuts))
            assert byte_bpe.encode_long(data, merge, most).tolist() == library.encode_ordinary(text)
    assert len(byte_bpe.stretches(b"a b" * 400, 7)) > 100
    assert np.array_equal(byte_bpe.encode_long(b"word " * 1_000_000, merge), byte_bpe.encode_texts(b"word " * 1_000_000, np.array([0, 5_000_000]), merge)[0])


def test_bpe_digests(spark, library):
    import hashlib

    df = spark.createDataFrame([(1, "Hello, it's  me"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df, PATH, token_offsets=False), PATH)).collect()}
    ids = library.encode_ordinary("Hello, it's  me")
    assert got[1].n_tokens == len(ids)
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello, it's  me").hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()


def contaminated(rng):
    vocabulary = ["ab", "abc", "the", "é", "x1", "of", "Zeta", "q", "long" * 5]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, item(n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 60, 25])]
    bench += [(50, bench[0][1]), (0, bench[0][1]), (51, None), (52, ""), (53, "!!"), (None, "of of of"), (54, "the, the")]
    docs = []
    for i in range(300):
        parts = [item(rng.randint(0, 40))]
        if rng.random() < 0.7:
            words = rng.choice(bench[:8])[1].split()
            a = rng.randint(0, max(0, len(words) - 12))
            parts += ["; ".join(words[a : a + rng.randint(1, 40)]).upper(), item(5)]
        docs.append((i, "\n".join(parts)))
    return docs + [(None, None), (7, ""), (7, ""), (8, " ".join(bench[6][1].split() * 300))], bench


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontaminate_matches_brute_force(spark, block_bytes):
    docs, bench = contaminated(random.Random(3))
    df = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, items string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.digests(decontaminate.find_contamination(df, items, block_bytes=block_bytes))
    want = decontaminate.brute_force(docs, [b for b in bench if b[0] is not None])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.filter(F.col("contaminated")).count() > 0
    assert decontaminate.find_contamination(df.limit(0), items).count() == 0
    assert decontaminate.digests(decontaminate.find_contamination(df, items.limit(0))).filter("contaminated").count() == 0
