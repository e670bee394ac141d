import random
from itertools import combinations

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from strandloom.llm import simhash


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(rows):
    """The smallest id of each group, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both >= 0.8 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(least.values())


def made_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for edits in range(12):
        for _ in range(4):
            words = [word() for _ in range(rng.randint(80, 300))]
            for _ in range(3):
                rows.append((len(rows), " ".join(words)))
                for at in rng.sample(range(len(words)), edits):
                    words[at] = word()
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "one three")]


@pytest.mark.parametrize("table", ["made", "/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_stage_keeps_one_of_texts_that_share_their_shingles(spark, table):
    if table == "made":
        rows = made_rows()
    else:
        rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{table}/documents.parquet").to_pylist()]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, table).collect())
    assert got == expected(rows)
    fewer = sorted(r.doc_id for r in simhash.keep_one(docs).collect()) if table == "made" else got
    assert len(got) < len(fewer) or table != "made"


def test_cells_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_SETS", 3)
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(r.doc_id for r in simhash.keep_one_copy(docs).collect()) == expected(rows)


def test_links_across_labels():
    import pandas as pd

    base = list(range(100))
    sets = {1: base, 2: base[:90], 3: base[:79], 4: base[20:], 5: [*range(200, 290)]}
    frame = pd.DataFrame([(7, k, len(v), k if k > 2 else 1, k % 2, v) for k, v in sets.items()], columns=["cell", "set", "n", "label", "chunk", "hashes"])
    found = simhash._across_labels(0.8)((7, 0, 0), frame)
    assert {tuple(sorted(x)) for x in found.to_numpy().tolist()} <= {(2, 3), (1, 4)} and len(found) == 2
    across = simhash._across_labels(0.8)((7, 0, 1), frame)
    assert {tuple(sorted(x)) for x in across.to_numpy().tolist()} == {(2, 3), (1, 4)}
    none = simhash._across_labels(0.8)((7, 0, 0), frame.head(2))
    assert not len(none) and list(none.columns) == ["a", "b"]


def test_fingerprints_link_what_shares_no_band(spark, monkeypatch):
    # one key of 400 minimal hashes: nearly no pair of different sets shares it
    monkeypatch.setattr(simhash, "BANDS", 1)
    monkeypatch.setattr(simhash, "BAND_ROWS", 400)
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], "other"]))]
    hashes = {i: simhash.np.unique(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows}
    apart = [(simhash.print_of(hashes[i]) ^ simhash.print_of(hashes[i + 1])).bit_count() for i in range(0, 80, 2)]
    assert all(simhash.print_of(hashes[i]) == simhash.fingerprint(t.encode(), 5) for i, t in rows)
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {r.doc_id for r in simhash.keep_one_copy(docs).collect()}
    assert sum(d <= 4 for d in apart) > 30
    assert all(2 * k in got and (2 * k + 1 not in got) for k, d in enumerate(apart) if d <= 4)
    # of fingerprints within reach only texts that share their shingles are linked
    strict = {r.doc_id for r in simhash.keep_one_copy(docs, similarity=0.9999).collect()}
    assert strict == {i for i, _ in rows}
