import random

from pyspark.sql import functions as F

from strandloom.llm import toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sha", "vor", "el", "ust", "pim"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grumblefoot", "snarkwit", "mudbrain"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_and_catches_unseen_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    got = toxicity.scored_documents(docs, labels).collect()
    truth = {a: c for a, _, c in rows}
    out = [r for r in got if r.held_out]
    assert 100 < len(out) < 350
    right = sum(r.predicted == truth[r.doc_id] for r in out) / len(out)
    assert right > 0.95
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    base = rows[1][1].split()[:30]
    assert model.score(" ".join(base), {}) < 0.3
    assert model.score(" ".join([*base, "grumblefooot", "snarkwitt", "mudbraain"]), {}) > 0.3


def test_odd_rows(spark):
    rows = corpus(300)
    docs = spark.createDataFrame(
        [(a, b, "x") for a, b, _ in rows] + [(None, "grumblefoot", "x"), (900, None, "x"), (901, "", "x"), (901, "", "x"), (902, "ka " * 200_000, "x")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in rows] + [(None, 1, 0), (3, None, 0), (0, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.scored_documents(docs, labels).collect()
    assert len(got) == len(rows) + 5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    assert toxicity.scored_documents(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scored_documents(docs, labels.limit(0)).collect()} == {0.0}
    again = {(r.doc_id, r.score) for r in toxicity.scored_documents(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert docs.filter(toxicity.held_out()).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).count() == 0
