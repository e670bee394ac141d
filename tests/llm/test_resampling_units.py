import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import resampling, unit_dedup


def test_resample_prefers_target_like_text(spark):
    rng = random.Random(0)
    good_words, bad_words = ["river", "stone", "light", "paper", "green"], ["zzz", "!!!", "buy", "click", "$$$"]
    rows = []
    for i in range(400):
        words = bad_words if i % 5 == 0 else good_words
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))), "x"))
    rows += [(None, "river stone", "x"), (500, None, "x"), (501, "", "x"), (501, "", "x"), (502, "river stone " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string").repartition(4)
    good = spark.createDataFrame([(i,) for i in range(0, 400, 3) if i % 5], "doc_id long")
    got = resampling.resample(docs, good, share=0.7).collect()
    assert len(got) == len(rows) and sorted(r.place for r in got) == list(range(len(rows)))
    assert sum(r.keep for r in got) == math.ceil(0.7 * len(rows))
    kept = {r.doc_id for r in got if r.keep}
    bad = [i for i in range(0, 400, 5)]
    assert sum(i in kept for i in bad) < 0.1 * len(bad)
    ordered = sorted(got, key=lambda r: r.place)
    assert all(a.gumbel_key >= b.gumbel_key for a, b in zip(ordered, ordered[1:]))
    again = resampling.resample(docs.repartition(2), good, share=0.7).collect()
    assert {(r.doc_id, r.gumbel_key) for r in got} == {(r.doc_id, r.gumbel_key) for r in again}
    assert resampling.resample(docs.limit(0), good).count() == 0
    assert {r.log_weight for r in resampling.resample(docs, good.limit(0)).collect()} == {0.0}


def test_weights_are_the_ratio_of_the_two_models(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c")], "doc_id long, text string")
    ratio = resampling.fit(docs, docs.filter("doc_id = 1").select("doc_id"), buckets=50)
    hasher = resampling.Hasher(50)
    raw = np.bincount(np.concatenate([hasher("a a b"), hasher("b c")]), minlength=50)
    target = np.bincount(hasher("a a b"), minlength=50)
    seen = raw > 0
    want = np.log((target + 5.0 * raw / raw.sum() + 1e-9) / (target.sum() + 5.0)) - np.log((raw + 1e-9) / raw.sum())
    assert np.allclose(ratio[seen], want[seen])
    got = {r.doc_id: r.log_weight for r in resampling.with_weights(docs, ratio).collect()}
    assert abs(got[1] - ratio[hasher("a a b")].sum()) < 1e-12


def test_gumbel_noise(spark):
    noise = spark.range(20000).select(resampling.gumbel(3, F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(noise[0] - 0.5772) < 0.05 and abs(noise[1] - math.pi / math.sqrt(6)) < 0.05


def unit_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 60, 9, 7, 30)]
    rows = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            lines.insert(rng.randint(0, len(lines)), rng.choice([s, s.upper(), "  " + s.replace(" ", "\t ") + " "]))
        rows.append((i, rng.choice(["\n", "\n\n", "\n \n"]).join(lines)))
    return [*rows, (-5, shared[1]), (200, None), (201, ""), (202, rows[0][1]), (203, (shared[4] + "\n") * 2000)]


@pytest.mark.parametrize(("unit", "min_words"), [("line", 1), ("line", 8), ("paragraph", 1), ("sentence", 25)])
def test_units_match_brute_force(spark, unit, min_words):
    rows = [(i, t.replace("b ", "b. ") if t else t) for i, t in unit_rows()]
    columns = "doc_id long, text string, n_units int, _text string, _row int, _repeated string"
    df = spark.createDataFrame([(a, b, 1, "x", 2, "y") for a, b in rows], columns).repartition(3)
    got = unit_dedup.dedup_units(df, unit, min_words).collect()
    found = sorted((r.doc_id, r.n_units, [tuple(s) for s in r.removed_spans]) for r in got)
    assert found == unit_dedup.brute_force(rows, unit, min_words)
    assert any(f[2] for f in found) and {(r["_text"], r["_row"], r["_repeated"]) for r in got} == {("x", 2, "y")}
    texts = dict(rows)
    for r in got:
        gone = {i for a, b in map(tuple, r.removed_spans) for i in range(a, b)}
        kept = "".join(c for i, c in enumerate(texts[r.doc_id] or "") if i not in gone)
        assert r.kept_text.split() == kept.split() and r.n_removed == len(r.removed_spans)


def test_units_odd_rows(spark):
    line = "one two three four five six seven eight"
    df = spark.createDataFrame([(None, line), (None, line), (3, line), (3, line), (10, line)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in unit_dedup.dedup_units(df).collect()), key=str)
    assert got == [(10, 1), (3, 0), (3, 1), (None, 1), (None, 1)]  # of equal rows one is the first
    assert unit_dedup.dedup_units(df.limit(0)).count() == 0


def test_runs_of_units():
    sizes = [3, 0, 4, 2, 5, 1]
    assert unit_dedup.gone_units(sizes, {0, 2, 4}, 7) == {0, 2} and unit_dedup.gone_units(sizes, {0, 2, 4}, 8) == set()
    assert unit_dedup.gone_units(sizes, {3, 4, 5}, 8) == {3, 4, 5}
    assert unit_dedup.gone_units([2, 0], {0}, 50) == {0} and unit_dedup.gone_units([0], set(), 1) == set()
    assert unit_dedup.units_of("One two. Three?  Four\nfive.", "sentence") == [(0, 8), (9, 15), (17, 21), (22, 27)]


def test_passage_inside_other_text_is_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 9))) + "."
    passage = " ".join(sentence() for _ in range(9))
    rows = [(i, " ".join([*(sentence() for _ in range(5)), word(), *([passage] if i % 3 == 0 else []), word(), sentence()])) for i in range(60)]
    got = unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "sentence", 25).collect()
    assert {r.doc_id for r in got if r.n_removed} == set(range(3, 60, 3))
