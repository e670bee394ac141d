import random

import numpy as np
import pytest

from strandloom.llm import language
from strandloom.llm.queries import queries

SYLLABLES = {"aa": "ka lo mi ren tu", "bb": "sha vor el ust pim", "cc": "zé ñu gri olt ewo", "dd": "ich ung der sch ent"}
SCHEMA = "doc_id long, text string, lang string, score string, _text int"


def corpus(n=800, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        word = lambda: "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4)))  # noqa: B023, E731
        rows.append((i, " ".join(word() for _ in range(rng.randint(8, 80))) + ". 17", lang, "x", 1))
    return rows


def test_codewords_are_apart():
    for n in range(2, 40):
        words = language.codewords(n).astype(int)
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert set(np.unique(words)) == {-1, 1} and min(apart) >= (2 ** (n - 2) if n <= 5 else 3)
        assert (np.abs(words.sum(0)) < n).all()


def test_margins_match_a_plain_count():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], language.codewords(3), rng.normal(size=(language.BUCKETS, 3)), rng.normal(size=3), np.ones(3))
    texts = ["Grüße an Straße 7!", "", "x", "12 34", " a  b\nc", "日本語 text", "é" * 50, "ab " * 40]
    got, readable = model.margins(texts)
    assert np.allclose(got, [language.plain_margins(model, x) for x in texts])
    assert readable.tolist() == [any(c.isalpha() for c in x) for x in texts]
    assert np.allclose(model.margins([texts[0]])[0], got[:1], atol=0, rtol=1e-12)


def test_long_texts_go_in_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], language.codewords(2), rng.normal(size=(language.BUCKETS, 1)), rng.normal(size=1), np.ones(1))
    text = "abc de, fghi " * 9 + "é"
    whole, counts = model.margins([text])[0], language.counts_of(text)
    monkeypatch.setattr(language, "BLOCK", 10)
    for most in (1, 2, 7, 10):
        monkeypatch.setattr(language, "BLOCK", most)
        monkeypatch.setattr(language.blocks, "__defaults__", (most,))
        assert np.allclose(model.margins([text, "x y", text])[0][[0, 2]], whole)
        assert all((a == b).all() for a, b in zip(language.counts_of(text), counts, strict=True))


def test_decoding_is_by_weighted_losses():
    words = language.codewords(4)
    model = language.Model(list("abcd"), words, np.zeros((1, 7)), np.zeros(7), np.array([1.0, 2, 1, 1, 1, 1, 0.5]))
    for i in range(4):
        margins = words[i] * 3.0
        margins[2] *= -1  # one wrong bit is corrected
        best, score, second = model.decoded(margins[None])
        assert best[0] == i and score[0] > 0.9 > second[0]
        loss = [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(model.share, margins, word)) for word in words]
        assert np.allclose(model.losses(margins[None])[0], loss)


def test_held_out_languages(spark):
    rows = corpus()
    got = language.identified(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    truth = {r[0]: r[2] for r in rows}
    out = [r for r in got if r.held_out]
    assert len(got) == len(rows) and len(out) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert not {"_text", "score"} - set(got[0].asDict()) and all(0 <= r.score <= 1 for r in got)
    again = language.identified(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert {(r.doc_id, r.lang_pred, r.ambiguous) for r in again} == {(r.doc_id, r.lang_pred, r.ambiguous) for r in got}
    hidden = [(i, text, None if r.held_out else lang, "x", 1) for (i, text, lang, _, _), r in zip(rows, sorted(got, key=lambda r: r.doc_id))]
    blind = language.identified(spark.createDataFrame(hidden, SCHEMA)).collect()
    assert {(r.doc_id, r.lang_pred) for r in blind} == {(r.doc_id, r.lang_pred) for r in got}


def test_odd_rows(spark):
    rows = corpus(200)
    odd = [(None, "ka lo mi", "aa", "", 1), (900, None, "aa", "", 1), (901, "", "bb", "", 1), (902, "12 — 34", "bb", "", 1), (903, "ka lo", None, "", 1), (904, "ren tu " * 300_000, None, "", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows + odd + rows[:40] * 2, SCHEMA)
    got = language.identified(df).collect()
    assert len(got) == len(rows) + len(odd) + 80
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(by_id[i].score == 0 and by_id[i].ambiguous for i in (900, 901, 902))
    assert by_id[903].lang_pred == by_id[904].lang_pred == "aa" and not by_id[904].ambiguous
    assert language.identified(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identified(df.withColumn("lang", df.lang.substr(9, 1)).filter("false").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) lang", "score", "_text"))).collect()} == {"und"}
    one = language.identified(df.filter("lang = 'aa'")).collect()
    assert {r.lang_pred for r in one} == {"aa", "und"}
    few = language.fit(df, sample_rows=3)
    assert few.languages == sorted(SYLLABLES)
    assert language.fit(df, most_rows=2).languages == ["aa", "bb"]


@pytest.mark.parametrize("sf", ["0.1"])
def test_held_out_accuracy_on_the_table(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries()["op12_output_code_language"](spark, folder).collect()
    out = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out)
    print(len(out), right, sum(r.ambiguous for r in out))
    assert len(got) == len(truth) and right >= 0.9
    clear = [r for r in out if not r.ambiguous]
    assert sum(r.lang_pred == truth[r.doc_id] for r in clear) / len(clear) >= right
