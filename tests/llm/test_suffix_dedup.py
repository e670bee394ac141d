import random

import numpy as np
import pytest

from strandloom.llm import suffix_dedup


def passages():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    shared = [text(rng.randint(10, 120)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(text(rng.randint(0, 60)))
            if rng.random() < 0.6:
                whole = rng.choice(shared)
                a = rng.randint(0, len(whole) // 2)
                parts.append(whole[a : rng.randint(a, len(whole))])
        rows.append((i, "".join(parts)))
    rows += [(200 + i, shared[3]) for i in range(4)] + [(300, "z" * 500), (301, None), (302, ""), (302, ""), (None, shared[2]), (5, rows[5][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("most_kinds", [512, 3])
@pytest.mark.parametrize(("width", "gram"), [(30, 8), (13, 13), (200, 64)])
def test_matches_brute_force(spark, width, gram, most_kinds):
    rows = passages() + [(900, passages()[0][1] * 20), (901, passages()[1][1] * 9 + "q")]
    df = spark.createDataFrame([(a, b, "s", 1, 2, 3) for a, b in rows], "doc_id long, text string, spans string, _text int, _spans int, _key int").repartition(3)
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(df, width, gram, most_kinds=most_kinds))
    key = lambda r: tuple(map(str, r))
    want = suffix_dedup.brute_force(rows, width)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0


def test_stretches_of_a_long_text(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8).tobytes().decode()
    monkeypatch.setattr(suffix_dedup, "STRETCH_BYTES", 700)
    batch = pa.RecordBatch.from_pydict({"key": [b"k", b"l"], "text": [data, "short" * 50]})
    out = pa.Table.from_batches(list(suffix_dedup._segment_rows(30, 8)(iter([batch]))))
    k = out.filter(pa.compute.equal(out["key"], b"k")).to_pylist()
    covered = sorted(w for r in k for w in range(r["at"], r["at"] + r["n"]))
    assert covered == list(range(5000 - 30 + 1))


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    width = 40
    places = rng.integers(0, len(raw) - width, 900)
    group = rng.integers(0, 7, 900)
    order, groups = suffix_dedup.Suffixes(raw, width).sorted(places, group)
    data = raw.tobytes()
    keys = [(int(g), data[p : p + width]) for p, g in zip(places[order], groups)]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(900))


def test_collisions_fall_back_to_bytes(monkeypatch):
    raw = np.frombuffer(b"abcabcxbcabc", np.uint8)
    s = suffix_dedup.Suffixes(raw, 3)
    monkeypatch.setattr(suffix_dedup.Suffixes, "same", lambda self, a, b, n: np.ones(len(a), bool))
    places = np.arange(10)
    counts = {}
    for p in places:
        counts[raw.tobytes()[p : p + 3]] = counts.get(raw.tobytes()[p : p + 3], 0) + 1
    want = [counts[raw.tobytes()[p : p + 3]] > 1 for p in places]
    assert s.repeated(places, np.zeros(10, np.int64)).tolist() == want


@pytest.mark.parametrize("most_kinds", [512, 2])
def test_short_periods_match_brute_force(spark, most_kinds):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = rng.choice(["z", "ab", "abc", "xyzzy", "0123456789", "q" * 7 + "r"])
            turn = rng.randint(0, len(unit) - 1)
            parts.append("".join(rng.choice("abcdef") for _ in range(rng.randint(0, 25))))
            parts.append(((unit[turn:] + unit[:turn]) * 80)[: rng.choice([28, 29, 30, 31, 32, 35, 40, 47, 60, 75])])
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(df, 30, 8, most_kinds=most_kinds))
    assert sorted(map(tuple, got.collect())) == sorted(suffix_dedup.brute_force(rows, 30))


def test_a_megabyte_of_one_letter_and_of_a_short_period(spark):
    for unit in ("z", "lorem ipsum, "):
        raw = np.frombuffer((unit * 1_000_000)[:1_000_000].encode(), np.uint8)
        (_, _, size, _, _), runs = suffix_dedup.segments_of(raw, np.array([0, len(raw)]))
        assert len(size) < 200 and len(runs) == 1 and runs[0][2] - runs[0][1] > 999_000
    rows = [(1, "z" * 1_000_000), (2, "lorem ipsum, " * 80_000), (3, "z" * 200), (4, "z" * 199), (5, "x" * 199 + "lorem ipsum, " * 17)]
    got = {r.doc_id: r for r in suffix_dedup.digests(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [(got[i].n_bytes - got[i].n_removed, got[i].n_spans) for i in range(1, 6)] == [(0, 1), (0, 1), (0, 1), (199, 0), (199, 1)]
