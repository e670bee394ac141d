import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm import line_dedup, sharding

SCHEMA = "doc_id long, text string, size string, kept_text int"


def test_permutation_is_a_bijection_and_inverts():
    for n in (1, 2, 3, 5, 7, 40, 41, 1000, 1009):
        p = sharding.Permutation(n, 3)
        got = [p.position(i) for i in range(n)]
        assert sorted(got) == list(range(n))
        assert [p.row_number(x) for x in got] == list(range(n))


def test_shards(spark):
    rows = [(i, f"text {i}", "x", 1) for i in range(203)] + [(5, None, "x", 1), (None, "é", "x", 1), (None, "é", "x", 1), (7, "", "x", 1)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    p = sharding.Permutation(len(rows), 7)
    for r in got:
        assert p.position(r.row_number) == r.slot * 40 + r.shard
    by_text = {r.doc_id: r for r in got if r.doc_id == 11}
    assert by_text[11].size == len("text 11") + 16 and by_text[11].text_crc32 == zlib.crc32(b"text 11")
    assert sorted(x.size for x in got if x.doc_id is None) == [18, 18]
    again = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(50))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 12, 13, 13]


def lines_fixture():
    rows = [(i, f"only {i}\nShared LINE \n\n é{i % 3}") for i in range(12)]
    rows += [(100 + i, "SHARED line\nshared line\nx") for i in range(3)]
    rows += [(200, None), (201, ""), (None, "shared line"), (None, "shared line"), (202, "nine\n" * 5000)]
    rows += [(300 + i, "nine times") for i in range(9)]
    return rows


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_lines_match_brute_force(spark, broadcast_bytes):
    rows = lines_fixture()
    df = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], SCHEMA).repartition(5)
    got = line_dedup.digests(line_dedup.dedup_lines(df, broadcast_bytes=broadcast_bytes))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(line_dedup.brute_force(rows), key=key)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_keep_first(spark, broadcast_bytes):
    rows = [(i, "a\nhot\nhot") for i in range(30)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep="first", broadcast_bytes=broadcast_bytes)
    kept = {r.doc_id: r.kept_text for r in out.collect()}
    assert kept[0] == "a\nhot" and all(kept[i] == "" for i in range(1, 30))


def test_small_filter_stays_exact(spark):
    rows = lines_fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.digests(line_dedup.dedup_lines(df, max_filter_bits=1 << 10))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(line_dedup.brute_force(rows), key=key)
    assert got.filter(F.col("n_dropped") > 0).count() > 0
