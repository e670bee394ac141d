import hashlib
import itertools
import random
import zlib

import pytest

from strandloom.llm import conversations as conv
from strandloom.llm.queries import OP13_SQL, queries
from tests.oracle import compare, connection

SCHEMA = "conv_id long, turn long, role string, text string, piece int, at string"


def judged(rows):
    """(role, text, fault) of the rows of one conversation after damage, in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def searched(rows):
    """The audit and the cost by the search, and the largest number of nodes held."""
    got, search = [], conv.Survivors(conv.NOTHING, lambda row, edits, state: got.append(edits))
    for role, text, fault in rows:
        search.push(None, conv.steps_of(role, fault))
    cost = min(search.cost[s] + 5 * len(conv.CLOSING[s]) for s in range(4))
    closing = search.finish()
    assert search.size == 0
    return "".join(got) + closing, cost, search.largest


def test_search_matches_all_edits():
    rng = random.Random(1)
    texts = ["Yes.", "No", "", "Why?"]
    for n in range(0, 5):
        for roles in itertools.product(["system", "user", "assistant", "tool", ""], repeat=n):
            if n > 2 and rng.random() > (0.2 if n == 3 else 0.04):
                continue
            rows = judged([(r, rng.choice(texts) + (str(i) + "." if rng.random() < 0.5 else "")) for i, r in enumerate(roles)])
            cost, audit, _ = conv.brute_force(rows)
            got, own, _ = searched(rows)
            assert (own, got) == (cost, audit), rows


def test_tree_stays_small_and_drops_what_no_state_keeps():
    rows = judged([(("user", "assistant")[i % 2], f"Turn {i}.") for i in range(5000)])
    audit, cost, largest = searched(rows)
    assert (audit, cost) == ("K" * 5000, 0) and largest < 64


def test_pieces_put_together_equal_one_search():
    rng = random.Random(7)
    for _ in range(200):
        rows = judged([(rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b.", "c", " ", f"{rng.random()}."])) for _ in range(rng.randint(1, 30))])
        cuts = sorted(rng.sample(range(1, len(rows) + 1), min(len(rows), rng.randint(1, 4))))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]
        tables = []
        for piece in pieces:
            found = [([0.0 if s == e else conv.INF for s in range(4)], [0] * 4) for e in range(4)]
            for role, _, fault in piece:
                found = [conv.advance(c, r, conv.steps_of(role, fault))[:2] for c, r in found]
            tables.append(([x for c, _ in found for x in c], [x for _, r in found for x in r]))
        got = ""
        for piece, (entry, leave) in zip(pieces, conv.through(tables), strict=True):
            out, search = [], conv.Survivors(entry, lambda row, edits, state: out.append(edits))
            for role, _, fault in piece:
                search.push(None, conv.steps_of(role, fault))
            closing = search.finish(leave)
            got += "".join(out) + closing
        assert got == searched(rows)[0]


def plain(table):
    """The rows of op13 for (conv_id, turn, role, text) rows, by the plain search of one conversation."""
    out, names = {}, lambda x: " " if x is None else str(x)
    for own in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r[:4] for r in table if r[0] == own):
            kind, role, text = zlib.crc32(f"{names(c)}:{names(turn)}".encode()) % 20, names(role), names(text)
            if kind:
                text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
                rows += [(turn is not None, turn or 0, ("user" if kind == 4 else role).encode(), text.encode())] * (2 if kind == 3 else 1)
        rows.sort()
        found = judged([(r.decode(), t.decode()) for *_, r, t in rows])
        turns = {t for known, t, _, _ in rows if known}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(found, found[1:])]
        cost, audit, text = conv.brute_force(found)
        count = lambda f: sum(x[2] == f for x in found)  # noqa: B023, E731
        out[own] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def fixture():
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(["Hi.", "Hi.", f"Say {t}!", "so it goes", " ", None, "", "Né à?"]), 1, "x"))
    rows += [(None, 0, "user", "Q?", 1, "x"), (None, 1, "assistant", "A.", 1, "x"), (50, None, None, None, None, None)]
    return rows + rows[:12]


@pytest.mark.parametrize("piece_rows", [100_000, 3])
def test_matches_the_plain_search(spark, piece_rows):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = conv.digests(conv.repair(conv.damage(df), piece_rows=piece_rows), df).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    if piece_rows == 3:
        pieces = conv.repair(conv.damage(df), piece_rows=3).groupBy("conv_id").agg({"piece": "max"}).collect()
        assert max(r[1] for r in pieces) > 0


def test_one_long_conversation_in_pieces(spark):
    rng = random.Random(5)
    rows = [(1, t if t % 11 else None, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"No {t}.", f"Well {t}", ""]), 0, "") for t in range(3000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"Turn {t}.", 0, "") for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    edits = conv.repair(df, piece_rows=200)
    assert edits.filter("conv_id = 1").select("piece").distinct().count() > 5
    whole = conv.repair(df)
    assert whole.select("piece").distinct().count() == 1
    same = [conv.digests(x, df).orderBy("conv_id").collect() for x in (edits, whole)]
    assert same[0] == same[1] and len(same[0][0].audit) >= 3000 and same[0][1].cost == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conv.digests(conv.repair(conv.damage(df)), df).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_matches_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert compare(queries()["op13_coalescing_viterbi"](spark, folder), connection(folder), OP13_SQL) == ""


def test_sql_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(fixture(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    assert compare(conv.digests(conv.repair(conv.damage(df)), df), con, OP13_SQL) == ""
