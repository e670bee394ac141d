"""Columns of reads in tiles against plain counts, with borders, deep tiles and small batches."""

import numpy as np
import pytest

from strandloom import plans
from strandloom.operators import tiles
from strandloom.sources import adapters as A

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reads(spark):
    rows = [(c, 1000 * c + i, 4000 + (i * 37) % 220, 4000 + (i * 37) % 220 + i % 60, i % 9) for c in (1, 2, 7) for i in range(150)]
    return spark.createDataFrame(rows, "contig_id long, rec long, start long, end long, template long").cache()


def plain(reads):
    """Bases by column, in plain Python."""
    found = {}
    for r in reads.collect():
        for p in range(r.start, r.end + 1):
            code, qual = A.base_arrays({"contig_id": np.array([r.contig_id]), "rec": np.array([r.rec])}, np.array([0]), np.array([p]))
            found.setdefault((r.contig_id, p), []).append((r.rec, int(code[0]), int(qual[0])))
    return found


@pytest.mark.parametrize("most", [400_000, 300])
def test_borders_and_deep_tiles(spark, reads, monkeypatch, most):
    # the border at 4096 lies inside reads; few bases at once make every tile a deep one
    step = tiles._bases
    monkeypatch.setattr(tiles, "MOST_BASES", most)
    own = {n: np.array([r[n] for r in reads.orderBy("contig_id", "start", "rec").collect()]) for n in ("contig_id", "rec", "start", "end")}
    own["block"] = np.full(len(own["rec"]), 0)
    found = {}
    for bases in step(own, own["block"], 8192, 8192, A.base_arrays):
        assert len(bases.pos) <= most or bases.span == 1
        counts = bases.counts()
        at = np.flatnonzero(counts.sum(1))
        for c, p, n in zip(*bases.where(at), counts[at].tolist()):
            assert (int(c), int(p)) not in found
            found[int(c), int(p)] = n
    want = {k: [sum(code == i for _, code, _ in v) for i in range(6)] for k, v in plain(reads).items()}
    assert found == want


def test_flags_of_reads_over_a_border(reads):
    want = plain(reads)
    best = {}
    for k, v in want.items():
        n = [sum(code == i for _, code, _ in v) for i in range(5)]
        best[k] = n.index(max(n)) if 100 * max(n) // len(v) >= 50 else -1
    for r in tiles.differing(reads, A.base_arrays).collect():
        mine = [next(code for rec, code, _ in v if rec == r.rec) != best[k] for k, v in sorted(want.items()) if k[0] == r.contig_id and any(rec == r.rec for rec, _, _ in v)]
        assert list(r.differs) == [int(x) for x in mine]


@pytest.mark.parametrize("name", ["c23_low_quality_search", "e22_confidence_list", "e23_match_rates", "e24_problem_score", "e25_match_rates_bayes", "e3_heterozygous_calls", "e4_discrepancy", "f24_check_assembly", "e56_snp_candidates", "e57_consensus_runs", "e58_template_bases", "f10_difference_clips", "j13_alignment_columns", "j14_difference_scores"])
def test_no_row_a_base(spark, name):
    """Bases are made inside tasks: no plan explodes reads into positions or joins bases with calls."""
    plan = plans.registered()[name][0](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1 and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["f7_mean_quality_clip", "f14_best_window", "f15_unknown_density", "f18_bad_data_starts", "f9_unknown_base_clip", "f7_quality_clip_pairs", "f9_unknown_clip_pairs"])
def test_clips_explode_no_read(spark, name):
    plan = plans.registered()[name][0](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
