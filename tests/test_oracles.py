import pytest

from strandloom import plans
from tests.oracle import compare, connection

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in plans.registered().items() if sql))
def test_matches_sql(spark, duck, name):
    function, sql = plans.registered()[name]
    assert compare(function(spark, SMALL), duck, sql) == ""


#: Per-read state that SQL does not express; tests/test_perread.py and the tests of the operators have their cases.
NO_SQL = {"d41_contig_order", "d53_haplotype_sets", "e29_library_sizes", "e31_largest_insert", "d11_internal_joins", "j11_shuffled_pads", "f12_adaptive_quality_clips", "f21_low_complexity", "j1_global_alignments", "j8_local_alignments"}


def test_only_per_read_operators_lack_sql():
    assert {n for n, (_, sql) in plans.registered().items() if not sql} == NO_SQL


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs_without_sql(spark, name):
    assert plans.registered()[name][0](spark, SMALL).count() > 0
