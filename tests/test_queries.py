"""Registered queries against DuckDB at the smallest scale.

JOINTWORK_ALL=1 runs every query; the default is one per family.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
SAMPLE = """work_meta scope_rollup set_rollup person_pairs_department person_meta_program affil_enrich grant_active_overlap
collab_selfjoin relationship_classify anchor_buckets unit_matrix_department matrix_by_type partner_units unit_partner_list resolve_anchor
count_distinct_per_type_wide weighted_degree bridge_scholars compare_anchors dept_metrics retention rank_lens trend_series dept_intl
nearest_state reconcile_wide bulk_set_diff resolve_unit_in_text work_roster work_index payload_filename read_folders_union
csv_download incremental_ingest""".split()

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("JOINTWORK_ALL") else SAMPLE)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
