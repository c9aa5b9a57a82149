"""Queries against their SQL twins. TIDELINE_ALL=1 runs every query, the default a cross-section."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

SAMPLE = """flagship_ma_cross src_vwap_bars src_clean_provider_rows src_range_coverage prj_periods_and_folds prj_halving_resources
prj_param_neighbours jn_rate_accrual jn_resume_remaining dq_price_contract dq_session_mismatch dq_membership_events dq_issue_report
pf_eligibility wk_ewm wk_wma ind_adx str_tsmom_smoothed str_macd_zero_filter str_donchian str_supertrend str_zscore str_ensemble
led_proportional led_ruin led_schedules led_min_fee_and_capacity agg_period_metrics agg_snapshot_diff sea_grid_results sel_top
sel_overfitting_probability rob_neighbours bst_intervals pf_targets_members pf_book pf_turnover_budget ml_folds exp_overlap_counts
exp_recent_overlaps exp_study_status""".split()


def names():
    oracles = entry.oracle_sql()
    return sorted(oracles) if os.environ.get("TIDELINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, con, folder, name):
    status, _, _, detail = compare(spark, con, folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_entry(spark, folder):
    assert entry.entry(spark).count() == 6
