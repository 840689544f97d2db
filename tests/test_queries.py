"""A cross-section of the registry against DuckDB; ``tests/check.py`` runs all."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

NAMES = [
    "s2_scan_many",
    "s3_select_months",
    "s5_scan_prediction_log",
    "k1_write_splits",
    "k5_append_log",
    "p10_filter_speed",
    "p13_clean_audit",
    "p13b_clean_audit_impute",
    "p23b_validate_raw_trips",
    "f3_duration_minutes",
    "f7_is_rush_hour",
    "f23_cut",
    "j1_lookup_route_distance",
    "j4_encode_lookup",
    "a2_null_profile",
    "a5_pivot_count",
    "a11_corr_matrix",
    "a14_histogram",
    "a19_metrics_by_split",
    "a21_segment_metrics",
    "w3b_last_n_per_key",
    "x1_sample_n",
    "d1_column_drift",
    "d6_check_alerts",
    "m1_get_model",
    "m11_serving_features",
    "r1_stream_score",
    "r3_stream_window_stats",
]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 24


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
