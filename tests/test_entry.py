"""Driver contract and a strict oracle comparison on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

ORACLE_SAMPLE = ["obs_hourly", "features_full_a", "features_full_b", "change_b", "baseline_metrics",
                 "split_chrono", "upsert", "align_outer", "describe", "gap_fill_linear", "parse_current",
                 "scale_standard", "long_series_features", "accuracy_history"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"horizon", "model", "rmse", "mae", "r2", "mape"} <= set(df.columns)


def test_oracle_keys_subset():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_matches_duckdb(spark, name):
    from tools.oracle_check import compare, duck
    con = duck(SF_SMALL)
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_SMALL, verbose=False)
