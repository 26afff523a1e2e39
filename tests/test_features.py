"""Window-feature operators: the reference's feature assertions plus the
edge cases of FIXTURES §3 (padding, min_periods, city isolation)."""

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.operators import features as fx


def hourly_frame(spark, n=100, cities=("Lahore",)):
    """Fixture 1.1: n hourly rows per city from 2024-01-01 (seeded)."""
    df = spark.range(n).crossJoin(spark.createDataFrame([(c,) for c in cities], "city string")) \
        if len(cities) > 1 else spark.range(n).withColumn("city", F.lit(cities[0]))
    return df.select(
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"),
        "city",
        (F.lit(50) + (F.rand(42) * 150).cast("int")).alias("aqi"),
        F.round(F.lit(10.0) + F.rand(7) * 90, 2).alias("pm2_5"),
        F.round(F.lit(20.0) + F.rand(8) * 130, 2).alias("pm10"),
        "id")


def test_preset_b_lag_and_target(spark):
    out = fx.features_b(hourly_frame(spark)).orderBy("timestamp").collect()
    assert len(out) == 100                                   # row count unchanged
    assert out[1]["aqi_lag_1h"] == out[0]["aqi"]             # lag_1h[1] = aqi[0]
    assert out[0]["aqi_target_1h"] == out[1]["aqi"]          # target_1h[0] = aqi[1]
    assert out[0]["aqi_lag_1h"] is None
    assert all(0 <= r["hour"] <= 23 for r in out)
    for c in ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"):
        assert all(-1.0 <= r[c] <= 1.0 for r in out)


def test_preset_a_columns_and_feature_selection(spark):
    f = fx.features_a(hourly_frame(spark), decimals=2)
    cols = fx.feature_columns(f, "a")
    assert not any(c.startswith("target_") for c in cols)   # targets not in features
    assert "pm2_5_lag_72h" in cols and "pm2_5_rolling_std_48h" in cols and "hour_sin" in cols
    assert "hour" not in cols and "timestamp" not in cols
    b = fx.features_b(hourly_frame(spark))
    assert not any("_target_" in c for c in fx.feature_columns(b, "b"))
    assert f.count() == 100


def test_lags_never_cross_cities(spark):
    df = hourly_frame(spark, 30, cities=("A", "B"))
    out = fx.features_b(df).collect()
    for r in out:
        if r["timestamp"] == dt.datetime(2024, 1, 1):
            assert r["aqi_lag_1h"] is None and r["aqi_lag_24h"] is None


def _series(spark, values):
    rows = [(dt.datetime(2024, 1, 1, i), "c", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, x double")


def test_pct_change_pads_first(spark):
    df = _series(spark, [10.0, None, 20.0])
    out = fx.with_pct_change(df, fx.Series(), ["x"], [1]).orderBy("timestamp").collect()
    assert [r["x_pct_change_1h"] for r in out] == [None, 0.0, 1.0]
    w = fx.Series().window()
    d = df.select("timestamp", *fx.diff_columns(w, ["x"], [1])).orderBy("timestamp").collect()
    assert [r["x_diff_1h"] for r in d] == [None, None, None]


def test_pct_change_zero_base_is_null(spark):
    out = fx.with_pct_change(_series(spark, [0.0, 5.0]), fx.Series(), ["x"], [1]).orderBy("timestamp").collect()
    assert [r["x_pct_change_1h"] for r in out] == [None, None]


def test_rolling_std_single_value_is_null(spark):
    for dec in (None, 2):
        out = fx.with_rolling(_series(spark, [7.0]), fx.Series(), ["x"], [3], ["std", "mean"], 1, dec).collect()
        assert out[0]["x_rolling_std_3h"] is None and out[0]["x_rolling_mean_3h"] == 7.0


def test_rolling_min_periods(spark):
    vals = [1.0, None, 3.0, 4.0, 5.0]
    for dec in (None, 2):
        out = fx.with_rolling(_series(spark, vals), fx.Series(), ["x"], [3], ["mean"], None, dec) \
            .orderBy("timestamp").collect()
        assert [r["x_rolling_mean_3h"] for r in out] == [None, None, None, None, 4.0]


def test_exact_rolling_matches_float_path(spark):
    df = hourly_frame(spark, 200)
    s = fx.Series()
    a = fx.with_rolling(df, s, ["pm2_5"], [6, 24], fx.STATS, 1, 2, keep=["timestamp"]).orderBy("timestamp").collect()
    b = fx.with_rolling(df, s, ["pm2_5"], [6, 24], fx.STATS, 1, None, keep=["timestamp"]).orderBy("timestamp").collect()
    for ra, rb in zip(a, b):
        for k in ra.asDict():
            if k == "timestamp" or ra[k] is None:
                assert ra[k] == rb[k]
            else:
                assert math.isclose(ra[k], rb[k], rel_tol=1e-9, abs_tol=1e-9)


def test_one_window_node_plan(spark):
    """All lags, leads and rolling statistics share one exchange + sort."""
    f = fx.features_b(hourly_frame(spark), decimals=0)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_sparse_minmax_equals_frames(spark):
    """Fixed-point min/max (sparse table of lags) == bounded ROWS frames, for
    window sizes on and off the level boundaries, NULL runs and 3 keys."""
    n = 150
    df = spark.range(n).crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "city string")).select(
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"),
        "city",
        F.when(F.col("id").between(20, 40) | (F.col("id") % 9 == 0), F.lit(None))
         .otherwise(F.round(F.rand(5) * 100, 2)).alias("x"))
    sizes = [1, 2, 5, 16, 17, 63, 65]
    s = fx.Series()
    fast = fx.with_rolling(df, s, ["x"], sizes, ("min", "max"), 1, 2, keep=["city", "timestamp"])
    slow = fx.with_rolling(df, s, ["x"], sizes, ("min", "max"), 1, None, keep=["city", "timestamp"])
    key = ["city", "timestamp"]
    a = {tuple(r[k] for k in key): r.asDict() for r in fast.collect()}
    b = {tuple(r[k] for k in key): r.asDict() for r in slow.collect()}
    assert a == b and len(a) == 3 * n
