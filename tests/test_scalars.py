"""Scalar functions: AQI conversions, categories, seasons, hour buckets,
visibility estimates (FIXTURES §1.5 and §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourcast.functions import scalars as sc
from hourcast.functions import time as tm


def _eval(spark, values, fn, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_pm25_to_aqi(spark):
    vals = [0.0, 12.0, 12.05, 35.4, 500.4, 500.5, -1.0]
    assert _eval(spark, vals, sc.pm25_to_aqi) == [0, 50, 0, 100, 500, 500, 0]


def test_aqi_scale_map(spark):
    assert _eval(spark, [1, 2, 3, 4, 5, 9, None], sc.aqi_from_index, "int") == [25, 75, 125, 175, 300, 50, 50]


@pytest.mark.parametrize("aqi,cat", [
    (0, "Good"), (50, "Good"), (51, "Moderate"), (100, "Moderate"),
    (101, "Unhealthy for Sensitive Groups"), (150, "Unhealthy for Sensitive Groups"),
    (151, "Unhealthy"), (200, "Unhealthy"), (201, "Very Unhealthy"), (300, "Very Unhealthy"),
    (301, "Hazardous"), (500, "Hazardous")])
def test_category_boundaries(spark, aqi, cat):
    assert _eval(spark, [float(aqi)], sc.aqi_category) == [cat]


def test_unknown_category_and_advisories(spark):
    assert _eval(spark, [None], sc.aqi_category) == ["Unknown"]
    good, bad = _eval(spark, [30.0, 350.0], sc.health_advisory)
    assert "satisfactory" in good.lower() or "enjoy" in good.lower()
    assert "emergency" in bad.lower() or "avoid" in bad.lower()


def test_seasons(spark):
    months = [1, 3, 4, 6, 7, 9, 10, 12]
    df = spark.createDataFrame([(m,) for m in months], "m int")
    rows = df.select(*tm.season_flags(F.col("m"))).collect()
    names = [[k for k, v in r.asDict().items() if v][0] for r in rows]
    assert names == ["season_winter"] * 2 + ["season_spring"] * 2 + ["season_summer"] * 2 + ["season_fall"] * 2


def test_hour_bucket_is_floor(spark):
    assert _eval(spark, [3599, 3600, 7199, -1], tm.hour_bucket_unix, "bigint") == [0, 3600, 3600, -3600]


def test_visibility_estimates(spark):
    df = spark.createDataFrame([(90.0, 100.0, 10.0), (None, None, None), (40.0, 0.0, 400.0)],
                               "humidity double, clouds double, pm2_5 double")
    ing = [r[0] for r in df.select(sc.visibility_ingest_estimate()).collect()]
    assert ing == [3000, 10000, 10000]
    rep = [r[0] for r in df.select(sc.visibility_repair_estimate()).collect()]
    assert rep == [3000, 8000, 2000]


def test_calendar_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8),)], "ts timestamp_ntz")  # a Monday
    r = df.select(*tm.calendar_columns(F.col("ts"), "a")).first()
    assert r["day_of_week"] == 0 and r["is_rush_hour"] == 1 and r["is_weekend"] == 0 and r["week_of_year"] == 1


def test_feature_label_and_misc(spark):
    assert _eval(spark, ["pm2_5", "wind_u_lag"], sc.feature_label, "string") == ["PM2.5", "Wind U Lag"]
    assert _eval(spark, [0, 5], sc.current_aqi, "int") == [None, 5]
    assert _eval(spark, ["hour_sin", "pm10"], sc.explainable, "string") == [False, True]
    assert _eval(spark, ["pm2_5 > 10.00 and x"], sc.rule_base_name, "string") == ["pm2_5"]
    assert _eval(spark, [250.0, 160.0, 20.0], sc.alert_level) == ["ALERT", "WARNING", "OK"]
