"""Feature-group load (S19), feature selection (T5), lookback reads (P18),
model listing allow-list (P26) and training guards (P25, A27)."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.operators import quality as qa
from hourcast.operators import split as sp
from hourcast.sources import store as st


def _rows(spark, hours, cities, hot=None, hot_rows=0):
    base = dt.datetime(2024, 3, 1)
    rows = [(base + dt.timedelta(hours=h), c, float(h * 3 + i)) for h in range(hours) for i, c in enumerate(cities)]
    # one hot hour holding many distinct sub-keys
    rows += [(base + dt.timedelta(hours=hot), f"z{j:05d}", float(j)) for j in range(hot_rows)] if hot is not None else []
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, v double")


def test_dense_ids_equal_global_row_number(spark):
    df = _rows(spark, 50, ["a", "b", "c"], hot=7, hot_rows=400).repartition(7)
    got = sp.dense_ids(df, ["timestamp", "city"], "rid")
    brute = df.withColumn("exp", F.row_number().over(Window.orderBy("timestamp", "city")) - 1)
    j = got.join(brute, ["timestamp", "city"])
    assert j.count() == df.count() == 550
    assert j.where(F.col("rid") != F.col("exp")).count() == 0
    ids = sorted(r[0] for r in got.select("rid").collect())
    assert ids == list(range(550))


def test_feature_group_rows_drops_nulls_and_casts_booleans(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, h), "a", float(h) if h != 2 else None, h % 2 == 0) for h in range(5)],
        "timestamp timestamp_ntz, city string, x double, flag boolean")
    fg = st.feature_group_rows(df).orderBy("observation_id").collect()
    assert [r["observation_id"] for r in fg] == [0, 1, 2, 3]
    assert [r["timestamp"].hour for r in fg] == [0, 1, 3, 4]
    assert [r["flag"] for r in fg] == [1, 0, 0, 1]
    assert fg[0]["event_time"] == fg[0]["timestamp"]


def test_top_by_corr_skips_constant_and_ranks_by_abs(spark):
    rows = [(float(i), float(-2 * i), float(i % 3), 1.0, float(i) + 0.5 * (i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "y double, neg double, noise double, const double, near double")
    got = qa.top_by_corr(df, "y", ["neg", "noise", "const", "near"], k=2).orderBy("rank").collect()
    assert [r["feature"] for r in got] == ["neg", "near"]
    assert got[0]["corr"] == pytest.approx(-1.0)


def test_lookback_rows_per_city_and_single_city(spark):
    df = _rows(spark, 24 * 10, ["a", "b"])
    df = df.where(~((F.col("city") == "b") & (F.col("timestamp") > F.lit(dt.datetime(2024, 3, 8)))))
    all_c = st.lookback_rows(df, 7)
    got = {r["city"]: r["count"] for r in all_c.groupBy("city").count().collect()}
    assert got == {"a": 7 * 24 + 1, "b": 7 * 24 + 1}
    one = st.lookback_rows(df, 7, city="b")
    assert one.count() == 7 * 24 + 1 and one.where("city <> 'b'").count() == 0


def test_list_models_allow_list(spark):
    reg = spark.createDataFrame([("ridge", "v1"), ("ridge", "v2"), ("secret", "v1")], "model_name string, version string")
    got = st.list_models(reg, ["ridge"]).orderBy("recency").collect()
    assert [(r["model_name"], r["version"], r["recency"]) for r in got] == [("ridge", "v2", 1), ("ridge", "v1", 2)]


def test_prepare_guards_and_nonzero(spark):
    from hourcast.ml import models as ml
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "a", float(i), float(i % 5), 0.0, 2.0 * i + 1)
            for i in range(200)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, x1 double, x2 double, z double, y double")
    with pytest.raises(ml.InsufficientData):
        ml.prepare(df.limit(50), ["x1", "x2"], "y")
    with pytest.raises(ml.InsufficientData):
        ml.prepare(df, ["x1"], "target_missing")
    tr, te = ml.prepare(df.withColumnRenamed("y", ml.LABEL), ["x1", "x2", "z"], ml.LABEL, scale=False)
    _, m = ml.train_and_evaluate(tr, te, ["lasso"])
    assert m.first()["n_nonzero"] <= 2


def test_order_present_keeps_keys_then_preferred(spark):
    from hourcast.operators import align as al
    df = spark.createDataFrame([("a", 1, 2.0, 3.0, 4.0, 5.0)],
                               "city string, timestamp int, pm10 double, temp_x double, temp double, aqi double")
    out = al.order_present(df)
    assert out.columns == ["city", "timestamp", "temp", "aqi", "pm10"]


def test_city_coordinates_case_insensitive_left_join(spark):
    from hourcast.operators import align as al
    obs = spark.createDataFrame([("Lahore", 1), ("KARACHI", 2), ("Quetta", 3)], "city string, v int")
    dim = spark.createDataFrame([("lahore", 31.5, 74.3), ("Karachi", 24.9, 67.0)], "city string, lat double, lon double")
    got = {r["city"]: (r["lat"], r["lon"]) for r in al.city_coordinates(obs, dim).collect()}
    assert got == {"Lahore": (31.5, 74.3), "KARACHI": (24.9, 67.0), "Quetta": (None, None)}


class Stop(Exception):
    pass


def _stop_at_filter(monkeypatch):
    from hourcast.operators import clean as cl
    seen = []

    def spy(df, *args):
        seen.append(df)
        raise Stop
    monkeypatch.setattr(cl, "drop_incomplete", spy)
    return seen


def _windowed(spark):
    from hourcast.operators import features as fx
    df = _rows(spark, 30, ["a", "b"])
    return df.select("*", *fx.lag_columns(fx.Series().window(), ["v"], (1, 2)))


def _is_written(df):
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD"


def test_feature_group_rows_filters_a_written_frame(spark, monkeypatch):
    """A filter on the windows' aliases took the driver's memory to plan."""
    seen = _stop_at_filter(monkeypatch)
    with pytest.raises(Stop):
        st.feature_group_rows(_windowed(spark))
    assert _is_written(seen[0])


def test_feature_view_filters_a_written_frame(spark, monkeypatch):
    from hourcast.plans import q_features, q_store
    seen = _stop_at_filter(monkeypatch)
    monkeypatch.setattr(q_features, "features_full_a", lambda spark, sf: _windowed(spark))
    for query in ("feature_view_split", "feature_select_top50"):
        with pytest.raises(Stop):
            q_store.QUERIES[query](spark, None)
    assert len(seen) == 2 and all(map(_is_written, seen))


def test_corr_with_a_constant_column(spark):
    """NaN, as in the SQL, and no division by zero under ANSI."""
    rows = [(float(i), 0.1, float(3 * i), None if i else 1.0, None) for i in range(7)]
    df = spark.createDataFrame(rows, "y double, const double, near double, once double, never double").repartition(3)
    got = {r["feature"]: r["corr"] for r in qa.corr_with(df, "y", ["const", "near", "once", "never"]).collect()}
    assert math.isnan(got["const"]) and math.isnan(got["once"]) and got["near"] == 1.0 and got["never"] is None
    assert math.isnan(qa.corr_with(df, "const", ["y"]).first()["corr"])
    hours = spark.createDataFrame([("a", i, 0.1, ) for i in range(9)], "city string, h int, x double") \
        .withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    assert math.isnan(qa.shape_stats(hours.select("city", "timestamp", "x"), "x").first()["autocorr_lag1"])
