"""Feature store upsert / range read, registry and dedupe semantics."""

import datetime as dt

from pyspark.sql import functions as F

from hourcast.operators import align as al
from hourcast.sources import store as st


def _rows(spark, vals, city="c"):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1, h), city, v) for h, v in vals],
                                 "timestamp timestamp_ntz, city string, aqi double")


def test_upsert_last_write_wins(spark):
    out = al.upsert(_rows(spark, [(0, 1.0), (1, 1.0)]), _rows(spark, [(0, 2.0)])).orderBy("timestamp").collect()
    assert [r["aqi"] for r in out] == [2.0, 1.0]


def test_store_roundtrip(spark, tmpdir_path):
    fs = st.FeatureStore(spark, tmpdir_path)
    fs.upsert(_rows(spark, [(0, 1.0), (5, 1.0)]), "g")
    fs.upsert(_rows(spark, [(0, 2.0)]), "g")
    fs.upsert(_rows(spark, [(0, 3.0)], city="d"), "g")
    got = {(r["city"], r["timestamp"].hour): r["aqi"] for r in fs.read("g").collect()}
    assert got == {("c", 0): 2.0, ("c", 5): 1.0, ("d", 0): 3.0}
    rng = fs.read("g", start=dt.datetime(2024, 1, 1, 1), end=dt.datetime(2024, 1, 1, 5))
    assert rng.count() == 1
    assert fs.read("missing").count() == 0
    # Time-only key drops the other city's row at the same hour
    fs.upsert_time_only(_rows(spark, [(0, 9.0)]), "g")
    assert fs.read("g").where(F.hour("timestamp") == 0).count() == 1


def test_keep_first_last(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, t int, v double")
    first = {r["k"]: r["v"] for r in al.keep_one(df, ["k"], ["t"], "first").collect()}
    last = {r["k"]: r["v"] for r in al.keep_one(df, ["k"], ["t"], "last").collect()}
    assert first == {"a": 10.0, "b": 5.0} and last == {"a": 20.0, "b": 5.0}


def test_registry_latest(spark):
    reg = spark.createDataFrame([("ridge", "20260101_000000", {"rmse": 2.0}), ("ridge", "20260102_000000", {"rmse": 1.0}),
                                 ("gbt", "20260101_000000", {"rmse": 3.0})],
                                "model_name string, version string, metrics map<string,double>")
    latest = {r["model_name"]: r["version"] for r in st.latest_versions(reg).collect()}
    assert latest == {"ridge": "20260102_000000", "gbt": "20260101_000000"}
    new = spark.createDataFrame([("gbt", "20260101_000000", {"rmse": 9.0})], reg.schema)
    up = st.registry_upsert(reg, new).where("model_name = 'gbt'").first()
    assert up["metrics"]["rmse"] == 9.0


def test_prediction_log_append(spark, tmpdir_path):
    log = spark.createDataFrame([("c", dt.date(2024, 1, 2), 80.0, "ridge")], st.PREDICTION_LOG)
    st.append_predictions(log, tmpdir_path + "/log")
    st.append_predictions(log, tmpdir_path + "/log")
    assert spark.read.parquet(tmpdir_path + "/log").count() == 2


def test_upsert_dedupes_first_write_and_keeps_last_arrival(spark, tmpdir_path):
    fs = st.FeatureStore(spark, tmpdir_path)
    fs.upsert(_rows(spark, [(0, 9.0), (0, 1.0)]).coalesce(1), "g")
    assert [r["aqi"] for r in fs.read("g").collect()] == [1.0]
    late = _rows(spark, [(0, 5.0), (0, 7.0)]).withColumn("seq", F.when(F.col("aqi") == 5.0, 2).otherwise(1))
    fs.upsert(late, "h", arrival="seq")
    assert [r["aqi"] for r in fs.read("h").collect()] == [5.0]


def test_first_nonempty_keeps_real_errors(spark, tmpdir_path):
    import pytest
    ok = _rows(spark, [(0, 1.0)])
    assert st.first_nonempty([lambda: spark.read.parquet(tmpdir_path + "/none"), lambda: ok]).count() == 1
    with pytest.raises(ZeroDivisionError):
        st.first_nonempty([lambda: 1 / 0, lambda: ok])


def test_a_reader_sees_old_or_new_and_never_half(spark, tmpdir_path, monkeypatch):
    fs = st.FeatureStore(spark, tmpdir_path)
    fs.upsert(_rows(spark, [(0, 1.0), (1, 1.0)]), "g")
    before = fs.read("g")
    seen = []
    real = fs._swap
    # the new version is written in full, but its pointer is not in place yet
    monkeypatch.setattr(fs, "_swap", lambda g, p: seen.append(sorted(r["aqi"] for r in fs.read(g).collect())) or real(g, p))
    fs.upsert(_rows(spark, [(0, 2.0), (2, 2.0)]), "g")
    assert seen == [[1.0, 1.0]]
    assert sorted(r["aqi"] for r in before.collect()) == [1.0, 1.0]  # an open reader keeps its state
    assert sorted(r["aqi"] for r in fs.read("g").collect()) == [1.0, 2.0, 2.0]
    assert sorted(r["aqi"] for r in fs.frame("g", 0).collect()) == [1.0, 1.0]


def test_an_overtaken_writer_merges_again(spark, tmpdir_path, monkeypatch):
    fs, other = st.FeatureStore(spark, tmpdir_path), st.FeatureStore(spark, tmpdir_path)
    fs.upsert(_rows(spark, [(0, 1.0)]), "g")
    real, first = fs._put, []

    def put(df, group):
        out = real(df, group)
        if not first:
            first.append(1)
            other.upsert(_rows(spark, [(5, 5.0)]), "g")
        return out
    monkeypatch.setattr(fs, "_put", put)
    fs.upsert(_rows(spark, [(1, 2.0)]), "g")
    assert sorted(r["aqi"] for r in fs.read("g").collect()) == [1.0, 2.0, 5.0]


def test_one_write_per_upsert_and_vacuum(spark, tmpdir_path):
    import os
    fs = st.FeatureStore(spark, tmpdir_path)
    day2 = _rows(spark, [(3, 3.0)]).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    for i, df in enumerate([_rows(spark, [(0, 1.0)]), day2, _rows(spark, [(1, 2.0)]), _rows(spark, [(0, 4.0)])]):
        fs.upsert(df, "g")
        assert len(os.listdir(f"{tmpdir_path}/g/data")) == i + 1
    assert fs.vacuum("g", keep=1) == 2  # the first day's two older versions
    assert sorted(r["aqi"] for r in fs.read("g").collect()) == [2.0, 3.0, 4.0]
    assert fs.read("g", start=dt.datetime(2024, 1, 2)).count() == 1
    fs.write(_rows(spark, [(7, 7.0)]), "g")
    assert [r["aqi"] for r in fs.read("g").collect()] == [7.0]


def test_empty_updates_new_columns_and_rows_without_a_time(spark, tmpdir_path):
    fs = st.FeatureStore(spark, tmpdir_path)
    fs.upsert(_rows(spark, []), "g")
    assert fs.exists("g") and fs.read("g").columns == ["timestamp", "city", "aqi"] and fs.read("g").count() == 0
    fs.upsert(spark.createDataFrame([(None, "c", 1.0)], "timestamp timestamp_ntz, city string, aqi double"), "g")
    fs.upsert(_rows(spark, [(0, 2.0)]).withColumn("extra", F.lit("x")), "g")
    fs.upsert(_rows(spark, []), "g")
    got = sorted(((r["aqi"], r["timestamp"] is None) for r in fs.read("g").collect()))
    assert got == [(1.0, True), (2.0, False)]
    assert fs.read("g", end=dt.datetime(2024, 1, 2)).count() == 1


def test_progress_resumes_and_one_city_starts_anew(spark, tmpdir_path):
    log = st.ProgressLog(spark, tmpdir_path + "/progress")
    assert log.done().count() == 0
    d = lambda rows: spark.createDataFrame([(c, dt.date(2024, 1, n), r) for c, n, r in rows], "city string, day date, records long")
    log.record(d([("a", 1, 24), ("b", 1, 24)]))
    log.record(d([("a", 1, 20), ("a", 2, 24)]))
    now = lambda: sorted((r.city, r.day.day, r.records) for r in log.done().collect())
    assert now() == [("a", 1, 20), ("a", 2, 24), ("b", 1, 24)]
    log.reset("a", "unknown")
    assert now() == [("b", 1, 24)]
    log.record(d([("a", 1, 5)]))
    assert now() == [("a", 1, 5), ("b", 1, 24)]


def test_feature_view_refuses_leaking_labels(spark):
    import pytest
    df = spark.createDataFrame([("c", dt.datetime(2024, 1, 1, h), 1.0 * h, 2.0 * h) for h in range(10)],
                               "city string, timestamp timestamp_ntz, x double, target_1h double")
    train, test = st.train_test(st.feature_view(df, ["x"], ["target_1h"]))
    assert train.count() == 8 and sorted(r.x for r in test.collect()) == [8.0, 9.0]
    for bad in (["x", "target_1h"], ["y"]):
        with pytest.raises(ValueError):
            st.feature_view(df, bad, ["target_1h"])


def test_registry_documents(spark, tmpdir_path):
    reg = spark.createDataFrame([("ridge", "20260101_000000", None, {"rmse": 2.0}, {"alpha": "1"}, ["x"]),
                                 ("ridge", "20260102_000000", None, {"rmse": 1.0}, None, None)], st.REGISTRY)
    st.write_registry(reg, tmpdir_path)
    got = st.read_registry(spark, f"{tmpdir_path}/models/*/*/*.json")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, reg.collect()), key=repr)
    assert st.latest_versions(got).first()["version"] == "20260102_000000"
