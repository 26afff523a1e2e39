"""Splits, folds, metrics and accuracy (FIXTURES §1.3, §1.4, §3)."""

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.operators import metrics as mx
from hourcast.operators import split as sp


def _frame(spark, n, cities=("a",)):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), c) for i in range(n) for c in cities]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string")


def test_chrono_split_sizes(spark):
    s = sp.chrono_split(_frame(spark, 10))
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"train": 8, "test": 2}
    last_train = s.where("split = 'train'").agg(F.max("timestamp")).first()[0]
    first_test = s.where("split = 'test'").agg(F.min("timestamp")).first()[0]
    assert last_train < first_test


def test_expanding_folds(spark):
    f = sp.ts_folds(_frame(spark, 10), 3).orderBy("timestamp").collect()
    assert [r["test_fold"] for r in f] == [-1, -1, -1, -1, 0, 0, 1, 1, 2, 2]
    train, test = sp.fold_frame(sp.ts_folds(_frame(spark, 10), 3), 1)
    assert train.count() == 6 and test.count() == 2


def test_split_with_ties_matches_global_rank(spark):
    """Boundary inside a timestamp shared by several cities: compare with a
    brute-force global row_number."""
    df = _frame(spark, 7, cities=("a", "b", "c"))   # 21 rows, cut at 16 falls inside an hour
    s = sp.chrono_split(df, 0.2)
    brute = df.withColumn("rn", F.row_number().over(Window.orderBy("timestamp", "city"))) \
        .withColumn("exp", F.when(F.col("rn") <= int(21 * 0.8), "train").otherwise("test"))
    j = s.join(brute, ["timestamp", "city"])
    assert j.where("split <> exp").count() == 0 and j.count() == 21


def test_metric_bundle(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 2.2, 2.9, 4.1, 4.8])), "y double, yhat double")
    m = mx.evaluate(df, []).first()
    assert math.isclose(m["mae"], 0.14, abs_tol=1e-9)
    assert math.isclose(m["rmse"], math.sqrt(0.022), abs_tol=1e-9)
    assert math.isclose(m["r2"], 0.989, abs_tol=1e-9)
    assert math.isclose(m["mape"], 5.966666666666667, abs_tol=1e-6)


def test_best_model(spark):
    df = spark.createDataFrame([("model_a", 0.5, 0.9), ("model_b", 0.3, 0.95), ("model_c", 0.7, 0.85)],
                               "model string, rmse double, r2 double")
    assert mx.best_by(df, "rmse").first()["model"] == "model_b"
    assert mx.best_by(df, "r2").first()["model"] == "model_b"


def test_accuracy_score(spark):
    h = spark.createDataFrame([("x", "m", 110.0, 100.0), ("y", "m", 5.0, 0.0)],
                              "city string, model_used string, predicted double, actual double")
    s = {r["city"]: r["accuracy"] for r in mx.accuracy_score(h).collect()}
    assert math.isclose(s["x"], 90.0) and s["y"] is None


def test_sequences(spark):
    df = _frame(spark, 10).withColumn("v", F.hour("timestamp").cast("double"))
    s = sp.sequences(df, ["v"], "v", 3)
    assert s.count() == 7
    r = s.orderBy("timestamp").first()
    assert len(r["sequence"]) == 3


def test_integer_sums_do_not_overflow(spark):
    from hourcast.operators import quality as qa
    from hourcast.operators import scale as scl
    df = spark.range(1_000_000).select((F.lit(1000.0) + F.col("id") % 50).alias("pressure"))
    got = {r[0]: r for r in qa.describe(df, ["pressure"], decimals=2).collect()}
    assert len(got) == 1
    m, s = scl.fit_standard(df, ["pressure"], decimals=2)["pressure"]
    assert abs(m - 1024.5) < 1e-9 and abs(s - ((50 ** 2 - 1) / 12) ** 0.5) < 1e-9


def test_vector_scaler_finds_constant_columns(spark):
    from hourcast.operators import scale as scl
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), F.lit(3.7).alias("c"))
    p = scl.fit_complete(df, ["x", "c"])
    assert p["x"][0] == 50.0 and abs(p["x"][1] - ((101 ** 2 - 1) / 12) ** 0.5) < 1e-9 and p["c"][1] == 0.0


def test_quantiles_match_numpy(spark):
    import numpy as np
    from hourcast.operators import quality as qa
    rows = [(float((i * 37) % 101) / 4, None if i % 3 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("empty", F.lit(None).cast("double"))
    got = qa.quantiles(df.repartition(5), ["a", "b", "empty"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for i, c in enumerate(["a", "b"]):
        vals = [r[i] for r in rows if r[i] is not None]
        assert np.allclose(got[c], np.quantile(vals, [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert got["empty"] == [None] * 5


def test_split_of_empty_and_hot_timestamp(spark):
    """An empty frame stays empty; a cut inside one timestamp with most rows
    leaves exactly the wanted number of rows before it, in tie-break order."""
    empty = _frame(spark, 0)
    assert sp.chrono_split(empty).count() == 0
    df = spark.range(100).select(
        F.when(F.col("id") < 10, F.lit(1)).when(F.col("id") < 95, F.lit(2)).alias("timestamp"),
        F.format_string("c%03d", F.col("id")).alias("city")).repartition(6)
    got = sp.chrono_split(df).orderBy(F.col("timestamp").asc_nulls_first(), "city").collect()
    assert [r["split"] for r in got] == ["train"] * 80 + ["test"] * 20


def test_contiguous_folds(spark):
    got = sp.contiguous_folds(_frame(spark, 13), 5).orderBy("timestamp").select("test_fold").collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_pipeline_saved_and_permuted(spark, tmpdir_path):
    """A saved pipeline predicts the same; only features that the target
    depends on gain RMSE when permuted; LIME ranks the same feature first."""
    from hourcast.ml import explain as ex
    from hourcast.ml import models as ml
    df = _frame(spark, 400).select("timestamp", "city", F.monotonically_increasing_id().alias("i")) \
        .select("timestamp", "city", (F.xxhash64("timestamp", F.lit(1)) % 100).cast("double").alias("x1"),
                (F.xxhash64("timestamp", F.lit(2)) % 100).cast("double").alias("x2"), F.lit(3.0).alias("flat"))
    df = df.withColumn("y", F.col("x1") * 2 + 5)
    feats = ["x1", "x2", "flat"]
    fitted, m = ml.train_grid(df, feats, {1: "y"}, ["ridge", "lightgbm"], {"lightgbm": {"n_estimators": 3}})
    assert {r["model"] for r in m.collect()} == {"ridge", "lightgbm"}
    model = fitted[1, "ridge"]
    ml.save_models({"ridge": ml.whole(feats, model)}, tmpdir_path)
    again = ml.load_model(f"{tmpdir_path}/ridge").transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert again < 2.0
    vec = ml.vectors(df, feats, ["y"])
    gain = {r["feature"]: r["rmse_increase"] for r in ex.permutation_importance(vec, model, feats, "y", ["city", "timestamp"]).collect()}
    assert gain["x1"] > 50 and abs(gain["x2"]) < 1 and gain["flat"] == 0.0
    local = ex.lime(ex.background_sample(vec, ["city", "timestamp"], 3), model, feats, ["city", "timestamp"], [58.0, 58.0, 0.0], 200)
    assert local.orderBy(F.col("mean_abs_weight").desc()).first()["feature"] == "x1"
