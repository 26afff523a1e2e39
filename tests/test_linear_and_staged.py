"""Linear models from moments, ensembles by prefixes, early stopping with patience."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from hourcast.ml import gram, staged
from hourcast.ml import models as ml


def frame(spark, n=400, p=6, seed=1, folds=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) @ r.normal(size=(p, p)) + 1000 * np.arange(p)
    x[:, -1] = 7.0  # constant
    y = x[:, 0] * 3 - x[:, 1] * 2 + r.normal(size=n) * 2 + 50
    rows = [(i % folds, Vectors.dense(x[i]), float(y[i]) if i % 50 else None) for i in range(n)]
    keep = np.arange(n) % 50 != 0
    return spark.createDataFrame(rows, ["fold", "raw_features", "label"]), x[keep], y[keep], np.arange(n)[keep] % folds


def test_moments_equal_numpy_and_add_up(spark):
    df, x, y, fold = frame(spark)
    per = gram.moments(df, "raw_features", "label", "fold")
    assert sorted(per) == [0, 1, 2, 3]
    total = per[0] + per[1] + per[2] + per[3]
    mean, cov = total.centred()
    z = np.column_stack([x, y])
    assert np.allclose(mean, z.mean(0)) and np.allclose(cov, np.cov(z.T, bias=True))
    mean, cov = (total - per[2]).centred()
    assert np.allclose(cov, np.cov(z[fold != 2].T, bias=True))


@pytest.mark.parametrize("alpha", [0.01, 1.0, 100.0])
def test_ridge_closed_form(spark, alpha):
    df, x, y, _ = frame(spark)
    w = gram.fit("ridge", ml.label_moments(df, "raw_features"), {"alpha": alpha})
    s = x.std(0)
    xs = ((x - x.mean(0)) / np.where(s > 0, s, 1))[:, s > 0]
    want = np.linalg.solve(xs.T @ xs + alpha * np.eye(xs.shape[1]), xs.T @ (y - y.mean()))
    assert np.allclose(w.scaled[s > 0], want) and w.scaled[-1] == 0
    assert np.allclose(x @ w.w + w.intercept, xs @ want + y.mean())


@pytest.mark.parametrize("name,params,alpha,l1", [("lasso", {"alpha": 0.001}, 0.001, 1.0), ("lasso", {"alpha": 1.0}, 1.0, 1.0), ("lasso", {}, 0.1, 1.0),
                                                  ("elastic_net", {}, 1.0, 0.5), ("elastic_net", {"alpha": 0.5, "l1_ratio": 0.1}, 0.5, 0.1)])
def test_sparse_optimality(name, params, alpha, l1):
    r = np.random.default_rng(4)
    for n, p in ((60, 3), (300, 40), (120, 110)):
        x = np.cumsum(r.normal(size=(n, p)), 0) * 0.1 + np.repeat(r.normal(size=(n, (p + 3) // 4)), 4, 1)[:, :p]
        y = x[:, :3].sum(1) * 10 + r.normal(size=n)
        z = np.column_stack([np.ones(n), x, y])
        w = gram.fit(name, gram.Moments(z.T @ z, np.zeros(p + 1)), params)
        xs = (x - x.mean(0)) / x.std(0)
        g = xs.T @ (y - y.mean() - xs @ w.scaled) / n - alpha * (1 - l1) * w.scaled
        on = w.scaled != 0
        assert np.allclose(g[on], alpha * l1 * np.sign(w.scaled[on]), atol=1e-6)
        assert (np.abs(g[~on]) <= alpha * l1 + 1e-6).all()
        assert w.nonzero == on.sum()


def test_all_weights_zero_and_no_feature_varies(spark):
    df, _, y, _ = frame(spark)
    m = ml.label_moments(df, "raw_features")
    assert gram.fit("lasso", m, {"alpha": 1e9}).nonzero == 0
    flat = gram.moments(spark.createDataFrame([(0, Vectors.dense([5.0]), float(v)) for v in (1, 2, 6)], ["g", "f", "y"]), "f", "y", "g")[0]
    got = gram.fit("ridge", flat)
    assert got.nonzero == 0 and got.intercept == pytest.approx(3.0)
    assert gram.moments(df.limit(0), "raw_features", "label", "fold") == {}


def test_solved_model_is_a_spark_model(spark, tmp_path):
    df, x, y, _ = frame(spark)
    w = gram.fit("ridge", ml.label_moments(df, "raw_features"))
    m = gram.as_model(w.w, w.intercept, "raw_features")
    m.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml.regression import LinearRegressionModel
    again = LinearRegressionModel.load(str(tmp_path / "m")).transform(df.where("label is not null"))
    assert np.allclose(sorted(r.prediction for r in again.collect()), sorted(x @ w.w + w.intercept))
    assert ml.nonzero_count(m) == 5


def test_cv_of_linear_runs_is_fold_by_fold(spark):
    r = np.random.default_rng(3)
    n = 120
    x = r.normal(size=(n, 2))
    y = x @ [2.0, -1.0] + r.normal(size=n) * 0.3
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + dt.timedelta(hours=i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)],
                               "city string, timestamp timestamp_ntz, u double, v double, target double")
    got = {r.model: r for r in ml.cv_runs(df, ["u", "v"], "target", [("r1", "ridge", {"alpha": 1.0}), ("l1", "lasso", {"alpha": 0.1})],
                                          4, contiguous=True).collect()}
    rmse = []
    for k in range(4):
        te = np.arange(n) // 30 == k
        s, m = x[~te].std(0), x[~te].mean(0)
        xs = (x[~te] - m) / s
        w = np.linalg.solve(xs.T @ xs + np.eye(2), xs.T @ (y[~te] - y[~te].mean()))
        rmse.append(np.sqrt(np.mean((y[te] - y[~te].mean() - (x[te] - m) / s @ w) ** 2)))
    assert got["r1"].folds == 4 and got["r1"].rmse_mean == pytest.approx(np.mean(rmse))
    assert got["l1"].rmse_mean > got["r1"].rmse_mean


# ensembles ----------------------------------------------------------------------
def trees_frame(spark, n=240, noise=0.0, seed=0):
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, size=(n, 3))
    y = np.sin(x[:, 0] * 2) * 5 + x[:, 1] ** 2 + r.normal(size=n) * noise
    rows = [(Vectors.dense(x[i]), float(y[i]), bool(i >= n * 3 // 4)) for i in range(n)]
    return spark.createDataFrame(rows, ["features", "label", "held_back"]).coalesce(1).cache()


def test_stop_after():
    assert staged.stop_after([5, 4, 3, 2], 2) == (4, False)
    assert staged.stop_after([5, 4, 4, 4, 1], 2) == (2, True)  # the later best lies behind the stop
    assert staged.stop_after([5, 4, 6, 3, 9, 9], 2) == (4, True)
    assert staged.stop_after([1.0], 20) == (1, False)


def test_prefix_of_boosting_is_the_smaller_fit(spark):
    df = trees_frame(spark, noise=1.0)
    big = GBTRegressor(maxIter=12, maxDepth=3, stepSize=0.3, seed=5).fit(df)
    small = GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.3, seed=5).fit(df)
    cut = staged.prefix(big, 5)
    assert cut.getNumTrees == 5 and staged.prefix(big, 12) is big
    a, b = (sorted(r.prediction for r in m.transform(df).collect()) for m in (cut, small))
    assert np.allclose(a, b)
    with pytest.raises(ValueError):
        staged.prefix(big, 13)


def test_prefix_of_a_forest_is_the_mean_of_its_first_trees(spark):
    df = trees_frame(spark, noise=1.0)
    big = RandomForestRegressor(numTrees=9, maxDepth=4, seed=5).fit(df)
    cut = staged.prefix(big, 4)
    want = np.mean([[r.prediction for r in t.transform(df).collect()] for t in big.trees[:4]], 0)
    assert np.allclose([r.prediction for r in cut.transform(df).collect()], want)


def test_a_slow_learner_is_not_stopped_early(spark):
    """A small step still gains after 20 rounds: they are all kept (Spark's own
    stop would end at the first round that gains under one per cent)."""
    df = trees_frame(spark)
    m = staged.boost_with_patience(GBTRegressor(maxIter=60, maxDepth=2, stepSize=0.05, seed=1), df, "held_back", first_rounds=30)
    assert m.getNumTrees > 20


def test_noise_is_cut_at_the_best_prefix(spark):
    r = np.random.default_rng(2)
    rows = [(Vectors.dense(r.normal(size=3)), float(r.normal()), i >= 120) for i in range(160)]
    df = spark.createDataFrame(rows, ["features", "label", "held_back"]).coalesce(1).cache()
    est = GBTRegressor(maxIter=40, maxDepth=4, stepSize=0.3, seed=1)
    m = staged.boost_with_patience(est, df, "held_back", patience=5, first_rounds=40)
    full = est.fit(df.where("not held_back"))
    errors = full.evaluateEachIteration(df.where("held_back"), "squared")
    keep, stopped = staged.stop_after(errors, 5)
    assert stopped and m.getNumTrees == keep < 40 and min(errors[:keep + 5]) == errors[keep - 1]


def test_patience_without_held_back_rows_keeps_all(spark):
    df = trees_frame(spark)
    from pyspark.sql import functions as F
    m = staged.boost_with_patience(GBTRegressor(maxIter=4, maxDepth=2, seed=1), df.withColumn("held_back", F.lit(False)), "held_back")
    assert m.getNumTrees == 4


def test_sizes_of_one_shape_share_a_fit(spark, monkeypatch):
    import datetime as dt
    r = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + dt.timedelta(hours=i), float(v), float(v * 2)) for i, v in enumerate(r.normal(size=60))],
                               "city string, timestamp timestamp_ntz, u double, target double")
    fits = []
    real = ml.fit
    monkeypatch.setattr(ml, "fit", lambda name, *a, **k: fits.append((name, a[3])) or real(name, *a, **k))
    got = ml.tune(df, ["u"], "target", {"gradient_boosting": [{"n_estimators": n, "max_depth": d} for n in (2, 5) for d in (1, 2)],
                                        "random_forest": [{"n_estimators": n} for n in (2, 3)], "ridge": [{"alpha": 1.0}, {"alpha": 9.0}]}, 2)
    assert got.count() == 8 and {r["rank"] for r in got.where("model = 'gradient_boosting'").collect()} == {1, 2, 3, 4}
    assert sorted((n, p["n_estimators"]) for n, p in fits) == sorted([("gradient_boosting", 5)] * 4 + [("random_forest", 3)] * 2)


def test_at_once_starts_the_costly_fits_first(spark):
    """In order of cost and one by one, not in runs of neighbours; results in the order given."""
    from hourcast.ml import models as ml
    begun = []
    got = ml.at_once([lambda i=i: begun.append(i) or i for i in range(9)], 1, [0, 3, 0, 9, 0, 1, 9, 0, 2])
    assert got == list(range(9)) and begun == [3, 6, 1, 8, 5, 0, 2, 4, 7]
    names = ["ridge", "random_forest", "gradient_boosting", "xgboost"]
    assert [ml.cost(n) for n in names] == [0, 1000, 500, 3000]
    assert ml.cost("lightgbm", {"n_estimators": 10, "max_depth": 2, "patience": 3, "memory_mb": 32}) == 20


def test_packed_frames_are_written(spark):
    """Fits read files from any executor, not the one that cached a partition."""
    from hourcast.ml import models as ml
    df = spark.range(50).selectExpr("id", "id * 2.0d as x").repartition(5)
    got = ml.packed(df, 50, 2)
    assert got.rdd.getNumPartitions() == 1 and sorted(got.collect()) == sorted(df.collect())
    assert got._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD"
