"""Model training, CV, scoring and explanation queries (M5-M26). Fitting on
all features has no SQL equivalent (rows-only check); the ``*_closed_form``
queries run the same code on two features, where ridge has one. The data
preparation is oracle-checked elsewhere (features_full_a, split_chrono,
scale_standard, baseline_metrics)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourcast.ml import explain as ex
from hourcast.ml import models as ml
from hourcast.ml import score as sc
from hourcast.operators import features as fx
from hourcast.operators import metrics as mx
from hourcast.plans import sqlgen as sg
from hourcast.plans.q_features import preset_a
from hourcast.session import checkpoint_dir, cut_lineage
from hourcast.sources import views
from hourcast.sources.store import files_state

QUERIES: dict = {}
ORACLE: dict = {}
LABEL = "target_24h"
KEY = ["city", "timestamp"]


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_FRAMES: dict = {}


def feature_frame(spark, sf):
    """The feature frame and its feature names: checkpointed once per session
    and state of the input files, shared by every model query."""
    key = (spark.sparkContext.applicationId, sf)
    state = files_state(spark, f"{sf}/events.parquet")
    if key not in _FRAMES or _FRAMES[key][0] != state:
        f, feats = _feature_frame(spark, sf)
        _FRAMES[key] = (state, cut_lineage(f), feats)
    return _FRAMES[key][1:]


def _feature_frame(spark, sf):
    f = preset_a(views.obs(spark, sf))
    feats = [c for c in fx.feature_columns(f, "a") if c not in ("n", "aqi")]
    return f.select(*[F.col(c).cast("int").alias(c) if c.startswith("season_") else F.col(c) for c in f.columns]), feats


#: split statistics per task, for several fits at a time in a small heap;
#: it bounds memory and changes no tree. Everything else is the operators' own
MEMORY = {"memory_mb": 32}
TREES = {name: MEMORY for name in ("random_forest", "gradient_boosting", "xgboost", "lightgbm")}
#: The declared space. An unlimited depth is Spark's largest, 30; a
#: smallest node to split has no counterpart in Spark's trees
SPACE = {
    "random_forest": [{"n_estimators": n, "max_depth": d, **MEMORY} for n in (100, 200, 300, 500) for d in (5, 10, 15, 20, 30)],
    "gradient_boosting": [{"n_estimators": n, "learning_rate": r, "max_depth": d, **MEMORY}
                          for n in (100, 200, 300) for r in (0.01, 0.05, 0.1, 0.2) for d in (3, 5, 7, 10)]}


def _single(name):
    def run(spark, sf):
        f, feats = feature_frame(spark, sf)
        _, m = ml.train_grid(f, feats, {24: LABEL}, [name], TREES)
        return m.drop("horizon")
    return run


for _n, _q in [("ridge", "ridge"), ("lasso", "lasso"), ("elastic_net", "elastic_net"), ("random_forest", "forest"),
               ("gradient_boosting", "gbt"), ("xgboost", "xgboost"), ("lightgbm", "lightgbm")]:
    QUERIES[_q] = _single(_n)


@q("horizon_grid")
def horizon_grid(spark, sf):
    f, feats = feature_frame(spark, sf)
    return ml.horizon_grid(f, feats, fx.PresetA().horizons, list(ml.FACTORY), params=TREES)


@q("train_save_best")
def train_save_best(spark, sf):
    """All models, each pipeline written, read back and evaluated
    again; ``best`` marks the lowest RMSE, ``same`` that the read one agrees."""
    f, feats = feature_frame(spark, sf)
    fitted, m = ml.train_grid(f, feats, {24: LABEL}, list(ml.FACTORY), TREES)
    where = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    ml.save_models({n: x for (_, n), x in fitted.items()}, where)
    _, te = ml.vector_split(ml.vectors(f, feats, [LABEL]), LABEL)
    again = None
    for _, n in fitted:
        p = ml.load_model(f"{where}/{n}").transform(te).select(F.lit(n).alias("model"), F.col(ml.LABEL).alias("y"),
                                                               F.col(ml.PRED).alias("yhat"))
        again = p if again is None else again.unionByName(p)
    again = mx.evaluate(again, ["model"]).select("model", F.col("rmse").alias("read_rmse"))
    return m.join(again, "model").select(
        "model", "rmse", "mae", "r2", "n_nonzero", (F.abs(F.col("rmse") - F.col("read_rmse")) < 1e-9).alias("same"),
        (F.col("rmse") == F.min("rmse").over(Window.partitionBy())).alias("best"))


@q("ts_cv")
def ts_cv(spark, sf):
    f, feats = feature_frame(spark, sf)
    return ml.cv_folds(f, feats, LABEL, ["ridge", "random_forest", "gradient_boosting", "xgboost", "lightgbm"], 3, params=TREES)


@q("alpha_grid")
def alpha_grid(spark, sf):
    """M6, M7: the alpha grids of ridge and lasso on five contiguous folds."""
    f, feats = feature_frame(spark, sf)
    return ml.tune(f, feats, LABEL, {"ridge": [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0, 100.0)],
                                     "lasso": [{"alpha": a} for a in (0.001, 0.01, 0.1, 1.0)]}, 5, contiguous=True)


@q("tuning")
def tuning(spark, sf):
    f, feats = feature_frame(spark, sf)
    return ml.tune(f, feats, LABEL, {"ridge": [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0, 100.0)], **SPACE})


@q("stacking")
def stacking(spark, sf):
    f, feats = feature_frame(spark, sf)
    return ml.stack(f, feats, LABEL, ["random_forest", "gradient_boosting", "ridge"], KEY, params=TREES)


def _fitted_ridge(spark, sf):
    """Feature frame, feature names, vector frame, and the ridge pipeline over
    all complete rows."""
    f, feats = feature_frame(spark, sf)
    vec = ml.vectors(f, feats, [LABEL])
    d = vec.where(F.col(LABEL).isNotNull()).withColumn(ml.LABEL, F.col(LABEL))
    return f, feats, vec, _ridge_on(d, feats)


def _ridge_on(d, feats):
    stages, _ = ml.scaler(d, feats)
    return ml.fit("ridge", ml.PipelineModel(stages).transform(d), stages, ml.label_stats(d))


@q("score_latest")
def score_latest(spark, sf):
    f, feats, _, model = _fitted_ridge(spark, sf)
    return sc.score_latest(f, ml.whole(feats, model), feats, "ridge", concentration=True)


@q("forecast_3d")
def forecast_3d(spark, sf):
    return sc.forecast_days(score_latest(spark, sf), 3, seed=42)


@q("explain_top8")
def explain_top8(spark, sf):
    from hourcast.sources.store import latest_rows
    f, feats, _, model = _fitted_ridge(spark, sf)
    imp = ex.importance_frame(spark, ml.importances(model, feats))
    return ex.top_drivers(latest_rows(f, ["city"]), imp, ["city"], 8)


@q("shap_linear")
def shap_linear(spark, sf):
    f, feats, _, model = _fitted_ridge(spark, sf)
    names, weights = zip(*ml.raw_weights(model, feats))
    return ex.linear_shap(f.dropna(subset=feats), names, weights)


@q("permutation")
def permutation(spark, sf):
    """Every feature's RMSE increase."""
    _, feats, vec, model = _fitted_ridge(spark, sf)
    return ex.permutation_importance(vec, model, feats, LABEL, KEY)


@q("lime")
def lime(spark, sf):
    """The fitted model over all its features; 50 instances, 10 features of each."""
    _, feats, vec, model = _fitted_ridge(spark, sf)
    s = vec.select(ml.Summarizer.std(F.col(ml.RAW)).alias("s")).first()["s"]
    return ex.lime(ex.background_sample(vec, KEY, 50), model, feats, KEY, list(s))


@q("background_sample", f"""WITH {sg.obs_cte()}
SELECT * FROM obs ORDER BY md5(city || '|' || CAST(timestamp AS VARCHAR) || '|42'), city, timestamp LIMIT 100""")
def background_sample(spark, sf):
    return ex.background_sample(views.obs(spark, sf), KEY, 100)


# Ridge on two features: the closed form is SQL ------------------------------------
TWO = ["pm2_5", "temp"]
_TWO_SQL = f"""{sg.obs_cte()},
f AS (SELECT city, timestamp, pm2_5, temp, LEAD(pm2_5, 24) OVER (PARTITION BY city ORDER BY timestamp) AS y FROM obs),
t AS (SELECT * FROM f WHERE y IS NOT NULL AND pm2_5 IS NOT NULL AND temp IS NOT NULL),
m AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(pm2_5) AS m1, stddev_pop(pm2_5) AS s1, AVG(temp) AS m2, stddev_pop(temp) AS s2,
  AVG(y) AS my, corr(pm2_5, temp) AS r, covar_pop(pm2_5, y) / stddev_pop(pm2_5) AS c1, covar_pop(temp, y) / stddev_pop(temp) AS c2 FROM t),
b AS (SELECT *, n * ((n + 1) * c1 - n * r * c2) / ((n + 1) * (n + 1) - n * r * n * r) / s1 AS w1,
  n * ((n + 1) * c2 - n * r * c1) / ((n + 1) * (n + 1) - n * r * n * r) / s2 AS w2 FROM m)"""


def _few(spark, sf, names):
    o = views.obs(spark, sf)
    f = o.select(*KEY, *names, *fx.lead_columns(fx.Series().window(), "pm2_5", [24]))
    vec = ml.vectors(f, names, [LABEL])
    d = vec.where(F.col(LABEL).isNotNull()).withColumn(ml.LABEL, F.col(LABEL))
    return o, vec, _ridge_on(d, names)


def _two(spark, sf):
    return _few(spark, sf, TWO)


@q("ridge_closed_form", f"""WITH {_TWO_SQL}
SELECT city, timestamp, ROUND(my + w1 * (pm2_5 - m1) + w2 * (temp - m2), 4) AS predicted FROM obs, b""")
def ridge_closed_form(spark, sf):
    """A ridge pipeline is written, read back and applied."""
    o, _, model = _two(spark, sf)
    where = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    ml.save_models({"ridge": ml.whole(TWO, model)}, where)
    p = ml.load_model(f"{where}/ridge").transform(o.select(*KEY, *TWO))
    return p.select(*KEY, F.round(ml.PRED, 4).alias("predicted"))


# The same on three features: the normal equations of the scaled features by
# Cramer's rule, and lasso's optimality checked on every feature
THREE = ["pm2_5", "temp", "humidity"]
_D = "(1 + 1.0 / n)"
_DET = f"({_D} * ({_D} * {_D} - r23 * r23) - r12 * (r12 * {_D} - r23 * r13) + r13 * (r12 * r23 - {_D} * r13))"
_THREE_SQL = f"""{sg.obs_cte()},
f AS (SELECT city, timestamp, pm2_5, temp, humidity, LEAD(pm2_5, 24) OVER (PARTITION BY city ORDER BY timestamp) AS y FROM obs),
t AS (SELECT * FROM f WHERE y IS NOT NULL AND pm2_5 IS NOT NULL AND temp IS NOT NULL AND humidity IS NOT NULL),
m AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(y) AS my, AVG(pm2_5) AS m1, AVG(temp) AS m2, AVG(humidity) AS m3,
  stddev_pop(pm2_5) AS s1, stddev_pop(temp) AS s2, stddev_pop(humidity) AS s3,
  corr(pm2_5, temp) AS r12, corr(pm2_5, humidity) AS r13, corr(temp, humidity) AS r23,
  covar_pop(pm2_5, y) / stddev_pop(pm2_5) AS c1, covar_pop(temp, y) / stddev_pop(temp) AS c2,
  covar_pop(humidity, y) / stddev_pop(humidity) AS c3 FROM t),
b AS (SELECT *,
  (c1 * ({_D} * {_D} - r23 * r23) - r12 * (c2 * {_D} - r23 * c3) + r13 * (c2 * r23 - {_D} * c3)) / {_DET} / s1 AS w1,
  ({_D} * (c2 * {_D} - r23 * c3) - c1 * (r12 * {_D} - r23 * r13) + r13 * (r12 * c3 - c2 * r13)) / {_DET} / s2 AS w2,
  ({_D} * ({_D} * c3 - c2 * r23) - r12 * (r12 * c3 - c2 * r13) + c1 * (r12 * r23 - {_D} * r13)) / {_DET} / s3 AS w3 FROM m)"""


@q("ridge_three_features", f"""WITH {_THREE_SQL}
SELECT city, timestamp, ROUND(my + w1 * (pm2_5 - m1) + w2 * (temp - m2) + w3 * (humidity - m3), 4) AS predicted FROM obs, b""")
def ridge_three_features(spark, sf):
    """M5 on three features, from moments, as a pipeline over all observations."""
    o, _, model = _few(spark, sf, THREE)
    return ml.whole(THREE, model).transform(o.select(*KEY, *THREE)).select(*KEY, F.round(ml.PRED, 4).alias("predicted"))


@q("shap_closed_form", f"""WITH {_TWO_SQL}
SELECT feature, ROUND(v, 6) AS mean_abs_shap FROM (
  SELECT 'pm2_5' AS feature, AVG(ABS(w1 * (pm2_5 - o1))) AS v FROM obs, b, (SELECT AVG(pm2_5) AS o1 FROM obs) GROUP BY 1
  UNION ALL SELECT 'temp', AVG(ABS(w2 * (temp - o2))) FROM obs, b, (SELECT AVG(temp) AS o2 FROM obs))""")
def shap_closed_form(spark, sf):
    o, _, model = _two(spark, sf)
    names, weights = zip(*ml.raw_weights(model, TWO))
    return ex.linear_shap(o, names, weights).select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


@q("permutation_closed_form", f"""WITH {_TWO_SQL},
h AS (SELECT *, row_number() OVER (ORDER BY md5(city || '|' || CAST(timestamp AS VARCHAR) || '|42'), city, timestamp) - 1 AS i,
  COUNT(*) OVER () AS c FROM t),
d AS (SELECT h.y, h.pm2_5 AS x1, h.temp AS x2, z.pm2_5 AS z1, z.temp AS z2 FROM h JOIN h z ON h.i = (z.i + 1) % z.c),
e AS (SELECT SQRT(AVG((y - my - w1 * (x1 - m1) - w2 * (x2 - m2)) ** 2)) AS e0,
  SQRT(AVG((y - my - w1 * (z1 - m1) - w2 * (x2 - m2)) ** 2)) AS e1,
  SQRT(AVG((y - my - w1 * (x1 - m1) - w2 * (z2 - m2)) ** 2)) AS e2 FROM d, b)
SELECT 'pm2_5' AS feature, ROUND(e1 - e0, 6) AS rmse_increase FROM e UNION ALL SELECT 'temp', ROUND(e2 - e0, 6) FROM e""")
def permutation_closed_form(spark, sf):
    _, vec, model = _two(spark, sf)
    return ex.permutation_importance(vec, model, TWO, LABEL, KEY).select("feature", F.round("rmse_increase", 6).alias("rmse_increase"))
