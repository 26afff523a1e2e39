"""Split, baseline-forecast, metric and monitoring queries (M2-M4, W13-W15,
W17, A1-A12, A25, A28, J4, J6) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions.scalars import alert_level
from hourcast.operators import features as fx
from hourcast.operators import metrics as mx
from hourcast.operators import split as sp
from hourcast.plans import sqlgen as sg
from hourcast.sources import views

QUERIES: dict = {}
ORACLE: dict = {}
HORIZONS = fx.PresetA().horizons
W = sg.win()
MODELS = {"persistence": "pm2_5", "moving_average": "pm2_5_rolling_mean_24h"}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6).alias(c)


# M2 / W15 ------------------------------------------------------------------------
@q("split_chrono", f"""WITH {sg.obs_cte()},
p AS (SELECT city, timestamp, row_number() OVER (ORDER BY timestamp, city) AS rn, COUNT(*) OVER () AS n FROM obs)
SELECT city, timestamp, CASE WHEN rn <= CAST(FLOOR(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM p""")
def split_chrono(spark, sf):
    return sp.chrono_split(views.obs(spark, sf).select("city", "timestamp"))


@q("ts_folds", f"""WITH {sg.obs_cte()},
p AS (SELECT city, timestamp, row_number() OVER (ORDER BY timestamp, city) - 1 AS pos, COUNT(*) OVER () AS n FROM obs)
SELECT city, timestamp, CAST(CASE WHEN pos < n - 3 * (n // 4) THEN -1 WHEN pos < n - 2 * (n // 4) THEN 0
  WHEN pos < n - (n // 4) THEN 1 ELSE 2 END AS INTEGER) AS test_fold FROM p""")
def ts_folds(spark, sf):
    return sp.ts_folds(views.obs(spark, sf).select("city", "timestamp"), 3)


# W13 -------------------------------------------------------------------------
@q("sequences", f"""WITH {sg.obs_cte()},
s AS (SELECT city, timestamp,
  list(pm2_5) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS seq_pm2_5,
  list(humidity) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS seq_humidity,
  pm2_5 AS label FROM obs)
SELECT * FROM s WHERE len(seq_pm2_5) = 6""")
def sequences(spark, sf):
    s = sp.sequences(views.obs(spark, sf), ["pm2_5", "humidity"], "pm2_5", 6)
    return s.select("city", "timestamp",
                    F.transform("sequence", lambda x: x["pm2_5"]).alias("seq_pm2_5"),
                    F.transform("sequence", lambda x: x["humidity"]).alias("seq_humidity"), "label")


# M3/M4 + A9: the flagship ------------------------------------------------------
def baseline_frame(spark, sf):
    """Observations with the moving-average baseline and the forward targets."""
    o = views.obs(spark, sf)
    s = fx.Series()
    return fx.with_rolling(o, s, ["pm2_5"], [24], ["mean"], 1, 2, keep=["city", "timestamp", "pm2_5"],
                           extra=fx.lead_columns(s.window(), "pm2_5", HORIZONS))


def _baseline_sql_frame():
    leads = ", ".join(f"{sg.lead('pm2_5', h, W)} AS target_{h}h" for h in HORIZONS)
    lp = " UNION ALL ".join(
        f"SELECT {h} AS horizon, '{m}' AS model, target_{h}h AS y, {c} AS yhat FROM test"
        for h in HORIZONS for m, c in [("persistence", "pm2_5"), ("moving_average", "ma")])
    return f"""WITH {sg.obs_cte()},
f AS (SELECT city, timestamp, pm2_5, {sg.rolling('pm2_5', 24, 'mean', W, 1, 2)} AS ma, {leads} FROM obs),
s AS (SELECT *, row_number() OVER (ORDER BY timestamp, city) AS rn, COUNT(*) OVER () AS n FROM f),
test AS (SELECT * FROM s WHERE rn > CAST(FLOOR(n * 0.8) AS BIGINT)),
lp AS ({lp}),
m AS (SELECT horizon, model, COUNT(*) AS n,
  ROUND(SQRT(AVG((y - yhat) * (y - yhat))), 6) AS rmse,
  ROUND(AVG(ABS(y - yhat)), 6) AS mae,
  ROUND(1.0 - SUM((y - yhat) * (y - yhat)) / NULLIF(VAR_POP(y) * COUNT(*), 0), 6) AS r2,
  ROUND(AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100.0, 6) AS mape
  FROM lp WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY horizon, model)"""


def baseline_metrics_df(spark, sf):
    f = sp.chrono_split(baseline_frame(spark, sf))
    test = f.where(F.col("split") == "test")
    lp = mx.long_predictions(test, {h: f"target_{h}h" for h in HORIZONS}, MODELS)
    m = mx.evaluate(lp, ["horizon", "model"])
    return m.select("horizon", "model", "n", *[r6(c) for c in ("rmse", "mae", "r2", "mape")])


@q("baseline_metrics", _baseline_sql_frame() + " SELECT * FROM m")
def baseline_metrics(spark, sf):
    return baseline_metrics_df(spark, sf)


@q("epsilon_mape", _baseline_sql_frame() + """
SELECT horizon, model, COUNT(*) AS n, ROUND(AVG(ABS((y - yhat) / (y + 1e-8))) * 100.0, 4) AS mape
FROM lp WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY horizon, model""")
def epsilon_mape(spark, sf):
    """Percentage error with a small constant in the denominator, where
    zeros count too."""
    f = sp.chrono_split(baseline_frame(spark, sf))
    lp = mx.long_predictions(f.where(F.col("split") == "test"), {h: f"target_{h}h" for h in HORIZONS}, MODELS)
    return mx.evaluate(lp, ["horizon", "model"], mape="epsilon").select("horizon", "model", "n", F.round("mape", 4).alias("mape"))


@q("best_per_horizon", _baseline_sql_frame() + """,
r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY mae, model) AS k FROM m)
SELECT horizon, model AS best_model, mae FROM r WHERE k = 1""")
def best_per_horizon(spark, sf):
    b = mx.best_by(baseline_metrics_df(spark, sf), "mae", by=["horizon"])
    return b.select("horizon", F.col("model").alias("best_model"), "mae")


@q("mae_pivot", _baseline_sql_frame() + " SELECT model, "
   + ", ".join(f"ROUND(MAX(CASE WHEN horizon = {h} THEN mae END), 2) AS h{h}" for h in HORIZONS)
   + " FROM m GROUP BY model")
def mae_pivot(spark, sf):
    return mx.pivot_metric(baseline_metrics_df(spark, sf), "mae", "model", "horizon", HORIZONS)


@q("best_model", _baseline_sql_frame() + """
SELECT metric, model AS best_model, value FROM (
  SELECT metric, model, value, row_number() OVER (PARTITION BY metric ORDER BY
    CASE WHEN metric = 'r2' THEN -value ELSE value END, model) AS k
  FROM (SELECT model, 'rmse' AS metric, rmse AS value FROM m WHERE horizon = 24
        UNION ALL SELECT model, 'mae', mae FROM m WHERE horizon = 24
        UNION ALL SELECT model, 'r2', r2 FROM m WHERE horizon = 24
        UNION ALL SELECT model, 'mape', mape FROM m WHERE horizon = 24) u) t WHERE k = 1""")
def best_model(spark, sf):
    m = baseline_metrics_df(spark, sf).where(F.col("horizon") == 24)
    outs = []
    for metric in ("rmse", "mae", "r2", "mape"):
        b = mx.best_by(m, metric)
        outs.append(b.select(F.lit(metric).alias("metric"), F.col("model").alias("best_model"),
                             F.col(metric).alias("value")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


@q("model_rank", _baseline_sql_frame() + """
SELECT horizon, model, rmse, CAST(rank() OVER (PARTITION BY horizon ORDER BY rmse) AS INTEGER) AS rank FROM m""")
def model_rank(spark, sf):
    r = mx.rank_models(baseline_metrics_df(spark, sf), "rmse", by=["horizon"])
    return r.select("horizon", "model", "rmse", "rank")


# A1-A3, J4, A25, A28 --------------------------------------------------------------
def pred_log(spark, sf):
    """Prediction log derived from observations: at hour t the persistence
    model predicts pm2_5 and the 'hourly_max' model predicts pm10 for the next
    day (target date = date(t) + 1)."""
    return mx.next_day_log(views.obs(spark, sf), LOG_MODELS)


# the two next-day models of the derived prediction log: name -> predicted column
LOG_MODELS = {"persistence": "pm2_5", "hourly_max": "pm10"}


_LOG_SQL = f"""{sg.obs_cte()},
log AS (SELECT city, CAST(timestamp AS DATE) + 1 AS target_date, pm2_5 AS predicted_aqi, 'persistence' AS model_used FROM obs
        UNION ALL SELECT city, CAST(timestamp AS DATE) + 1, pm10, 'hourly_max' FROM obs),
pd AS (SELECT city, model_used, target_date,
         CAST(SUM(CAST(predicted_aqi AS DECIMAL(18,2))) AS DOUBLE) / COUNT(predicted_aqi) AS predicted
       FROM log WHERE predicted_aqi IS NOT NULL GROUP BY 1, 2, 3),
ad AS (SELECT city, CAST(timestamp AS DATE) AS target_date,
         CAST(SUM(CAST(pm2_5 AS DECIMAL(18,2))) AS DOUBLE) / COUNT(pm2_5) AS actual
       FROM obs WHERE pm2_5 IS NOT NULL GROUP BY 1, 2),
h AS (SELECT pd.city, pd.target_date, pd.model_used, pd.predicted, ad.actual
      FROM pd LEFT JOIN ad ON pd.city = ad.city AND pd.target_date = ad.target_date)"""


def history_df(spark, sf):
    pdl = mx.daily_predictions(pred_log(spark, sf))
    ad = mx.daily_actuals(views.obs(spark, sf), "pm2_5")
    return mx.accuracy_history(pdl, ad)


@q("accuracy_history", f"WITH {_LOG_SQL} SELECT city, strftime(target_date, '%Y-%m-%d') AS target_date, "
   "model_used, predicted, actual FROM h")
def accuracy_history(spark, sf):
    return history_df(spark, sf).select("city", F.date_format("target_date", "yyyy-MM-dd").alias("target_date"),
                                        "model_used", "predicted", "actual")


@q("accuracy_score", f"""WITH {_LOG_SQL}
SELECT city, model_used, COUNT(CASE WHEN actual > 0 THEN 1 END) AS days,
  ROUND(CASE WHEN AVG(CASE WHEN actual > 0 THEN ABS(predicted - actual) / actual END) IS NOT NULL
    THEN GREATEST(0.0, 100.0 - 100.0 * AVG(CASE WHEN actual > 0 THEN ABS(predicted - actual) / actual END)) END, 6)
    AS accuracy
FROM h GROUP BY city, model_used""")
def accuracy_score(spark, sf):
    s = mx.accuracy_score(history_df(spark, sf))
    return s.select("city", "model_used", "days", r6("accuracy"))


@q("alerts", f"""WITH {_LOG_SQL}
SELECT city, strftime(target_date, '%Y-%m-%d') AS target_date, MAX(predicted) AS max_forecast,
  CASE WHEN MAX(predicted) > 200 THEN 'ALERT' WHEN MAX(predicted) > 150 THEN 'WARNING' ELSE 'OK' END AS level
FROM pd GROUP BY city, target_date""")
def alerts(spark, sf):
    pdl = mx.daily_predictions(pred_log(spark, sf))
    g = pdl.groupBy("city", "target_date").agg(F.max("predicted").alias("max_forecast"))
    return g.select("city", F.date_format("target_date", "yyyy-MM-dd").alias("target_date"), "max_forecast",
                    alert_level("max_forecast").alias("level"))


def _cat_sql(x):
    return (f"CASE WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate' WHEN {x} <= 150 THEN "
            f"'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy' WHEN {x} <= 300 THEN "
            f"'Very Unhealthy' ELSE 'Hazardous' END")


@q("category_accuracy", f"""WITH {sg.obs_cte()},
p AS (SELECT aqi AS predicted, {sg.lead('aqi', 24, W)} AS actual FROM obs)
SELECT {_cat_sql('actual')} AS category, COUNT(*) AS n,
  ROUND(AVG(CAST({_cat_sql('actual')} = {_cat_sql('predicted')} AS INTEGER)), 6) AS accuracy
FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1""")
def category_accuracy(spark, sf):
    w = fx.Series().window()
    p = views.obs(spark, sf).select(F.col("aqi").alias("predicted"), F.lead("aqi", 24).over(w).alias("actual"))
    c = mx.category_accuracy(p, "actual", "predicted")
    return c.select("category", "n", r6("accuracy"))
