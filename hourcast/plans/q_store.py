"""Store, registry and progress queries (P16-P17, P19, S17-S18, T3, J5, J7,
A26) with their oracle SQL. The ``*_roundtrip`` queries write under the shared
checkpoint folder and return what they read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourcast.operators import align as al
from hourcast.operators import clean as cl
from hourcast.operators import metrics as mx
from hourcast.plans import sqlgen as sg
from hourcast.plans.q_metrics import _LOG_SQL, history_df
from hourcast.session import checkpoint_dir, cut_lineage
from hourcast.sources import store as st
from hourcast.sources import views

QUERIES: dict = {}
ORACLE: dict = {}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_FOLDED = ["pm2_5", "pm10", "temp", "humidity", "wind_speed", "wind_deg", "pressure", "clouds", "visibility"]


@q("fold_unfold_map", f"""WITH {sg.obs_cte()}
SELECT city, timestamp, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS ts_text, 9 AS n_features,
  {', '.join(_FOLDED)} FROM obs""")
def fold_unfold_map(spark, sf):
    from hourcast.functions.time import iso_text
    o = views.obs(spark, sf).select("city", "timestamp", *_FOLDED)
    folded = cl.fold_map(o, ["city", "timestamp"])                     # P16
    counted = folded.withColumn("n_features", F.size("features"))
    back = cl.unfold_map(counted, _FOLDED)                             # P17
    return back.select("city", "timestamp", iso_text(F.col("timestamp")).alias("ts_text"), "n_features", *_FOLDED)   # P15


@q("latest_row", f"""WITH {sg.obs_cte()}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM obs)
WHERE rn = 1""")
def latest_row(spark, sf):
    o = views.obs(spark, sf)
    return st.latest_rows(o).select(*o.columns)


def registry_df(spark, sf):
    """Registry rows derived from the prediction log: one version per model
    and target day, metrics of that day's forecasts against the actuals."""
    h = history_df(spark, sf)
    e = F.col("predicted") - F.col("actual")
    g = h.groupBy(F.col("model_used").alias("model_name"), "target_date").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"))
    return g.select("model_name",
                    F.concat(F.date_format("target_date", "yyyyMMdd"), F.lit("_000000")).alias("version"),
                    F.create_map(F.lit("mae"), F.col("mae"), F.lit("rmse"), F.col("rmse"),
                                 F.lit("n"), F.col("n").cast("double")).alias("metrics"))


_REG_SQL = f"""{_LOG_SQL},
reg AS (SELECT model_used AS model_name, strftime(target_date, '%Y%m%d') || '_000000' AS version,
          AVG(ABS(predicted - actual)) AS mae, SQRT(AVG((predicted - actual) * (predicted - actual))) AS rmse
        FROM h GROUP BY model_used, target_date),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS rn
           FROM reg WHERE mae IS NOT NULL) WHERE rn = 1)"""


@q("registry_latest", f"""WITH {_REG_SQL}
SELECT model_name, version, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse FROM latest""")
def registry_latest(spark, sf):
    """Newest version per model that has been scored against actuals."""
    newest = st.latest_versions(registry_df(spark, sf).where(F.col("metrics")["mae"].isNotNull()))
    return newest.select("model_name", "version", F.round(F.col("metrics")["mae"], 6).alias("mae"),
                       F.round(F.col("metrics")["rmse"], 6).alias("rmse"))


@q("leaderboard", f"""WITH {_REG_SQL},
acc AS (SELECT model_used AS model_name,
  CASE WHEN AVG(CASE WHEN actual > 0 THEN ABS(predicted - actual) / actual END) IS NOT NULL
    THEN GREATEST(0.0, 100.0 - 100.0 * AVG(CASE WHEN actual > 0 THEN ABS(predicted - actual) / actual END)) END AS accuracy
  FROM h GROUP BY model_used)
SELECT p.model_name, p.version, ROUND(p.mae, 6) AS mae, ROUND(acc.accuracy, 6) AS accuracy
FROM latest p LEFT JOIN acc ON p.model_name = acc.model_name""")
def leaderboard(spark, sf):
    reg = registry_latest(spark, sf)
    acc = mx.accuracy_score(history_df(spark, sf), by=["model_used"]).select(
        F.col("model_used").alias("model_name"), F.round("accuracy", 6).alias("accuracy"))
    return reg.join(acc, "model_name", "left").select("model_name", "version", "mae", "accuracy")


@q("registry_documents", f"""WITH {_REG_SQL}
SELECT model_name, version, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse FROM reg WHERE mae IS NOT NULL""")
def registry_documents(spark, sf):
    """A document per model and version is written and scanned."""
    where = _folder(spark, "registry")
    st.write_registry(registry_df(spark, sf).where(F.col("metrics")["mae"].isNotNull()), where)
    got = st.read_registry(spark, f"{where}/models/*/*/*.json")
    return got.select("model_name", "version", F.round(F.col("metrics")["mae"], 6).alias("mae"),
                      F.round(F.col("metrics")["rmse"], 6).alias("rmse"))


@q("compare_models", f"""WITH {_REG_SQL},
acc AS (SELECT model_used AS model_name,
  GREATEST(0.0, 100.0 - 100.0 * AVG(CASE WHEN actual > 0 THEN ABS(predicted - actual) / actual END)) AS accuracy
  FROM h GROUP BY model_used HAVING COUNT(CASE WHEN actual > 0 THEN 1 END) > 0),
newest AS (SELECT city, model_used, MAX(target_date) AS target_date FROM pd GROUP BY city, model_used),
fc AS (SELECT city, model_used, target_date, predicted FROM pd JOIN newest USING (city, model_used, target_date))
SELECT fc.city, fc.model_used AS model_name, strftime(fc.target_date, '%Y-%m-%d') AS target_date, ROUND(fc.predicted, 6) AS forecast,
  p.version, ROUND(p.mae, 6) AS mae, ROUND(acc.accuracy, 6) AS accuracy
FROM fc LEFT JOIN latest p ON p.model_name = fc.model_used LEFT JOIN acc ON acc.model_name = fc.model_used""")
def compare_models(spark, sf):
    """Every city's newest forecast of each model, beside the model's
    newest scored version and its accuracy so far."""
    h = history_df(spark, sf)
    fc = h.groupBy("city", F.col("model_used").alias("model_name")).agg(F.max(F.struct("target_date", "predicted")).alias("f"))
    fc = fc.select("city", "model_name", F.date_format("f.target_date", "yyyy-MM-dd").alias("target_date"),
                   F.round("f.predicted", 6).alias("forecast"))
    reg = registry_latest(spark, sf).select("model_name", "version", "mae")
    acc = mx.accuracy_score(h, by=["model_used"]).select(F.col("model_used").alias("model_name"), F.round("accuracy", 6).alias("accuracy"))
    return fc.join(reg, "model_name", "left").join(acc, "model_name", "left") \
        .select("city", "model_name", "target_date", "forecast", "version", "mae", "accuracy")


@q("days_of_texts", f"""WITH {sg.obs_cte()}
SELECT city, strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS records FROM obs GROUP BY 1, 2""")
def days_of_texts(spark, sf):
    """Timestamps as ISO texts, grouped by the day in the text."""
    from hourcast.functions.time import day_key, iso_text
    o = views.obs(spark, sf).select("city", day_key(iso_text(F.col("timestamp"))).alias("day"))
    return o.groupBy("city", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("records"))


@q("finite_ratios", f"""WITH {sg.obs_cte()}
SELECT city, timestamp, ROUND(CASE WHEN clouds <> 0 THEN pm2_5 / clouds END, 9) AS per_cloud,
  ROUND(CASE WHEN temp > 0 THEN ln(temp) END, 9) AS log_temp FROM obs""")
def finite_ratios(spark, sf):
    """What floating division and logarithms leave as infinite or not a
    number becomes NULL."""
    o = views.obs(spark, sf)
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    raw = o.select("city", "timestamp", F.when(F.col("clouds") != 0, F.col("pm2_5") / F.col("clouds")).otherwise(
        F.when(F.col("pm2_5") == 0, nan).otherwise(inf)).alias("per_cloud"),
        F.when(F.col("temp") > 0, F.ln("temp")).otherwise(F.when(F.col("temp") == 0, -inf).otherwise(nan)).alias("log_temp"))
    return raw.select("city", "timestamp", cl.finite("per_cloud"), cl.finite("log_temp")) \
        .select("city", "timestamp", *[F.round(c, 9).alias(c) for c in ("per_cloud", "log_temp")])


# J5 / A26 -------------------------------------------------------------------------
_DAYS_SQL = f"""{sg.obs_cte()},
span AS (SELECT MIN(CAST(timestamp AS DATE)) AS lo, MAX(CAST(timestamp AS DATE)) + 1 AS hi FROM obs),
wanted AS (SELECT DISTINCT city, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM obs, span),
done AS (SELECT city, CAST(timestamp AS DATE) AS day, COUNT(*) AS records FROM obs GROUP BY 1, 2)"""


def _done_days(spark, sf):
    """Every processed day of every city, however few its records."""
    return views.obs(spark, sf).groupBy("city", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("records"))


@q("resume_anti", f"""WITH {_DAYS_SQL}
SELECT city, strftime(day, '%Y-%m-%d') AS day FROM wanted ANTI JOIN done USING (city, day)""")
def resume_anti(spark, sf):
    """Days from the first to the day after the last that a city still lacks."""
    o = views.obs(spark, sf).select("city", F.to_date("timestamp").alias("day"))
    span = o.agg(F.min("day").alias("lo"), F.date_add(F.max("day"), 1).alias("hi"))  # one row
    wanted = o.select("city").distinct().join(F.broadcast(span)).select(
        "city", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))
    r = al.resume_days(wanted, _done_days(spark, sf))
    return r.select("city", F.date_format("day", "yyyy-MM-dd").alias("day"))


@q("progress", f"""WITH {_DAYS_SQL}
SELECT city, SUM(records) AS total_records, COUNT(DISTINCT day) AS days_completed,
  strftime(MAX(day), '%Y-%m-%d') AS last_date FROM done GROUP BY city""")
def progress(spark, sf):
    p = al.progress(_done_days(spark, sf))
    return p.select("city", F.col("total_records").cast("long").alias("total_records"), "days_completed",
                    F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


@q("progress_reset", f"""WITH {_DAYS_SQL}
SELECT city, SUM(records) AS total_records, COUNT(DISTINCT day) AS days_completed, strftime(MAX(day), '%Y-%m-%d') AS last_date
FROM done WHERE city <> (SELECT MIN(city) FROM done) GROUP BY city""")
def progress_reset(spark, sf):
    """R2: progress is recorded twice (a resumed job), and one city reset."""
    log = st.ProgressLog(spark, _folder(spark, "progress"))
    done = _done_days(spark, sf)
    log.record(done)
    log.record(done)
    first = done.agg(F.min("city")).first()[0]
    if first is not None:
        log.reset(first)
    p = al.progress(log.done())
    return p.select("city", F.col("total_records").cast("long").alias("total_records"), "days_completed",
                    F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


# S19 / S20 / T5 --------------------------------------------------------------------
def _fg_sql():
    from hourcast.plans.q_features import ORACLE as FO
    return (f"fa AS ({FO['features_full_a']}), "
            "fg AS (SELECT * FROM fa WHERE COLUMNS(*) IS NOT NULL)")


def _selectable():
    """Preset-A feature columns (rule a) minus the row count and the raw index."""
    from types import SimpleNamespace

    from hourcast.operators.features import feature_columns
    from hourcast.plans.q_features import full_a_names
    return [c for c in feature_columns(SimpleNamespace(columns=full_a_names()), "a") if c not in ("n", "aqi")]


def feature_group_df(spark, sf):
    from hourcast.plans.q_features import features_full_a
    return st.feature_group_rows(features_full_a(spark, sf))


def _complete_rows(spark, sf):
    """The complete rows of preset A. The wide frame is written before its
    filter: the optimizer rewrites a filter on 190 aliases once per set of them."""
    from hourcast.plans.q_features import features_full_a
    return cl.drop_incomplete(cut_lineage(features_full_a(spark, sf)))


_SEASONS = ["season_winter", "season_spring", "season_summer", "season_fall"]


@q("feature_group_load", f"""WITH {_fg_sql()}
SELECT CAST(row_number() OVER (ORDER BY timestamp, city) - 1 AS BIGINT) AS observation_id, timestamp AS event_time,
  * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _SEASONS)})
FROM fg""")
def feature_group_load(spark, sf):
    return feature_group_df(spark, sf)


@q("feature_select_top50", f"""WITH {_fg_sql()},
c AS (SELECT ROUND(CORR(CAST(COLUMNS({'[' + ', '.join(repr(c) for c in _selectable()) + ']'}) AS DOUBLE), target_24h), 6) FROM fg),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME feature VALUE corr),
r AS (SELECT feature, corr, row_number() OVER (ORDER BY ABS(corr) DESC, feature) AS rank
      FROM u WHERE corr IS NOT NULL AND NOT isnan(corr))
SELECT feature, corr, rank FROM r WHERE rank <= 50""")
def feature_select_top50(spark, sf):
    """S20 view of the feature group with ``target_24h`` as label; T5 keeps
    the 50 features most correlated with it."""
    from hourcast.operators import quality as qa
    return qa.top_by_corr(_complete_rows(spark, sf), "target_24h", _selectable(), 50)


_LABELS = [f"target_{h}h" for h in (1, 6, 12, 24, 48, 72)]


@q("feature_view_split", f"""WITH {_fg_sql()}
SELECT city, timestamp, {', '.join(_selectable())}, {', '.join(_LABELS)},
  CASE WHEN row_number() OVER (ORDER BY timestamp, city) <= CAST(FLOOR(COUNT(*) OVER () * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM fg""")
def feature_view_split(spark, sf):
    """The view of all features and labels, and its train and test parts."""
    view = st.feature_view(_complete_rows(spark, sf), _selectable(), _LABELS)
    train, test = st.train_test(view)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


# P18 / P26 -------------------------------------------------------------------------
@q("lookback_7d", f"""WITH {sg.obs_cte()},
m AS (SELECT city, MAX(timestamp) AS newest FROM obs GROUP BY city)
SELECT obs.* FROM obs JOIN m USING (city) WHERE obs.timestamp >= m.newest - INTERVAL 7 DAY""")
def lookback_7d(spark, sf):
    return st.lookback_rows(views.obs(spark, sf), 7)


# P26 allow-list: the models the serving tier lists (the log's second model is not on it)
ALLOWED_MODELS = ["persistence", "moving_average", "ridge", "lasso", "elastic_net", "random_forest",
                  "gradient_boosting", "xgboost", "lightgbm"]


@q("models_listing", f"""WITH {_REG_SQL}
SELECT model_name, version, row_number() OVER (PARTITION BY model_name ORDER BY version DESC) AS recency
FROM reg WHERE model_name IN ({', '.join(repr(m) for m in ALLOWED_MODELS)})""")
def models_listing(spark, sf):
    return st.list_models(registry_df(spark, sf), ALLOWED_MODELS)


# Round trips -----------------------------------------------------------------------
def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@q("store_upsert_roundtrip", """WITH e AS (SELECT event_type AS city, date_trunc('hour', ts) AS timestamp, event_id, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY city, timestamp ORDER BY event_id % 2 DESC, event_id DESC) AS rn FROM e)
SELECT city, timestamp, event_id, value FROM r
WHERE rn = 1 AND timestamp >= (SELECT MIN(timestamp) + INTERVAL 1 DAY FROM e)""")
def store_upsert_roundtrip(spark, sf):
    """Readings with many rows per (hour, city) arrive in two loads;
    the later load wins, and within a load the later arrival. Read from the
    second day on."""
    from hourcast.functions.time import hour_bucket
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("city"), hour_bucket(F.col("ts")).alias("timestamp"),
                                                "event_id", "value")
    store = st.FeatureStore(spark, _folder(spark, "store"))
    for parity in (0, 1):
        store.upsert(e.where(F.col("event_id") % 2 == parity), "readings", arrival="event_id")
    got = store.read("readings")
    first = got.agg(F.min("timestamp")).first()[0]
    return store.read("readings") if first is None else got.where(
        F.col("timestamp") >= F.lit(str(first)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))


@q("csv_roundtrip", f"""WITH {sg.obs_cte()} SELECT * FROM obs""")
def csv_roundtrip(spark, sf):
    """S14 then S8, behind the ordered fallback S9: the first candidate is missing."""
    o = views.obs(spark, sf)
    where = _folder(spark, "csv")
    st.write_csv(o, where)
    return st.first_nonempty([lambda: st.read_csv(spark, f"{where}-absent", o.schema),
                              lambda: st.read_csv(spark, where, o.schema)])


@q("prediction_log_roundtrip", f"""WITH {sg.obs_cte()},
d AS (SELECT city, CAST(timestamp AS DATE) AS target_date, CAST(MAX(aqi) AS DOUBLE) AS predicted_aqi FROM obs GROUP BY 1, 2)
SELECT city, strftime(target_date, '%Y-%m-%d') AS target_date, predicted_aqi, m AS model_used
FROM d, (VALUES ('persistence'), ('ridge')) t(m)""")
def prediction_log_roundtrip(spark, sf):
    """Two appends to the log."""
    d = views.obs(spark, sf).groupBy("city", F.to_date("timestamp").alias("target_date")).agg(F.max("aqi").alias("predicted_aqi"))
    where = _folder(spark, "log")
    for model in ("persistence", "ridge"):
        st.append_predictions(d.withColumn("model_used", F.lit(model)), where)
    return spark.read.schema(st.PREDICTION_LOG).parquet(where).withColumn("target_date", F.date_format("target_date", "yyyy-MM-dd"))


@q("outlook_json_roundtrip", f"""WITH {sg.obs_cte()},
l AS (SELECT city, MAX(timestamp) AS timestamp, CAST(arg_max(aqi, timestamp) AS DOUBLE) AS aqi FROM obs GROUP BY city)
SELECT city, aqi AS now_aqi, CAST(d AS BIGINT) AS day, strftime(CAST(timestamp AS DATE) + CAST(d AS INTEGER), '%Y-%m-%d') AS date,
  aqi AS predicted_aqi FROM l, generate_series(1, 3) t(d)""")
def outlook_json_roundtrip(spark, sf):
    """One nested document per city, written as JSON and unfolded again."""
    from hourcast.ml import score as sc
    now = st.latest_rows(views.obs(spark, sf)).select(
        "city", "timestamp", F.col("aqi").cast("double").alias("predicted_aqi_24h"), F.lit("persistence").alias("model_used"))
    where = _folder(spark, "json")
    st.write_nested_json(sc.outlook_document(now, sc.forecast_days(now, 3, seed=None)), where)
    back = spark.read.json(where)
    return back.select("city", F.col("current_prediction.predicted_aqi_24h").alias("now_aqi"), F.explode("forecasts").alias("f")) \
        .select("city", "now_aqi", "f.day", "f.date", "f.predicted_aqi")
