"""Streaming queries (R1-R8): each drains a file-source stream over the
driver's events table to completion (availableNow) and returns the sink
table as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators import features as fx
from hourcast.plans import sqlgen as sg
from hourcast.plans.q_features import _full_b_sql
from hourcast.plans.q_metrics import _LOG_SQL
from hourcast.sources import views
from hourcast.streaming import jobs, trailing

QUERIES: dict = {}
ORACLE: dict = {}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@q("stream_window", """SELECT event_type AS city, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
  time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, COUNT(*) AS n,
  MAX(value) AS max_value, MIN(value) AS min_value FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_window(spark, sf):
    def go(d):
        jobs.run_to_table(jobs.hourly_window_stream(jobs.file_stream(spark, sf, "events.parquet")), f"{d}/out")
        return spark.read.parquet(f"{d}/out")
    return jobs.with_scratch(spark, go)


@q("stream_hourly_upsert", _full_b_sql())
def stream_hourly_upsert(spark, sf):
    """The feature table built by the micro-batch job equals the
    batch preset-B features over the whole observation frame."""
    def go(d):
        job = jobs.FeatureStreamJob(spark, d)
        job.run(jobs.file_stream(spark, sf, "events.parquet"))
        f = job.store.read("features")
        trig = ("_sin", "_cos")
        return f.select(*[F.round(c, 9).alias(c) if any(t in c for t in trig) else F.col(c) for c in f.columns])
    return jobs.with_scratch(spark, go)


@q("stream_alerts", f"""WITH {sg.obs_cte()}
SELECT city, strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day, MAX(pm10) AS max_value,
  CASE WHEN MAX(pm10) > 200 THEN 'ALERT' ELSE 'WARNING' END AS level FROM obs GROUP BY 1, 2 HAVING MAX(pm10) > 150""")
def stream_alerts(spark, sf):
    def go(d):
        job = jobs.FeatureStreamJob(spark, d)
        job.run(jobs.file_stream(spark, sf, "events.parquet"))
        return job.alert_store.read("alerts").select("city", F.date_format("day", "yyyy-MM-dd").alias("day"),
                                                     "max_value", "level")
    return jobs.with_scratch(spark, go)


@q("stream_accuracy", f"WITH {_LOG_SQL} SELECT city, strftime(target_date, '%Y-%m-%d') AS target_date, "
   "model_used, predicted, actual FROM h")
def stream_accuracy(spark, sf):
    """The accuracy history kept current by the micro-batch job equals
    the batch accuracy history over the whole observation frame."""
    from hourcast.plans.q_metrics import LOG_MODELS

    def go(d):
        job = jobs.FeatureStreamJob(spark, d, monitor_models=LOG_MODELS)
        job.run(jobs.file_stream(spark, sf, "events.parquet"))
        h = job.monitor.read("accuracy")
        return h.select("city", F.date_format("target_date", "yyyy-MM-dd").alias("target_date"),
                        "model_used", "predicted", "actual")
    return jobs.with_scratch(spark, go)


_T = trailing.Trailing()
_W = "PARTITION BY city ORDER BY timestamp"
_TRAIL = [f"LAG(pm2_5, {k}) OVER ({_W}) AS pm2_5_lag_{k}h" for k in _T.lags] + [
    f"CASE WHEN COUNT(pm2_5) OVER ({_W} ROWS {w - 1} PRECEDING) >= {w} THEN ROUND({f}(pm2_5) OVER ({_W} ROWS {w - 1} PRECEDING), 6) END "
    f"AS pm2_5_rolling_{s}_{w}h" for w in _T.windows for s, f in (("mean", "AVG"), ("min", "MIN"), ("max", "MAX"))]


@q("stream_trailing", f"""WITH {sg.obs_cte()}, f AS (SELECT city, timestamp, pm2_5, {', '.join(_TRAIL)} FROM obs)
SELECT * FROM f WHERE timestamp <= (SELECT MAX(timestamp) FROM obs) - INTERVAL 6 HOUR""")
def stream_trailing(spark, sf):
    """Features from per-city state, for every hour that the watermark has passed."""
    def go(d):
        hours = views.obs(spark, sf).select("city", "timestamp", "pm2_5")
        hours.write.parquet(f"{d}/hours")
        stream = spark.readStream.schema(hours.schema).parquet(f"{d}/hours")
        jobs.run_to_table(trailing.trailing_features(stream, "pm2_5", _T, "6 hours"), f"{d}/out")
        out = spark.read.parquet(f"{d}/out").drop("buffered")
        return out.select(*[F.round(c, 6).alias(c) if "rolling" in c else F.col(c) for c in out.columns])
    return jobs.with_scratch(spark, go)
