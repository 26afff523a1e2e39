"""Micro-batch job (R1, R3, R4, R6): events land in three files, out of time
order, one file per batch; the stored features and the accuracy history must
equal the batch computation over all events."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hourcast.operators import features as fx
from hourcast.operators import metrics as mx
from hourcast.plans.q_metrics import LOG_MODELS
from hourcast.sources import views
from hourcast.streaming import jobs
from tests.conftest import SF_SMALL


def _land_out_of_order(src, land):
    t = pq.read_table(src)
    df = t.to_pandas().sort_values("ts")
    n = len(df)
    parts = [df.iloc[: n // 3], df.iloc[n // 3: 2 * n // 3], df.iloc[2 * n // 3:]]
    os.makedirs(land)
    for i, idx in enumerate([1, 2, 0]):                 # the first third arrives last (late data)
        path = os.path.join(land, f"part{i}.parquet")
        pq.write_table(pa.Table.from_pandas(parts[idx], schema=t.schema, preserve_index=False), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _run(spark, tmpdir_path):
    src = f"{SF_SMALL}/events.parquet"
    land = os.path.join(tmpdir_path, "landing")
    _land_out_of_order(src, land)
    job = jobs.FeatureStreamJob(spark, os.path.join(tmpdir_path, "job"), monitor_models=LOG_MODELS)
    job.run(jobs.file_stream(spark, land, max_files=1))
    return job, views.hourly_from_events(spark.read.parquet(src))


def test_stream_accuracy_with_late_batches(spark, tmpdir_path):
    job, obs = _run(spark, tmpdir_path)
    cols = ["city", "target_date", "model_used", "predicted", "actual"]
    exp = mx.accuracy_history(mx.daily_predictions(mx.next_day_log(obs, LOG_MODELS)),
                              mx.daily_actuals(obs, "pm2_5")).select(*cols)
    assert _rows(job.monitor.read("accuracy").select(*cols)) == _rows(exp)


def test_stream_features_with_late_batches(spark, tmpdir_path):
    job, obs = _run(spark, tmpdir_path)
    feats = fx.features_b(obs, decimals=0)
    got = job.store.read("features").select(*feats.columns)
    trig = [c for c in feats.columns if c.endswith("_sin") or c.endswith("_cos")]
    r9 = lambda d: d.select(*[F.round(c, 9).alias(c) if c in trig else F.col(c) for c in d.columns])
    assert _rows(r9(got)) == _rows(r9(feats))


def test_replayed_batch_changes_nothing(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    job = jobs.FeatureStreamJob(spark, os.path.join(tmpdir_path, "job"))
    state = []
    for _ in range(2):
        job.process(ev, 0)
        state.append((spark.read.parquet(job.partials).count(), job.alert_store.read("alerts").count(),
                      _rows(job.store.read("obs").select("city", "timestamp", "n"))))
    assert state[0] == state[1]


def test_alerts_are_one_row_a_day_over_all_batches(spark, tmpdir_path):
    """A day that arrives in several batches has one alert, of the day's maximum."""
    job, obs = _run(spark, tmpdir_path)
    cut = obs.groupBy("city", F.to_date("timestamp").alias("day")).agg(F.max("pm10").alias("m")).where("m > 150")
    want = sorted((r.city, r.day, r.m, "ALERT" if r.m > 200 else "WARNING") for r in cut.collect())
    got = job.alert_store.read("alerts").select("city", "day", "max_value", "level")
    assert sorted(map(tuple, got.collect())) == want


def test_batches_of_one_hour_merge_without_reading_events_again(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    job = jobs.FeatureStreamJob(spark, os.path.join(tmpdir_path, "job"))
    size = []
    for i in range(3):
        job.process(ev.where(F.col("event_id") % 3 == i), i)
        size.append(spark.read.parquet(job.partials).count())
    assert _rows(job.store.read("obs")) == _rows(views.hourly_from_events(ev).select(*job.store.read("obs").columns))
    hours = views.hourly_from_events(ev).count()
    assert size[-1] <= 3 * hours  # rows of hours, whatever the events in them
    before = _rows(job.store.read("features"))
    job.process(ev.where(F.col("event_id") % 3 == 1), 1)  # a replay
    assert _rows(job.store.read("features")) == before and spark.read.parquet(job.partials).count() == size[-1]
