"""Structured Streaming jobs.

* R5 ``hourly_window_stream``: event-time hourly aggregates per city with a
  watermark (append mode: a window is emitted once the watermark passes it,
  later arrivals for it are dropped by Spark).
* R1/R3/R4/R7 ``FeatureStreamJob``: file-source micro-batches handled by
  ``foreachBatch``. A batch is reduced to mergeable aggregates per (city,
  hour), kept under its batch id; the hours it touched are the merged
  aggregates of all batches, so hours split across batches and late events are
  folded in and a replay, which overwrites its own aggregates, changes
  nothing. No raw event is read twice: what a batch reads grows with the hours
  it touches, not with the events of the day. Each city's trailing history
  comes from the feature store (row-based lags need >= 72 rows; window
  functions are not allowed on streams), features are computed, and the
  touched rows upserted (last write wins). Alerts are one row per city and
  day, from the stored hours of that day.
* R8 ``trailing_features`` (:mod:`hourcast.streaming.trailing`): the same lags
  and rolling statistics from per-city state instead of the store.

Events of one batch that share an id count once; the file source delivers a
file once, so ids are not compared across batches.

Progress is owned by the stream checkpoint (exactly-once file source +
idempotent sink), which replaces the reference's per-city JSON checkpoint
(R2).
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.scalars import alert_level
from hourcast.operators import features as fx
from hourcast.operators import metrics as mx
from hourcast.session import checkpoint_dir, cut_lineage
from hourcast.sources import views
from hourcast.sources.store import FeatureStore

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def file_stream(spark: SparkSession, directory: str, glob: str = "*.parquet", schema: T.StructType = EVENTS,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def hourly_window_stream(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Watermark needs TIMESTAMP (not NTZ): cast under the UTC session."""
    e = events.withColumn("ets", F.col("ts").cast("timestamp")).withWatermark("ets", delay)
    g = e.groupBy(F.window("ets", "1 hour").alias("w"), F.col("event_type").alias("city")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    return g.select("city", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "max_value", "min_value")


def run_to_table(df: DataFrame, out: str, mode: str = "append", ckpt: str | None = None) -> None:
    """Drain a streaming frame once (availableNow) into a Parquet table."""
    spark = df.sparkSession
    ck = ckpt or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


class FeatureStreamJob:
    """Events -> mergeable aggregates -> hourly observations -> preset-B features ->
    feature store (upsert) + alerts, one micro-batch at a time."""

    def __init__(self, spark: SparkSession, root: str, preset: fx.PresetB | None = None,
                 history_hours: int = 24 * 7, alert_col: str = "pm10", monitor_models: dict | None = None,
                 actual_col: str = "pm2_5"):
        self.spark, self.root = spark, root.rstrip("/")
        self.monitor_models, self.actual_col = monitor_models, actual_col
        self.monitor = FeatureStore(spark, f"{self.root}/monitor", keys=("city", "model_used", "target_date"),
                                    ts="target_date")
        self.preset = preset or fx.PresetB()
        self.history_hours = history_hours
        self.alert_col = alert_col
        self.store = FeatureStore(spark, f"{self.root}/store")
        self.partials = f"{self.root}/partials"
        self.alert_store = FeatureStore(spark, self.root, keys=("city", "day"), ts="day")

    def process(self, batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        part = views.hourly_partials(batch.dropDuplicates(["event_id"]))
        # a replayed batch overwrites what it wrote before; the aggregates of
        # other batches for the same hours are other partitions
        part.withColumn("date", F.to_date("timestamp")).withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("date", "epoch").parquet(self.partials)
        kept = spark.read.parquet(self.partials)
        mine = kept.where(F.col("epoch") == epoch_id)
        dates = [r[0] for r in mine.select("date").distinct().collect()]              # few per batch
        touched = mine.select("city", "timestamp").distinct()
        cells = kept.where(F.col("date").isin(dates)).drop("date", "epoch").join(touched, ["city", "timestamp"], "left_semi")
        hours = views.hourly_from_partials(views.merge_partials(cells))
        if hours.isEmpty():
            return
        frame = self.refresh_frame(hours, touched)
        feats = fx.features_b(frame, self.preset, decimals=0)
        # the history read above comes from the obs partitions the upsert below
        # replaces: cut the lineage first (reliable checkpoint), so later
        # actions and retries never re-read overwritten files
        new = cut_lineage(self.refresh_band(feats))
        hours = cut_lineage(hours)
        self.store.upsert(hours, "obs")                                               # R3 idempotent
        self.store.upsert(new, "features")
        self.update_alerts(touched, dates)                                            # R7
        if self.monitor_models:
            self.track_accuracy(dates)                                                # R6

    def update_alerts(self, touched: DataFrame, dates) -> None:
        """One row per city and day above the normal level, from all stored
        hours of the touched days; a later batch of the day replaces it."""
        days = touched.select("city", F.to_date("timestamp").alias("day")).distinct()
        top = self.store.frame("obs").where(F.col("date").isin(dates)) \
            .groupBy("city", F.col("date").alias("day")).agg(F.max(self.alert_col).alias("max_value")) \
            .join(days, ["city", "day"], "left_semi").withColumn("level", alert_level("max_value"))
        self.alert_store.upsert(cut_lineage(top.where(F.col("level") != "OK")), "alerts")

    def bounds(self) -> tuple[int, int]:
        """Rows a feature looks back (lags, rolling, changes) and ahead (targets)."""
        p = self.preset
        return max(max(p.lags), max(p.windows) - 1, max(p.periods)), max(p.horizons)

    def refresh_frame(self, hours: DataFrame, touched: DataFrame) -> DataFrame:
        """The stored rows of the touched cities around the new hours, plus the
        new hours (marked ``_new``). The date range doubles until every city
        has ``back + fwd`` rows before its first new hour and after its last
        one (band rows need ``back`` rows of history and ``fwd`` rows of
        future), or reaches the ends of the store, so the refresh band below
        is exact even for late data and sparse series."""
        import datetime as dt
        back, fwd = self.bounds()
        new = hours.withColumn("_new", F.lit(True))
        if not self.store.exists("obs"):
            return new
        rng = touched.groupBy("city").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
        lo, hi = rng.agg(F.min("_first"), F.max("_last")).first()
        stored = self.store.frame("obs").join(rng.select("city"), "city", "left_semi")
        smin, smax = stored.agg(F.min("date"), F.max("date")).first()
        days = max(1, self.history_hours // 24)
        while True:
            a, b = lo.date() - dt.timedelta(days=days), hi.date() + dt.timedelta(days=days)
            hist = (stored.where(F.col("date").between(F.lit(a), F.lit(b))).drop("date")
                    .select(*hours.columns).join(touched, ["city", "timestamp"], "left_anti")
                    .withColumn("_new", F.lit(False)))
            c = hist.join(rng, "city").groupBy("city").agg(
                F.count(F.when(F.col("timestamp") < F.col("_first"), 1)).alias("b"),
                F.count(F.when(F.col("timestamp") > F.col("_last"), 1)).alias("a")).collect()
            got = {r["city"]: r for r in c}
            cities = [r[0] for r in rng.select("city").collect()]              # touched cities: few per batch
            ok_b = smin is None or a <= smin or all(got.get(x) is not None and got[x]["b"] >= back + fwd for x in cities)
            ok_a = smax is None or b >= smax or all(got.get(x) is not None and got[x]["a"] >= back + fwd for x in cities)
            if ok_b and ok_a:
                return hist.unionByName(new)
            days *= 2

    def refresh_band(self, feats: DataFrame) -> DataFrame:
        """Rows whose features the new hours can change: from ``fwd`` rows
        before the first new row to ``back`` rows after the last one, per city."""
        back, fwd = self.bounds()
        w = Window.partitionBy("city").orderBy("timestamp")
        whole = Window.partitionBy("city")
        pos = F.row_number().over(w)
        f = feats.withColumn("_pos", pos)
        first = F.min(F.when(F.col("_new"), F.col("_pos"))).over(whole)
        last = F.max(F.when(F.col("_new"), F.col("_pos"))).over(whole)
        f = f.withColumn("_a", first).withColumn("_z", last)
        return f.where((F.col("_pos") >= F.col("_a") - fwd) & (F.col("_pos") <= F.col("_z") + back)) \
            .drop("_pos", "_a", "_z", "_new")

    def track_accuracy(self, dates) -> None:
        """Keep the daily accuracy history current. A batch that touched
        days D changes actuals of D and next-day predictions for D + 1, so
        only target dates D and D + 1 are recomputed, from the stored
        observations of D - 1 .. D + 1 (date partitions pruned), and upserted
        on (city, model, target date)."""
        import datetime as dt
        day = dt.timedelta(days=1)
        targets = sorted(set(dates) | {d + day for d in dates})
        obs = (self.store.frame("obs")
               .where(F.col("date").between(F.lit(min(dates) - day), F.lit(max(dates) + day))).drop("date"))
        in_t = F.col("target_date").isin(targets)
        pdl = mx.daily_predictions(mx.next_day_log(obs, self.monitor_models)).where(in_t)
        ad = mx.daily_actuals(obs, self.actual_col).where(in_t)
        self.monitor.upsert(mx.accuracy_history(pdl, ad), "accuracy")

    def run(self, source: DataFrame, ckpt: str | None = None):
        ck = ckpt or f"{self.root}/_checkpoint"
        q = (source.writeStream.foreachBatch(self.process).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return q


def with_scratch(spark: SparkSession, fn: Callable[[str], DataFrame]) -> DataFrame:
    """Run ``fn`` with a fresh folder under the shared checkpoint directory."""
    return fn(f"{checkpoint_dir(spark)}/job-{uuid.uuid4().hex}")
