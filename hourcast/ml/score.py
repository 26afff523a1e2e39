"""Batch scoring of the latest reading of every city and the 3-day outlook
(M20, M21, A25)."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.functions.scalars import aqi_category, alert_level, current_aqi, health_advisory, pm25_to_aqi
from hourcast.operators import clean as cl
from hourcast.operators import scale as scl
from hourcast.sources.store import latest_rows


#: reading shown in a prediction record -> feature column
RECORD = {"temperature": "temp", "humidity": "humidity", "pm2_5": "pm2_5", "pm10": "pm10", "co": "co", "o3": "o3",
          "no2": "no2", "so2": "so2", "wind_speed": "wind_speed", "clouds": "clouds"}


def score_latest(features: DataFrame, model, feature_names: Sequence[str], model_name: str,
                 scale_params: dict | None = None, keys: Sequence[str] = ("city",),
                 current: str = "aqi", concentration: bool = False) -> DataFrame:
    """One prediction record per key from its most recent feature row.
    Missing expected features become 0 (P9), NULLs become 0 (P8).
    ``concentration``: the model predicts PM2.5, which becomes the index
    before it is named and classified as one. The record carries the
    reading it was made from; quantities that the frame lacks are NULL, a
    missing reading counts as 0 (P8). ``timestamp`` is the time of that
    reading."""
    latest = latest_rows(features, keys)                                        # P19
    shown = {name: c for name, c in RECORD.items() if c in latest.columns}
    latest = latest.select("*", *[F.col(c).cast("double").alias(f"_r_{name}") for name, c in shown.items()])
    held = [f"_r_{name}" for name in shown]
    aligned = cl.align_features(latest, feature_names, keep=[*keys, "timestamp", current, *held])
    aligned = cl.fill_zero(aligned, [*feature_names, *held])
    if scale_params:
        aligned = scl.transform(aligned, {k: v for k, v in scale_params.items() if k in feature_names})
    if isinstance(model, PipelineModel):
        p = model.transform(aligned)
    else:
        p = model.transform(VectorAssembler(inputCols=list(feature_names), outputCol="features").transform(aligned))
    if concentration:
        p = p.withColumn("prediction", pm25_to_aqi(F.round(F.greatest(F.col("prediction"), F.lit(0.0)), 1)).cast("double"))
    return p.select(*keys, "timestamp", current_aqi(current).alias("current_aqi"),
                    F.col("prediction").alias("predicted_aqi_24h"),
                    aqi_category(F.col("prediction")).alias("category"),
                    health_advisory(F.col("prediction")).alias("health_advisory"),
                    F.lit(model_name).alias("model_used"),
                    *[(F.col(f"_r_{name}") if name in shown else F.lit(None).cast("double")).alias(name) for name in RECORD])


def forecast_days(scored: DataFrame, days: int = 3, seed: int | None = 42, spread: float = 10.0,
                  keys: Sequence[str] = ("city",)) -> DataFrame:
    """Day d = base + U(-spread, spread) * (d - 1), floored at 0; the
    category uses the unfloored value. ``seed=None`` -> no noise."""
    e = scored.select(*keys, "timestamp", "predicted_aqi_24h", "model_used",
                      F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    # drawn from the row's key, so retries and other partitionings agree
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("day").cast("string"),
                                                F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
    noise = (draw * F.lit(2 * spread) - F.lit(spread)) if seed is not None else F.lit(0.0)
    raw = F.col("predicted_aqi_24h") + noise * (F.col("day") - F.lit(1))
    e = e.withColumn("_raw", raw)
    return e.select(*keys, "day", F.date_format(F.date_add(F.to_date("timestamp"), F.col("day")), "yyyy-MM-dd")
                    .alias("date"), F.greatest(F.lit(0.0), F.col("_raw")).alias("predicted_aqi"),
                    aqi_category(F.col("_raw")).alias("aqi_category"),
                    health_advisory(F.col("_raw")).alias("health_advisory"), "model_used")


def alerts(forecast: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """Highest forecast per city -> ALERT (>200) / WARNING (>150) / OK."""
    g = forecast.groupBy(*keys).agg(F.max("predicted_aqi").alias("max_aqi"))
    return g.withColumn("level", alert_level("max_aqi"))


def outlook_document(scored: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """S15 shape: {city, current_prediction{}, forecasts[], generated_at} per
    city; the forecast list per city is 3 rows (bounded)."""
    fc = forecast.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("day", "date", "predicted_aqi",
                                                                          "aqi_category"))).alias("forecasts"))
    cur = scored.select(*keys, F.struct(*[c for c in scored.columns if c not in keys]).alias("current_prediction"))
    return cur.join(fc, list(keys)).withColumn("generated_at", F.current_timestamp())
