"""Driver tables re-read as hourly observation frames.

The test tables are not sensor data, so a fixed mapping turns them into the
shapes the operators expect. Every view is an aggregate or projection of the
given tables (its work grows with them) and every derived number is exact
fixed-point (at most two decimals), so that window statistics computed by
Spark and by the SQL oracle agree bit for bit.

``obs``: ``events`` grouped by (``event_type`` as city, hour of ``ts``)

=============  ==================================================
city           event_type
timestamp      hour bucket (floor) of ts, TIMESTAMP_NTZ
unix_time      epoch seconds of timestamp
n              events in the hour
pm2_5          mean value, truncated to 0.01
pm10           max value
temp           min value
humidity       mean props.k, truncated to an integer
wind_speed     n as double
wind_deg       3.6 * max k
pressure       1000 + min k
clouds         max k
visibility     100 * (100 - max k)  (0 when max k = 99 -> "missing")
aqi            ceil(max value) as bigint
=============  ==================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.functions.time import hour_bucket, epoch_seconds

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    """Two-decimal double -> exact integer hundredths."""
    return F.round(c * F.lit(100.0)).cast("long")


def event_k(props: Column | None = None) -> Column:
    """Integer ``k`` of the ``props`` JSON text."""
    return F.get_json_object(F.col("props") if props is None else props, "$.k").cast("int")


PARTIAL_KEYS = ("city", "timestamp")


def hourly_partials(ev: DataFrame) -> DataFrame:
    """Per (city, hour) the mergeable aggregates of an events-shaped frame:
    counts, sums of whole numbers, extremes. Those of two frames merge into
    those of their union (``merge_partials``)."""
    k = event_k()
    return ev.select(F.col("event_type").alias("city"), hour_bucket(F.col("ts")).alias("timestamp"),
                     cents(F.col("value")).alias("_c"), F.col("value"), k.alias("_k")) \
        .groupBy(*PARTIAL_KEYS).agg(
            F.count(F.lit(1)).alias("n"), F.sum("_c").alias("sum_c"), F.max("value").alias("max_v"), F.min("value").alias("min_v"),
            F.sum("_k").alias("sum_k"), F.max("_k").alias("max_k"), F.min("_k").alias("min_k"))


def merge_partials(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*PARTIAL_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n", "sum_c")], F.max("max_v").alias("max_v"), F.min("min_v").alias("min_v"),
        F.sum("sum_k").alias("sum_k"), F.max("max_k").alias("max_k"), F.min("min_k").alias("min_k"))


def hourly_from_partials(g: DataFrame) -> DataFrame:
    """Hourly observation frame from one row of aggregates per (city, hour)."""
    return g.select(
        "city", "timestamp",
        epoch_seconds(F.col("timestamp")).alias("unix_time"),
        "n",
        (F.expr("sum_c div n").cast("double") / F.lit(100.0)).alias("pm2_5"),
        F.col("max_v").alias("pm10"), F.col("min_v").alias("temp"),
        F.expr("sum_k div n").cast("double").alias("humidity"),
        F.col("n").cast("double").alias("wind_speed"),
        (F.col("max_k").cast("double") * F.lit(3.6)).alias("wind_deg"),
        (F.lit(1000.0) + F.col("min_k").cast("double")).alias("pressure"),
        F.col("max_k").cast("double").alias("clouds"),
        (F.lit(100.0) * (F.lit(100) - F.col("max_k")).cast("double")).alias("visibility"),
        F.ceil(F.col("max_v")).cast("long").alias("aqi"),
    )


def hourly_from_events(ev: DataFrame) -> DataFrame:
    """Hourly observation frame from an events-shaped frame (see module doc)."""
    return hourly_from_partials(hourly_partials(ev))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_from_events(table(spark, sf_dir, "events"))


def obs_split(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Hourly frame over even (0) / odd (1) event ids: two independent feeds."""
    ev = table(spark, sf_dir, "events").where((F.col("event_id") % 2) == parity)
    return hourly_from_events(ev)


def pollution_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs_split(spark, sf_dir, 0)
    return o.select("city", "timestamp", "unix_time", "aqi", "pm2_5", "pm10")


def weather_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs_split(spark, sf_dir, 1)
    return o.select("city", "timestamp", "unix_time", "temp", "humidity", "pressure",
                    "wind_speed", "wind_deg", "clouds", "visibility")


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw per-type series; value NULL on every 17th event id so
    NULL-handling paths (padding, min_periods, imputation) are exercised."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("city"), F.col("ts").alias("timestamp"), "event_id",
        F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        event_k().cast("double").alias("k"))


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one series per supplier, ordered by a unique key."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("series"), F.col("l_shipdate").alias("timestamp"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax")


LONG_ORDER = ("timestamp", "l_orderkey", "l_linenumber", "l_partkey")
