"""Payload-parsing queries.

The driver tables hold no API payloads, so each query first lands them:
events are folded into API-shaped JSON documents (pollution documents per
city and hour, one current-weather document per event, one weather-history
document per city and day of hourly observations), then parsed back by the
source operators. Documents are bounded by construction (a reading, at most
about 1,000 of them, or 24 hourly rows), like the API responses they stand
for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions.time import hour_bucket
from hourcast.plans import sqlgen as sg
from hourcast.sources import payloads as pl
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


#: readings of one history document, as many as a response holds
PER_DOCUMENT = 1_000


def _readings(spark, sf):
    k = views.event_k()
    item = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(F.when(k % 9 != 0, k % 5 + 1).alias("aqi")).alias("main"),
        F.struct(F.col("value").alias("pm2_5"), (F.col("value") * F.lit(2.0)).alias("pm10"),
                 k.cast("double").alias("no2")).alias("components"))
    return views.table(spark, sf, "events").select(
        F.col("event_type").alias("city"), hour_bucket(F.col("ts")).alias("hour"), item.alias("item"), "event_id")


def pollution_documents(spark, sf):
    """History documents of about PER_DOCUMENT readings: a (city, hour) with
    more is dealt out to several, so no row grows with a hot hour."""
    r = _readings(spark, sf)
    pages = r.groupBy("city", "hour").agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_DOCUMENT)).alias("pages"))
    dealt = r.join(pages, ["city", "hour"]).withColumn("page", F.pmod(F.xxhash64("event_id"), F.col("pages")))
    return dealt.groupBy("city", "hour", "page").agg(F.to_json(F.struct(F.sort_array(F.collect_list("item")).alias("list"))).alias("payload"))


def current_documents(spark, sf):
    """Current documents hold one reading, the first of their (city, hour)."""
    return _readings(spark, sf).groupBy("city", "hour").agg(F.to_json(F.struct(F.array(F.min("item")).alias("list"))).alias("payload"))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_POLL_ROWS = f"""p AS (SELECT event_type AS city, date_trunc('hour', ts) AS hour,
    CAST(FLOOR(epoch(ts)) AS BIGINT) AS unix_time,
    CASE WHEN {_K} % 9 <> 0 THEN {_K} % 5 + 1 END AS raw_idx, value, {_K} AS k FROM events),
r AS (SELECT city, hour, unix_time, make_timestamp(unix_time * 1000000) AS timestamp,
    CAST(COALESCE(raw_idx, 1) AS BIGINT) AS aqi_raw,
    CAST(CASE COALESCE(raw_idx, 1) WHEN 1 THEN 25 WHEN 2 THEN 75 WHEN 3 THEN 125 WHEN 4 THEN 175 WHEN 5 THEN 300
      ELSE 50 END AS BIGINT) AS aqi,
    0.0::DOUBLE AS co, 0.0::DOUBLE AS no, CAST(k AS DOUBLE) AS no2, 0.0::DOUBLE AS o3, 0.0::DOUBLE AS so2,
    value AS pm2_5, value * {sg.d(2)} AS pm10, 0.0::DOUBLE AS nh3, raw_idx FROM p)"""
_POLL_COLS = "city, unix_time, timestamp, aqi_raw, aqi, co, no, no2, o3, so2, pm2_5, pm10, nh3"


@q("parse_history", f"WITH {_POLL_ROWS} SELECT {_POLL_COLS} FROM r")
def parse_history(spark, sf):
    return pl.parse_pollution_history(pollution_documents(spark, sf))


@q("parse_current", f"""WITH {_POLL_ROWS}
SELECT {_POLL_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY city, hour
  ORDER BY unix_time, raw_idx NULLS FIRST, pm2_5, pm10, no2) AS rn FROM r) WHERE rn = 1""")
def parse_current(spark, sf):
    return pl.parse_pollution_current(current_documents(spark, sf))


@q("parse_forecast", f"WITH {_POLL_ROWS} SELECT city, unix_time, timestamp, aqi, pm2_5, pm10 FROM r")
def parse_forecast(spark, sf):
    return pl.parse_pollution_forecast(pollution_documents(spark, sf))


def weather_current_documents(spark, sf):
    ev = views.table(spark, sf, "events")
    k = views.event_k().cast("double")
    doc = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        (F.lit(100.0) * (F.lit(100.0) - k)).alias("visibility"),
        F.struct(F.col("value").alias("temp"), F.col("value").alias("feels_like"),
                 (F.lit(1000.0) + k).alias("pressure"), k.alias("humidity")).alias("main"),
        F.struct((k * F.lit(0.5)).alias("speed"), (k * F.lit(3.6)).alias("deg")).alias("wind"),
        F.struct(k.alias("all")).alias("clouds"))
    return ev.select(F.col("event_type").alias("city"), F.to_json(doc).alias("payload"))


@q("parse_weather_current", f"""WITH e AS (SELECT event_type AS city, CAST(FLOOR(epoch(ts)) AS BIGINT) AS unix_time,
  value, CAST({_K} AS DOUBLE) AS k FROM events)
SELECT city, unix_time, make_timestamp(unix_time * 1000000) AS timestamp, value AS temp, value AS feels_like,
  k AS humidity, {sg.d(1000)} + k AS pressure, k * {sg.d(0.5)} AS wind_speed, k * {sg.d(3.6)} AS wind_deg,
  k AS clouds, {sg.d(100)} * ({sg.d(100)} - k) AS visibility, value AS dew_point, {sg.d(5)} AS uvi,
  {sg.d(0)} AS wind_gust FROM e""")
def parse_weather_current(spark, sf):
    return pl.parse_weather_current(weather_current_documents(spark, sf))


def weather_history_documents(spark, sf):
    o = views.obs(spark, sf)
    item = F.struct(F.col("unix_time").alias("dt"), "temp", "humidity", "pressure", "wind_speed", "wind_deg", "clouds")
    return (o.groupBy("city", F.to_date("timestamp").alias("day"))
            .agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("data"))).alias("payload")))


@q("parse_weather_history", f"""WITH {sg.obs_cte()}
SELECT city, unix_time, timestamp, temp, NULL::DOUBLE AS feels_like, pressure, humidity, NULL::DOUBLE AS dew_point,
  {sg.d(0)} AS uvi, clouds, {sg.d(10000)} AS visibility, wind_speed, wind_deg, {sg.d(0)} AS wind_gust FROM obs""")
def parse_weather_history(spark, sf):
    return pl.parse_weather_history(weather_history_documents(spark, sf))
