"""Landed API payloads -> flat hourly records.

Payloads arrive as JSON documents (files read with an explicit schema, or a
string column parsed with ``from_json``); parsing is struct projection plus
``inline``/``explode`` of the nested lists, with defaults via ``coalesce``.
Under ANSI mode ``list[0]`` raises on an empty list, so ``get`` is used and
an empty list yields no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.scalars import aqi_from_index
from hourcast.functions.time import from_unix

D = T.DoubleType()
COMPONENTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]

POLLUTION_ITEM = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType([T.StructField("aqi", T.IntegerType())])),
    T.StructField("components", T.StructType([T.StructField(c, D) for c in COMPONENTS])),
])
POLLUTION_PAYLOAD = T.StructType([T.StructField("list", T.ArrayType(POLLUTION_ITEM))])

WEATHER_CURRENT = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("visibility", D),
    T.StructField("main", T.StructType([T.StructField(c, D) for c in ("temp", "feels_like", "pressure", "humidity")])),
    T.StructField("wind", T.StructType([T.StructField(c, D) for c in ("speed", "deg", "gust")])),
    T.StructField("clouds", T.StructType([T.StructField("all", D)])),
])
WEATHER_HOURS = ["temp", "feels_like", "pressure", "humidity", "dew_point", "uvi", "clouds", "visibility",
                 "wind_speed", "wind_deg", "wind_gust"]
WEATHER_HISTORY = T.StructType([T.StructField("data", T.ArrayType(T.StructType(
    [T.StructField("dt", T.LongType())] + [T.StructField(c, D) for c in WEATHER_HOURS])))])


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed JSON files (one document per line) with a fixed schema."""
    return spark.read.schema(schema).json(path)


def _pollution_record(item: Column, defaults: bool = True) -> list[Column]:
    comp = [F.coalesce(item["components"][c], F.lit(0.0)).alias(c) if defaults else item["components"][c].alias(c)
            for c in COMPONENTS]
    raw = F.coalesce(item["main"]["aqi"], F.lit(1)) if defaults else item["main"]["aqi"]
    return [item["dt"].alias("unix_time"), from_unix(item["dt"]).alias("timestamp"),
            raw.cast("long").alias("aqi_raw"), aqi_from_index(raw).cast("long").alias("aqi"), *comp]


def parse_pollution_current(df: DataFrame, payload: str = "payload", keys=("city",), defaults: bool = True) -> DataFrame:
    """First element of ``list`` as one record; empty list -> no row."""
    p = F.from_json(F.col(payload), POLLUTION_PAYLOAD) if dict(df.dtypes)[payload] == "string" else F.col(payload)
    first = F.get(p["list"], 0)
    return df.select(*keys, first.alias("_i")).where(F.col("_i").isNotNull()) \
        .select(*keys, *_pollution_record(F.col("_i"), defaults))


def parse_pollution_history(df: DataFrame, payload: str = "payload", keys=("city",), defaults: bool = True) -> DataFrame:
    """One record per ``list`` element."""
    p = F.from_json(F.col(payload), POLLUTION_PAYLOAD) if dict(df.dtypes)[payload] == "string" else F.col(payload)
    return df.select(*keys, F.explode(p["list"]).alias("_i")).select(*keys, *_pollution_record(F.col("_i"), defaults))


def parse_pollution_forecast(df: DataFrame, payload: str = "payload", keys=("city",)) -> DataFrame:
    """S3: as S2, keeping only aqi, pm2_5 and pm10."""
    h = parse_pollution_history(df, payload, keys)
    return h.select(*keys, "unix_time", "timestamp", "aqi", "pm2_5", "pm10")


def parse_weather_current(df: DataFrame, payload: str = "payload", keys=("city",)) -> DataFrame:
    """Nested current-weather document -> flat record; dew_point := temp,
    uvi := 5.0, missing gust -> 0."""
    p = F.from_json(F.col(payload), WEATHER_CURRENT) if dict(df.dtypes)[payload] == "string" else F.col(payload)
    m, w = p["main"], p["wind"]
    return df.select(*keys, p["dt"].alias("unix_time"), from_unix(p["dt"]).alias("timestamp"),
                     m["temp"].alias("temp"), m["feels_like"].alias("feels_like"), m["humidity"].alias("humidity"),
                     m["pressure"].alias("pressure"), w["speed"].alias("wind_speed"), w["deg"].alias("wind_deg"),
                     p["clouds"]["all"].alias("clouds"), p["visibility"].alias("visibility"),
                     m["temp"].alias("dew_point"), F.lit(5.0).alias("uvi"),
                     F.coalesce(w["gust"], F.lit(0.0)).alias("wind_gust"))


def parse_weather_history(df: DataFrame, payload: str = "payload", keys=("city",)) -> DataFrame:
    """One record per ``data`` element; uvi 0, visibility 10000 and
    wind_gust 0 when absent."""
    p = F.from_json(F.col(payload), WEATHER_HISTORY) if dict(df.dtypes)[payload] == "string" else F.col(payload)
    e = df.select(*keys, F.explode(p["data"]).alias("_i"))
    i = F.col("_i")
    fill = {"uvi": 0.0, "visibility": 10000.0, "wind_gust": 0.0}
    return e.select(*keys, i["dt"].alias("unix_time"), from_unix(i["dt"]).alias("timestamp"),
                    *[F.coalesce(i[c], F.lit(fill[c])).alias(c) if c in fill else i[c].alias(c) for c in WEATHER_HOURS])
