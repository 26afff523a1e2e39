"""Aligning feeds on the hour, dedupe, upsert and unions (P1-P4, J1-J3,
W11-W12, S12-S13, U1-U3, S6, J5, A26).

Dedupe and upsert are written as grouped ``min``/``max`` over a struct whose
leading fields are the ordering columns. That is a plain aggregate: Spark
combines map-side, so a key holding a third of all rows collapses to one
row per map task before the shuffle (a ``row_number`` window would instead
sort the whole hot key in one task).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.functions.time import from_unix, hour_bucket_unix


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key — the first (or last) by ``order``; remaining
    orderable columns break ties deterministically."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    types = dict(df.dtypes)
    if not any("map<" in types[c] for c in rest):
        s = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
        agg = F.min(s) if keep == "first" else F.max(s)
        return df.groupBy(*keys).agg(agg.alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in list(order) + rest])
    # map columns are not orderable: rank by the orderable columns, carry all
    ordk = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if "map<" not in types[c]])
    val = F.struct(*[F.col(c) for c in list(order) + rest])
    agg = F.min_by(val, ordk) if keep == "first" else F.max_by(val, ordk)
    return df.groupBy(*keys).agg(agg.alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in list(order) + rest])


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str] = ("timestamp", "city"),
           version: str = "_version") -> DataFrame:
    """Last write wins on ``keys``. Rows carry an ingest version (base 0,
    updates 1, or an explicit column); the highest version survives."""
    b = base if version in base.columns else base.withColumn(version, F.lit(0))
    u = updates if version in updates.columns else updates.withColumn(version, F.lit(1))
    merged = b.unionByName(u, allowMissingColumns=True)
    out = keep_one(merged, keys, [version], keep="last")
    return out.select(*[c for c in base.columns if c != version])


def with_hour_key(df: DataFrame, unix: str = "unix_time", out: str = "hour_ts") -> DataFrame:
    """P2 on epoch seconds."""
    return df.withColumn(out, hour_bucket_unix(F.col(unix)))


def align_left(pollution: DataFrame, weather: DataFrame, keys: Sequence[str] = ("city", "timestamp"),
               weather_cols: Sequence[str] | None = None, arrival: Sequence[str] | None = None) -> DataFrame:
    """Pollution LEFT JOIN weather on (city, hour). Weather is first
    projected to its value columns and deduped per hour (keep first arrival)."""
    wc = list(weather_cols or [c for c in weather.columns if c not in pollution.columns])
    w = weather.select(*keys, *wc, *(arrival or []))
    w = keep_one(w, keys, list(arrival or wc[:1]), "first").select(*keys, *wc)
    return pollution.join(w, on=list(keys), how="left")


def align_inner(weather: DataFrame, pollution: DataFrame, keys: Sequence[str] = ("city", "timestamp"),
                unix: str = "unix_time") -> DataFrame:
    """Weather INNER JOIN pollution on (city, hour); clashing columns get
    _x/_y suffixes and are then dropped; unix_time := the hour key. Duplicate
    hours multiply (no dedupe), an empty side gives an empty result."""
    clash = [c for c in weather.columns if c in pollution.columns and c not in keys]
    w = weather.select(*[F.col(c).alias(f"{c}_x") if c in clash else F.col(c) for c in weather.columns])
    p = pollution.select(*[F.col(c).alias(f"{c}_y") if c in clash else F.col(c) for c in pollution.columns])
    j = w.join(p, on=list(keys), how="inner")
    j = j.drop(*[f"{c}_x" for c in clash], *[f"{c}_y" for c in clash])
    return j.withColumn(unix, F.unix_seconds(F.col("timestamp").cast("timestamp")))


# Preferred column order of a merged weather + pollution row
MERGED_ORDER = ["datetime", "unix_time", "hour_ts",
                "temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_deg",
                "clouds", "visibility", "dew_point", "uvi",
                "aqi", "pm2_5", "pm10", "no2", "so2", "co", "o3", "nh3", "no"]


def order_present(df: DataFrame, preferred: Sequence[str] = tuple(MERGED_ORDER),
                  keys: Sequence[str] = ("city", "timestamp")) -> DataFrame:
    """P13 + P14: keep ``keys`` then the ``preferred`` columns that exist, in
    that order; anything else (join suffixes, helpers) is dropped. A pure
    projection: Catalyst prunes the dropped columns from the scans."""
    have = set(df.columns)
    return df.select(*[k for k in keys if k in have], *[c for c in preferred if c in have and c not in keys])


def align_outer(weather: DataFrame, pollution: DataFrame, keys: Sequence[str] = ("city", "timestamp"),
                weather_wins: Sequence[str] = ("unix_time",)) -> DataFrame:
    """Record merge — union of columns, full outer on the keys; for
    columns present on both sides the weather value wins when present."""
    both = [c for c in weather.columns if c in pollution.columns and c not in keys]
    w = weather.select(*keys, *[F.col(c).alias(f"_w_{c}") if c in both else F.col(c)
                                for c in weather.columns if c not in keys])
    p = pollution.select(*keys, *[F.col(c).alias(f"_p_{c}") if c in both else F.col(c)
                                  for c in pollution.columns if c not in keys])
    j = w.join(p, on=list(keys), how="full")
    merged = [F.coalesce(F.col(f"_w_{c}"), F.col(f"_p_{c}")).alias(c) for c in both]
    rest = [c for c in j.columns if not c.startswith("_w_") and not c.startswith("_p_") and c not in keys]
    return j.select(*keys, *merged, *rest)


def union_dedupe(frames: Sequence[DataFrame], keys: Sequence[str], source_col: str = "_src") -> DataFrame:
    """Concatenate frames with differing columns (missing -> NULL) and
    keep the first occurrence per key in frame order."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(source_col, F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return keep_one(out, keys, [source_col], "first").drop(source_col)


def expand_daily(daily: DataFrame, day_col: str = "day", out: str = "timestamp") -> DataFrame:
    """A daily template row -> 24 hourly rows at day start + 0..23 h."""
    start = F.col(day_col).cast("timestamp_ntz")
    hours = F.sequence(start, start + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))
    rest = [c for c in daily.columns if c != day_col]
    return daily.select(F.explode(hours).alias(out), *rest)


def resume_days(wanted: DataFrame, done: DataFrame, keys: Sequence[str] = ("city", "day")) -> DataFrame:
    """(city, day) pairs not yet completed."""
    return wanted.join(done.select(*keys).distinct(), on=list(keys), how="left_anti")


def progress(done: DataFrame, day: str = "day", records: str = "records") -> DataFrame:
    """Per-city progress counters."""
    return done.groupBy("city").agg(F.sum(records).alias("total_records"),
                                    F.countDistinct(day).alias("days_completed"),
                                    F.max(day).alias("last_date"))


def unix_to_hour(df: DataFrame, unix: str = "unix_time") -> DataFrame:
    """P1 + P2: timestamp from epoch seconds, and the hour key."""
    return df.withColumn("timestamp", from_unix(F.col(unix))).withColumn("hour_ts", hour_bucket_unix(F.col(unix)))


def city_coordinates(df: DataFrame, dim: DataFrame, city: str = "city") -> DataFrame:
    """Case-insensitive city -> (lat, lon) through a small dimension: one
    row per configured city (AQE broadcasts it when its bytes are small)."""
    d = dim.select(F.lower(F.col("city")).alias("_ck"), "lat", "lon")
    return df.join(d, F.lower(F.col(city)) == F.col("_ck"), "left").drop("_ck")


def prefer(cols: Sequence[Column]) -> Column:
    return F.coalesce(*cols)
