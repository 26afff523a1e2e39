"""Time conversions and calendar parts.

All timestamps are TIMESTAMP_NTZ holding UTC wall time; conversions to and
from epoch seconds go through a UTC session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_unix(u: Column) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ."""
    return F.timestamp_seconds(u).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall time) -> epoch seconds (bigint)."""
    return F.unix_seconds(ts.cast("timestamp"))


def hour_bucket_unix(u: Column) -> Column:
    """``(u // 3600) * 3600`` — a floor, also for negative seconds."""
    return u - F.pmod(u, F.lit(3600))


def hour_bucket(ts: Column) -> Column:
    """P2 on timestamps; ``date_trunc`` yields TIMESTAMP so cast back to NTZ."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """Timestamp -> ISO-8601 text without zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def day_key(iso: Column) -> Column:
    """date part of an ISO text (text before ``T``)."""
    return F.to_date(F.substring_index(iso, "T", 1))


def _cyc(x: Column, period: float, fn) -> Column:
    # 2*pi*x/period evaluated left to right, as the reference does.
    return fn(F.lit(2.0) * F.lit(math.pi) * x / F.lit(float(period)))


def calendar_columns(ts: Column, preset: str = "a") -> list[Column]:
    """F1-F6 as one list of expressions over ``ts``.

    Preset ``a`` (full set): hour, day_of_week (Monday=0), day_of_month,
    month, week_of_year (ISO) with sin/cos encodings, is_weekend, is_night,
    is_rush_hour and the four season flags. Preset ``b``: hour, day,
    day_of_week, month, year, is_weekend and hour/day_of_week/month encodings.
    """
    hour = F.hour(ts)
    dow = F.weekday(ts)
    dom = F.dayofmonth(ts)
    month = F.month(ts)
    if preset == "b":
        return [
            hour.alias("hour"), dom.alias("day"), dow.alias("day_of_week"),
            month.alias("month"), F.year(ts).alias("year"),
            (dow >= 5).cast("int").alias("is_weekend"),
            _cyc(hour, 24, F.sin).alias("hour_sin"), _cyc(hour, 24, F.cos).alias("hour_cos"),
            _cyc(dow, 7, F.sin).alias("day_of_week_sin"), _cyc(dow, 7, F.cos).alias("day_of_week_cos"),
            _cyc(month, 12, F.sin).alias("month_sin"), _cyc(month, 12, F.cos).alias("month_cos"),
        ]
    woy = F.weekofyear(ts)
    return [
        hour.alias("hour"),
        _cyc(hour, 24, F.sin).alias("hour_sin"), _cyc(hour, 24, F.cos).alias("hour_cos"),
        dow.alias("day_of_week"),
        _cyc(dow, 7, F.sin).alias("dow_sin"), _cyc(dow, 7, F.cos).alias("dow_cos"),
        dom.alias("day_of_month"),
        _cyc(dom, 31, F.sin).alias("dom_sin"), _cyc(dom, 31, F.cos).alias("dom_cos"),
        month.alias("month"),
        _cyc(month, 12, F.sin).alias("month_sin"), _cyc(month, 12, F.cos).alias("month_cos"),
        woy.alias("week_of_year"),
        _cyc(woy, 52, F.sin).alias("woy_sin"), _cyc(woy, 52, F.cos).alias("woy_cos"),
        (dow >= 5).cast("int").alias("is_weekend"),
        ((hour >= 22) | (hour <= 5)).cast("int").alias("is_night"),
        (((hour >= 7) & (hour <= 9)) | ((hour >= 17) & (hour <= 19))).cast("int").alias("is_rush_hour"),
        *season_flags(month),
    ]


def season_flags(month: Column) -> list[Column]:
    """months (0,3] winter, (3,6] spring, (6,9] summer, (9,12] fall."""
    return [
        ((month > 0) & (month <= 3)).alias("season_winter"),
        ((month > 3) & (month <= 6)).alias("season_spring"),
        ((month > 6) & (month <= 9)).alias("season_summer"),
        ((month > 9) & (month <= 12)).alias("season_fall"),
    ]
