"""Feature queries over the driver tables (W1-W9, F1-F7) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators import features as fx
from hourcast.operators import rowstats as rs
from hourcast.plans import sqlgen as sg
from hourcast.sources import views

QUERIES: dict = {}
ORACLE: dict = {}

A = fx.PresetA()
B = fx.PresetB()
KEYS = ["city", "timestamp"]
W = sg.win()
TRIG = ("_sin", "_cos", "wind_u", "wind_v")


def _round_trig(df):
    return df.select(*[F.round(c, 9).alias(c) if any(t in c for t in TRIG) else F.col(c) for c in df.columns])


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# obs_hourly (P2) -------------------------------------------------------------
@q("obs_hourly", f"WITH {sg.obs_cte()} SELECT * FROM obs")
def obs_hourly(spark, sf):
    return views.obs(spark, sf)


# W1 ---------------------------------------------------------------------------
_lag_a_cols = ["pm2_5", "pm10", "temp", "humidity", "wind_speed"]


@q("lag_features_a", f"WITH {sg.obs_cte()} SELECT city, timestamp, "
   + ", ".join(f"{sg.lag(c, k, W)} AS {c}_lag_{k}h" for c in _lag_a_cols for k in A.lag_hours) + " FROM obs")
def lag_features_a(spark, sf):
    w = fx.Series().window()
    return views.obs(spark, sf).select(*KEYS, *fx.lag_columns(w, _lag_a_cols, A.lag_hours))


@q("lag_features_b", f"WITH {sg.obs_cte()} SELECT city, timestamp, "
   + ", ".join(f"{sg.lag('aqi', k, W)} AS aqi_lag_{k}h" for k in B.lags) + " FROM obs")
def lag_features_b(spark, sf):
    w = fx.Series().window()
    return views.obs(spark, sf).select(*KEYS, *fx.lag_columns(w, ["aqi"], B.lags))


# W2-W5 ------------------------------------------------------------------------
_roll_a_cols = ["pm2_5", "pm10", "temp", "humidity"]


@q("rolling_a", f"WITH {sg.obs_cte()} SELECT city, timestamp, "
   + ", ".join(f"{sg.rolling(c, w, s, W, 1, 2)} AS {c}_rolling_{s}_{w}h"
               for c in _roll_a_cols for w in A.rolling_windows for s in fx.STATS) + " FROM obs")
def rolling_a(spark, sf):
    return fx.with_rolling(views.obs(spark, sf), fx.Series(), _roll_a_cols, A.rolling_windows,
                           min_periods=1, decimals=2, keep=KEYS)


@q("rolling_b", f"WITH {sg.obs_cte()} SELECT city, timestamp, "
   + ", ".join(f"{sg.rolling('aqi', w, s, W, w, 0)} AS aqi_rolling_{s}_{w}h"
               for w in B.windows for s in fx.STATS) + " FROM obs")
def rolling_b(spark, sf):
    return fx.with_rolling(views.obs(spark, sf), fx.Series(), ["aqi"], B.windows,
                           min_periods=None, decimals=0, keep=KEYS)


# W6, W7 -----------------------------------------------------------------------
_chg_a_cols = ["pm2_5", "pm10", "temp", "humidity", "pressure"]


def _change_sql(src_cte, cols, periods, w, keys, diff_name, extra_keys=()):
    pads = ", ".join(f"{sg.pad(c, w)} AS pad_{c}" for c in cols)
    body = []
    for c in cols:
        for p in periods:
            body.append(f"{c} - {sg.lag(c, p, w)} AS {diff_name.format(col=c, p=p)}")
            body.append(f"{sg.pct('pad_' + c, p, w)} AS {c}_pct_change_{p}h")
    sel = ", ".join(list(keys) + body)
    return f"WITH {src_cte}, padded AS (SELECT *, {pads} FROM src) SELECT {sel} FROM padded"


@q("change_a", _change_sql(sg.obs_cte("src"), _chg_a_cols, A.change_periods, W, KEYS, "{col}_diff_{p}h"))
def change_a(spark, sf):
    s = fx.Series()
    w = s.window()
    o = views.obs(spark, sf)
    padded = o.select("*", *fx.pad_columns(w, _chg_a_cols))
    cols = []
    for c in _chg_a_cols:
        cols += fx.diff_columns(w, [c], A.change_periods)
        cols += fx.pct_change_columns(w, [c], A.change_periods)
    return padded.select(*KEYS, *cols)


_RAW_W = sg.win(("city",), ("timestamp", "event_id"))


@q("change_b", _change_sql(sg.RAW_CTE.replace("raw AS", "src AS", 1), ["value"], B.periods, _RAW_W,
                           ["city", "event_id"], "{col}_change_{p}h"))
def change_b(spark, sf):
    """Preset-B change on raw events with NULL gaps: pct change pads first.
    Raw events have few keys, so the plan is chosen from per-(key, minute)
    counts: one window per key while every key fits a block, else the
    halo-blocked plan (``change_b_blocked`` forces the latter)."""
    from hourcast.operators import halo
    s = fx.Series(keys=("city",), order=("timestamp", "event_id"))
    buckets = [F.date_trunc("minute", F.col("timestamp"))]
    return halo.skew_safe(views.raw_series(spark, sf), _change_b_build, s, max(B.periods), 0, buckets,
                          pad_cols=["value"])


# W8 ---------------------------------------------------------------------------
@q("targets_a", f"WITH {sg.obs_cte()} SELECT city, timestamp, "
   + ", ".join(f"{sg.lead('pm2_5', h, W)} AS target_{h}h" for h in A.horizons) + " FROM obs")
def targets_a(spark, sf):
    w = fx.Series().window()
    return views.obs(spark, sf).select(*KEYS, *fx.lead_columns(w, "pm2_5", A.horizons))


@q("targets_b", f"WITH {sg.obs_cte()} SELECT city, timestamp, "
   + ", ".join(f"{sg.lead('aqi', h, W)} AS aqi_target_{h}h" for h in B.horizons) + " FROM obs")
def targets_b(spark, sf):
    w = fx.Series().window()
    return views.obs(spark, sf).select(*KEYS, *fx.lead_columns(w, "aqi", B.horizons, name="{col}_target_{h}h"))


# F1-F6 ------------------------------------------------------------------------
@q("calendar_a", f"WITH {sg.obs_cte()} SELECT city, timestamp, " + ", ".join(sg.calendar_sql("timestamp", "a"))
   + " FROM obs")
def calendar_a(spark, sf):
    from hourcast.functions.time import calendar_columns
    return _round_trig(views.obs(spark, sf).select(*KEYS, *calendar_columns(F.col("timestamp"), "a")))


@q("calendar_b", f"WITH {sg.obs_cte()} SELECT city, timestamp, " + ", ".join(sg.calendar_sql("timestamp", "b"))
   + " FROM obs")
def calendar_b(spark, sf):
    from hourcast.functions.time import calendar_columns
    return _round_trig(views.obs(spark, sf).select(*KEYS, *calendar_columns(F.col("timestamp"), "b")))


# F7, W9 -----------------------------------------------------------------------
_INTER_SQL = [
    "temp * humidity AS temp_humidity",
    f"{sg.r9('wind_speed * COS(RADIANS(wind_deg))')} AS wind_u",
    f"{sg.r9('wind_speed * SIN(RADIANS(wind_deg))')} AS wind_v",
    f"pm2_5 / NULLIF(pm10 + {sg.d(0.001)}, 0) AS pm25_pm10_ratio",
    f"{sg.d(10000)} / NULLIF(visibility + {sg.d(1)}, 0) AS visibility_inv",
    f"pressure - {sg.lag('pressure', 3, W)} AS pressure_gradient",
]


@q("interactions", f"WITH {sg.obs_cte()} SELECT city, timestamp, " + ", ".join(_INTER_SQL) + " FROM obs")
def interactions(spark, sf):
    from hourcast.functions.scalars import interaction_columns
    o = views.obs(spark, sf)
    w = fx.Series().window()
    return _round_trig(o.select(*KEYS, *interaction_columns(set(o.columns)),
                                *fx.diff_columns(w, ["pressure"], [3], name="pressure_gradient")))


# Full presets ----------------------------------------------------------------
def _full_a_select():
    lag_c, roll_c, chg_c = A.resolve(["pm2_5", "pm10", "temp", "humidity", "wind_speed", "pressure"])
    sel = ["city", "timestamp", "unix_time", "n", "pm2_5", "pm10", "temp", "humidity", "wind_speed",
           "wind_deg", "pressure", "clouds", "visibility", "aqi"]
    sel += sg.calendar_sql("timestamp", "a")
    sel += [f"{sg.lag(c, k, W)} AS {c}_lag_{k}h" for c in lag_c for k in A.lag_hours]
    sel += [f"{sg.rolling(c, w, s, W, 1, 2)} AS {c}_rolling_{s}_{w}h"
            for c in roll_c for w in A.rolling_windows for s in fx.STATS]
    for c in chg_c:
        sel += [f"{c} - {sg.lag(c, p, W)} AS {c}_diff_{p}h" for p in A.change_periods]
        sel += [f"{sg.pct('pad_' + c, p, W)} AS {c}_pct_change_{p}h" for p in A.change_periods]
    sel += _INTER_SQL[:5] + [f"pressure - {sg.lag('pressure', 3, W)} AS pressure_gradient"]
    sel += [f"{sg.lead('pm2_5', h, W)} AS target_{h}h" for h in A.horizons]
    return sel, chg_c


def full_a_names() -> list[str]:
    """Output column names of features_full_a, in order."""
    return [e.rsplit(" AS ", 1)[1] if " AS " in e else e for e in _full_a_select()[0]]


def _full_a_sql():
    sel, chg_c = _full_a_select()
    pads = ", ".join(f"{sg.pad(c, W)} AS pad_{c}" for c in chg_c)
    return f"WITH {sg.obs_cte()}, padded AS (SELECT *, {pads} FROM obs) SELECT {', '.join(sel)} FROM padded"


def _days():
    return [F.date_trunc("day", F.col("timestamp"))]


def preset_a(df):
    """Preset A, split by blocks where a city is hot."""
    from hourcast.operators import halo
    back = max(*A.lag_hours, *A.rolling_windows, *A.change_periods, 3)
    return halo.skew_safe(df, lambda f, s: fx.features_a(f, series=s, decimals=2), fx.Series(), back, max(A.horizons),
                          _days(), pad_cols=A.resolve(df.columns)[2])


def preset_b(df):
    from hourcast.operators import halo
    back = max(*B.lags, *B.windows, *B.periods)
    return halo.skew_safe(df, lambda f, s: fx.features_b(f, series=s, decimals=0), fx.Series(), back, max(B.horizons),
                          _days(), pad_cols=[B.target])


@q("features_full_a", _full_a_sql())
def features_full_a(spark, sf):
    return _round_trig(preset_a(views.obs(spark, sf)))


def _full_b_sql():
    sel = ["city", "timestamp", "unix_time", "n", "pm2_5", "pm10", "temp", "humidity", "wind_speed",
           "wind_deg", "pressure", "clouds", "visibility", "aqi"]
    sel += sg.calendar_sql("timestamp", "b")
    sel += [f"{sg.lag('aqi', k, W)} AS aqi_lag_{k}h" for k in B.lags]
    sel += [f"{sg.rolling('aqi', w, s, W, w, 0)} AS aqi_rolling_{s}_{w}h" for w in B.windows for s in fx.STATS]
    for p in B.periods:
        sel += [f"aqi - {sg.lag('aqi', p, W)} AS aqi_change_{p}h", f"{sg.pct('pad_aqi', p, W)} AS aqi_pct_change_{p}h"]
    sel += [f"{sg.lead('aqi', h, W)} AS aqi_target_{h}h" for h in B.horizons]
    return (f"WITH {sg.obs_cte()}, padded AS (SELECT *, CAST({sg.pad('aqi', W)} AS DOUBLE) AS pad_aqi FROM obs) "
            f"SELECT {', '.join(sel)} FROM padded")


@q("features_full_b", _full_b_sql())
def features_full_b(spark, sf):
    return _round_trig(preset_b(views.obs(spark, sf)))


# Long series (bench): lineitem per supplier, 64 rolling + 28 lag columns ----------
_LONG_COLS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
_LONG_W = sg.win(("series",), views.LONG_ORDER)


@q("long_series_features", "WITH src AS (SELECT l_suppkey AS series, l_shipdate AS timestamp, l_orderkey, l_linenumber, "
   "l_partkey, " + ", ".join(_LONG_COLS) + " FROM lineitem) SELECT series, l_orderkey, l_linenumber, l_partkey, "
   + ", ".join([f"{sg.lag(c, k, _LONG_W)} AS {c}_lag_{k}h" for c in _LONG_COLS for k in A.lag_hours]
               + [f"{sg.rolling(c, w, s, _LONG_W, 1, 2)} AS {c}_rolling_{s}_{w}h"
                  for c in _LONG_COLS for w in A.rolling_windows for s in fx.STATS]) + " FROM src")
def long_series_features(spark, sf):
    """One window per supplier while every supplier fits a block (decided from
    per-(key, bucket) counts); a hot supplier switches to the blocked plan."""
    from hourcast.operators import halo
    s = fx.Series(keys=("series",), order=views.LONG_ORDER)
    back = max(max(A.lag_hours), max(A.rolling_windows) - 1)
    return halo.skew_safe(views.long_series(spark, sf), _long_build, s, back, 0, _long_buckets())


def _long_buckets():
    return [F.col("timestamp"), F.floor(F.col("l_orderkey") / F.lit(1024))]


# Halo-blocked twins (§4.3.2): same results as the queries above, computed per
# (key, block) so one hot key is spread over many tasks. Blocks are sized from
# the data (largest key / cores), so at test scale every key spans several.
def _long_build(frame, s):
    return rs.lags_and_rolling(frame, s, _LONG_COLS, A.lag_hours, A.rolling_windows, fx.STATS, 1, 2,
                               keep=["series", "l_orderkey", "l_linenumber", "l_partkey"], only="_core")


@q("long_series_blocked", ORACLE["long_series_features"])
def long_series_blocked(spark, sf):
    from hourcast.operators import halo
    s = fx.Series(keys=("series",), order=views.LONG_ORDER)
    back = max(max(A.lag_hours), max(A.rolling_windows) - 1)
    return halo.blocked(views.long_series(spark, sf), _long_build, s, back, 0, _long_buckets())


def _change_b_build(frame, s):
    w = s.window()
    padded = frame.select("*", *fx.pad_columns(w, ["value"], frame))
    cols = []
    for p in B.periods:
        cols += fx.diff_columns(w, ["value"], [p], name="{col}_change_{p}h")
        cols += fx.pct_change_columns(w, ["value"], [p])
    return padded.select("city", "event_id", "_core", *cols)


@q("change_b_blocked", ORACLE["change_b"])
def change_b_blocked(spark, sf):
    """change_b over raw events (5 keys, NULL gaps) on the blocked path: the
    forward fill behind percent change crosses blocks via carried values."""
    from hourcast.operators import halo
    s = fx.Series(keys=("city",), order=("timestamp", "event_id"))
    buckets = [F.date_trunc("minute", F.col("timestamp"))]
    return halo.blocked(views.raw_series(spark, sf), _change_b_build, s, max(B.periods), 0, buckets,
                        pad_cols=["value"])
