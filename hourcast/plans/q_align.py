"""Alignment, dedupe/upsert, imputation and scalar-function queries
(J1-J3, W11-W12, S12, U1-U2, S6, P4-P9, P21, F8-F13, F16-F17, F9-F10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions import scalars as sc
from hourcast.functions.time import hour_bucket
from hourcast.operators import align as al
from hourcast.operators import clean as cl
from hourcast.plans import sqlgen as sg
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


FEEDS = f"""{sg.obs_cte('pe', 'WHERE event_id % 2 = 0')}, {sg.obs_cte('we', 'WHERE event_id % 2 = 1')},
p AS (SELECT city, timestamp, unix_time, aqi, pm2_5, pm10 FROM pe),
w AS (SELECT city, timestamp, unix_time, temp, humidity, pressure, wind_speed, wind_deg, clouds, visibility FROM we)"""
WCOLS = ["temp", "humidity", "pressure", "wind_speed", "wind_deg", "clouds", "visibility"]
PCOLS = ["aqi", "pm2_5", "pm10"]


# J1 / J2 / J3 -------------------------------------------------------------------
@q("align_left", f"""WITH {FEEDS},
wd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, timestamp ORDER BY temp) AS r FROM w) WHERE r = 1)
SELECT p.city, p.timestamp, p.unix_time, {', '.join('p.' + c for c in PCOLS)}, {', '.join('wd.' + c for c in WCOLS)}
FROM p LEFT JOIN wd ON p.city = wd.city AND p.timestamp = wd.timestamp""")
def align_left(spark, sf):
    return al.align_left(views.pollution_feed(spark, sf), views.weather_feed(spark, sf),
                         weather_cols=WCOLS, arrival=None)


@q("align_inner", f"""WITH {FEEDS}
SELECT w.city, w.timestamp, {', '.join('w.' + c for c in WCOLS)}, {', '.join('p.' + c for c in PCOLS)},
  CAST(epoch(w.timestamp) AS BIGINT) AS unix_time
FROM w JOIN p ON w.city = p.city AND w.timestamp = p.timestamp""")
def align_inner(spark, sf):
    return al.align_inner(views.weather_feed(spark, sf), views.pollution_feed(spark, sf))


_ORDERED = [c for c in al.MERGED_ORDER if c in ["unix_time"] + WCOLS + PCOLS]


@q("align_inner_ordered", f"""WITH {FEEDS},
j AS (SELECT w.city, w.timestamp, {', '.join('w.' + c for c in WCOLS)}, {', '.join('p.' + c for c in PCOLS)},
        CAST(epoch(w.timestamp) AS BIGINT) AS unix_time
      FROM w JOIN p ON w.city = p.city AND w.timestamp = p.timestamp)
SELECT city, timestamp, {', '.join(_ORDERED)} FROM j""")
def align_inner_ordered(spark, sf):
    """J2 then P13/P14: suffix columns dropped, preferred column order."""
    return al.order_present(al.align_inner(views.weather_feed(spark, sf), views.pollution_feed(spark, sf)))


@q("align_outer", f"""WITH {FEEDS}
SELECT COALESCE(w.city, p.city) AS city, COALESCE(w.timestamp, p.timestamp) AS timestamp,
  COALESCE(w.unix_time, p.unix_time) AS unix_time, {', '.join('w.' + c for c in WCOLS)}, {', '.join('p.' + c for c in PCOLS)}
FROM w FULL OUTER JOIN p ON w.city = p.city AND w.timestamp = p.timestamp""")
def align_outer(spark, sf):
    return al.align_outer(views.weather_feed(spark, sf), views.pollution_feed(spark, sf))


# W11 / W12 / S12 / U1 ---------------------------------------------------------------
def _dedupe_sql(desc):
    d = " DESC" if desc else ""
    return f"""WITH {sg.RAW_CTE},
r AS (SELECT city, date_trunc('hour', timestamp) AS hour_ts, timestamp, event_id, value, k FROM raw)
SELECT city, hour_ts, timestamp, event_id, value, k FROM (
  SELECT *, row_number() OVER (PARTITION BY city, hour_ts ORDER BY timestamp{d}, event_id{d}) AS rn FROM r) WHERE rn = 1"""


def _dedupe(spark, sf, keep):
    r = views.raw_series(spark, sf).withColumn("hour_ts", hour_bucket(F.col("timestamp")))
    out = al.keep_one(r, ["city", "hour_ts"], ["timestamp", "event_id"], keep)
    return out.select("city", "hour_ts", "timestamp", "event_id", "value", "k")


@q("dedupe_first", _dedupe_sql(False))
def dedupe_first(spark, sf):
    return _dedupe(spark, sf, "first")


@q("dedupe_last", _dedupe_sql(True))
def dedupe_last(spark, sf):
    return _dedupe(spark, sf, "last")


@q("upsert", f"""WITH {sg.obs_cte()}, {sg.obs_cte('upd', 'WHERE event_id % 2 = 0')},
u AS (SELECT *, 0 AS v FROM obs UNION ALL SELECT *, 1 AS v FROM upd)
SELECT * EXCLUDE (v, rn) FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, city ORDER BY v DESC) AS rn FROM u)
WHERE rn = 1""")
def upsert(spark, sf):
    return al.upsert(views.obs(spark, sf), views.obs_split(spark, sf, 0))


@q("union_dedupe", f"""WITH {FEEDS},
u AS (SELECT city, timestamp, unix_time, aqi, pm2_5, pm10, NULL::DOUBLE AS temp, NULL::DOUBLE AS humidity,
        NULL::DOUBLE AS pressure, NULL::DOUBLE AS wind_speed, NULL::DOUBLE AS wind_deg, NULL::DOUBLE AS clouds,
        NULL::DOUBLE AS visibility, 0 AS src FROM p
      UNION ALL SELECT city, timestamp, unix_time, NULL, NULL, NULL, temp, humidity, pressure, wind_speed,
        wind_deg, clouds, visibility, 1 FROM w)
SELECT * EXCLUDE (src, rn) FROM (SELECT *, row_number() OVER (PARTITION BY city, unix_time ORDER BY src) AS rn FROM u)
WHERE rn = 1""")
def union_dedupe(spark, sf):
    return al.union_dedupe([views.pollution_feed(spark, sf), views.weather_feed(spark, sf)], ["city", "unix_time"])


# S6 -------------------------------------------------------------------------------
@q("daily_snapshot_expand", f"""WITH {sg.obs_cte()},
d AS (SELECT city, CAST(timestamp AS DATE) AS day, MAX(temp) AS temp_max, MIN(humidity) AS humidity_min
      FROM obs GROUP BY 1, 2)
SELECT unnest(generate_series(CAST(day AS TIMESTAMP), CAST(day AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR))
  AS timestamp, city, temp_max, humidity_min FROM d""")
def daily_snapshot_expand(spark, sf):
    d = (views.obs(spark, sf).groupBy("city", F.to_date("timestamp").alias("day"))
         .agg(F.max("temp").alias("temp_max"), F.min("humidity").alias("humidity_min")))
    return al.expand_daily(d, "day")


# P4 / F8 / F11-F13, F16-F17 --------------------------------------------------------
@q("aqi_scale_map", """SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS INTEGER) AS idx,
  CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 WHEN 1 THEN 25 WHEN 2 THEN 75 WHEN 3 THEN 125
  WHEN 4 THEN 175 WHEN 5 THEN 300 ELSE 50 END AS aqi FROM events""")
def aqi_scale_map(spark, sf):
    ev = views.table(spark, sf, "events")
    idx = (views.event_k() % 7).cast("int")
    return ev.select("event_id", idx.alias("idx"), sc.aqi_from_index(idx).alias("aqi"))


def _pm25_sql(x):
    parts = []
    for c_lo, c_hi, i_lo, i_hi in sc.PM25_BREAKPOINTS:
        slope = f"({sg.d(i_hi - i_lo)} / {sg.d(c_hi - c_lo)})"
        parts.append(f"WHEN {x} >= {sg.d(c_lo)} AND {x} <= {sg.d(c_hi)} THEN "
                     f"CAST(round_even({slope} * ({x} - {sg.d(c_lo)}) + {sg.d(i_lo)}, 0) AS INTEGER)")
    return f"CASE {' '.join(parts)} WHEN {x} > {sg.d(sc.PM25_CAP)} THEN 500 ELSE 0 END"


@q("pm25_to_aqi", f"SELECT event_id, value, {_pm25_sql('value')} AS aqi FROM events")
def pm25_to_aqi(spark, sf):
    ev = views.table(spark, sf, "events")
    return ev.select("event_id", "value", sc.pm25_to_aqi("value").alias("aqi"))


def _by_cat_sql(x, values, unknown):
    parts = [f"WHEN {x} IS NULL THEN {unknown}"]
    for (hi, _, _), v in zip(sc.AQI_CATEGORIES, values):
        if hi is not None:
            parts.append(f"WHEN {x} <= {hi} THEN '{v}'")
    return f"CASE {' '.join(parts)} ELSE '{values[-1]}' END"


@q("aqi_category", f"""WITH {sg.obs_cte()}
SELECT city, timestamp, aqi,
  {_by_cat_sql('aqi', [c[1] for c in sc.AQI_CATEGORIES], "'Unknown'")} AS category,
  {_by_cat_sql('aqi', sc.ADVISORIES, 'NULL')} AS advisory,
  {_by_cat_sql('aqi', [c[2] for c in sc.AQI_CATEGORIES], "'#7A7670'")} AS color,
  NULLIF(aqi, 0) AS current_aqi,
  LEAST(CAST(aqi AS DOUBLE), {sg.d(500)}) / {sg.d(500)} AS gauge_fill,
  LEAST(pm10 / {sg.d(150)}, {sg.d(1)}) AS pm_density
FROM obs""")
def aqi_category(spark, sf):
    o = views.obs(spark, sf)
    return o.select("city", "timestamp", "aqi", sc.aqi_category("aqi").alias("category"),
                    sc.health_advisory("aqi").alias("advisory"), sc.aqi_color("aqi").alias("color"),
                    sc.current_aqi("aqi").alias("current_aqi"), sc.gauge_fill("aqi").alias("gauge_fill"),
                    sc.pm_density("pm10").alias("pm_density"))


# F9 / F10 / P21 ------------------------------------------------------------------
def _hf(h):
    return f"CASE WHEN {h} > {sg.d(50)} THEN GREATEST({sg.d(0.3)}, {sg.d(1)} - ({h} - {sg.d(50)}) / {sg.d(100)}) ELSE {sg.d(1)} END"


def _cf(c):
    return f"GREATEST({sg.d(0.5)}, {sg.d(1)} - {c} / {sg.d(200)})"


def _pmf(p):
    return ("CASE " + " ".join(f"WHEN {p} > {sg.d(lim)} THEN {sg.d(f)}" for lim, f in sc.PM_VIS_FACTORS)
            + f" ELSE {sg.d(1)} END")


_H, _C, _P = "COALESCE(humidity, 50.0::DOUBLE)", "COALESCE(clouds, 0.0::DOUBLE)", "COALESCE(pm2_5, 50.0::DOUBLE)"


@q("visibility_ingest", f"""WITH {sg.obs_cte()}
SELECT city, timestamp, CASE WHEN visibility IS NULL OR visibility = 0 THEN
  CAST(GREATEST(1000, LEAST(10000, CAST(TRUNC({sg.d(10000)} * ({_hf(_H)}) * {_cf(_C)}) AS INTEGER))) AS DOUBLE)
  ELSE visibility END AS visibility FROM obs""")
def visibility_ingest(spark, sf):
    o = views.obs(spark, sf)
    v = F.nullif(F.col("visibility"), F.lit(0.0))
    return o.select("city", "timestamp",
                    F.coalesce(v, sc.visibility_ingest_estimate().cast("double")).alias("visibility"))


@q("visibility_repair", f"""WITH {sg.obs_cte()}
SELECT city, timestamp, COALESCE(NULLIF(visibility, 0),
  CAST(GREATEST(500, LEAST(10000, CAST(TRUNC({sg.d(10000)} * ({_hf(_H)}) * {_cf(_C)} * ({_pmf(_P)})) AS INTEGER))) AS DOUBLE))
  AS visibility FROM obs""")
def visibility_repair(spark, sf):
    o = views.obs(spark, sf).withColumn("visibility", F.nullif(F.col("visibility"), F.lit(0.0)))
    return cl.repair_visibility(o).select("city", "timestamp", "visibility")


# P5-P9 -----------------------------------------------------------------------------
EXPECTED = ["temp", "humidity", "pressure", "wind_speed", "visibility", "uvi", "dew_point", "feels_like",
            "clouds", "temp_lag_1h"]


@q("impute_align", f"""WITH {sg.RAW_CTE}
SELECT city, event_id, COALESCE(value, 25.0::DOUBLE) AS temp, COALESCE(k, 50.0::DOUBLE) AS humidity,
  0.0::DOUBLE AS pressure, 0.0::DOUBLE AS wind_speed, 10000.0::DOUBLE AS visibility, 5.0::DOUBLE AS uvi,
  COALESCE(value, 0.0::DOUBLE) AS dew_point, COALESCE(value, 0.0::DOUBLE) AS feels_like, 0.0::DOUBLE AS clouds,
  0.0::DOUBLE AS temp_lag_1h FROM raw""")
def impute_align(spark, sf):
    r = views.raw_series(spark, sf).select("city", "event_id", F.col("value").alias("temperature"),
                                           F.col("k").alias("humidity"))
    p = cl.prepare_scoring_columns(r)
    return cl.align_features(p, EXPECTED, keep=["city", "event_id"])
