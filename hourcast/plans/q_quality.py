"""Data-quality, gap-fill and scaler queries (A13-A20, A24, A29-A30, W10,
P22-P24, S21, A21-A22) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators import clean as cl
from hourcast.operators import quality as qa
from hourcast.operators import scale as scl
from hourcast.operators import split as sp
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


def _union(parts):
    return " UNION ALL ".join(parts)


# A14 -------------------------------------------------------------------------------
_NP_COLS = ["timestamp", "event_id", "value", "k"]


@q("null_profile", f"WITH {sg.RAW_CTE} " + _union(
    f"SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS nulls, "
    f"(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) * {sg.d(100)}) / COUNT(*) AS pct FROM raw" for c in _NP_COLS))
def null_profile(spark, sf):
    return qa.null_profile(views.raw_series(spark, sf), _NP_COLS)


# A13 -------------------------------------------------------------------------------
_DESC = ["temp", "humidity", "pressure", "wind_speed", "pm2_5", "pm10", "aqi", "visibility"]


def _desc_sql(c):
    v = f"CAST(ROUND(CAST({c} AS DOUBLE) * 100) AS BIGINT)"
    n, s1, s2 = f"COUNT({v})", f"SUM({v})", f"SUM({v} * {v})"
    return (f"SELECT '{c}' AS column, COUNT({c}) AS count, CAST({s1} AS DOUBLE) / ({sg.d(100)} * {n}) AS mean, "
            f"CASE WHEN {n} > 1 THEN SQRT(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE) / ({sg.d(10000)} * {n} * ({n} - 1))) END AS std, "
            f"CAST(MIN({c}) AS DOUBLE) AS min, "
            f"quantile_cont({v}, 0.25) / {sg.d(100)} AS p25, quantile_cont({v}, 0.5) / {sg.d(100)} AS p50, "
            f"quantile_cont({v}, 0.75) / {sg.d(100)} AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM obs")


@q("describe", f"WITH {sg.obs_cte()} " + _union(_desc_sql(c) for c in _DESC))
def describe(spark, sf):
    return qa.describe(views.obs(spark, sf), _DESC, digits=None, decimals=2)


# A18 / P22 -------------------------------------------------------------------------
@q("range_check", f"WITH {sg.obs_cte()} " + _union(
    f"SELECT '{c}' AS column, COUNT(CASE WHEN {c} < {lo} THEN 1 END) AS below, "
    f"COUNT(CASE WHEN {c} > {hi} THEN 1 END) AS above, CAST(MIN({c}) AS DOUBLE) AS min, "
    f"CAST(MAX({c}) AS DOUBLE) AS max FROM obs" for c, (lo, hi, _) in qa.VALID_RANGES.items()))
def range_check(spark, sf):
    return qa.range_check(views.obs(spark, sf))


# A15-A17, W10 ----------------------------------------------------------------------
@q("duplicates", """SELECT event_type AS city,
  COUNT(*) - COUNT(DISTINCT CAST(FLOOR(epoch(ts) / 60) AS BIGINT)) AS duplicates FROM events GROUP BY 1""")
def duplicates(spark, sf):
    ev = views.table(spark, sf, "events").select(
        F.col("event_type").alias("city"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)).alias("minute"))
    return qa.duplicate_keys(ev, "minute", by=["city"])


@q("coverage", f"""WITH {sg.obs_cte()},
g AS (SELECT city, MIN(timestamp) AS first_ts, MAX(timestamp) AS last_ts, COUNT(*) AS records FROM obs GROUP BY city)
SELECT city, first_ts, last_ts, records,
  CAST(FLOOR((epoch(last_ts) - epoch(first_ts)) / 86400) + 1 AS BIGINT) AS days,
  CAST(FLOOR((epoch(last_ts) - epoch(first_ts)) / 86400) + 1 AS BIGINT) * 24 AS expected,
  records / (CAST(FLOOR((epoch(last_ts) - epoch(first_ts)) / 86400) + 1 AS BIGINT) * 24) * {sg.d(100)} AS coverage_pct
FROM g""")
def coverage(spark, sf):
    return qa.coverage(views.obs(spark, sf))


@q("gaps", f"""WITH {sg.obs_cte()},
d AS (SELECT city, unix_time - LAG(unix_time) OVER (PARTITION BY city ORDER BY unix_time) AS g FROM obs)
SELECT city, COUNT(CASE WHEN g = 3600 THEN 1 END) AS normal, COUNT(CASE WHEN g > 3600 THEN 1 END) AS larger,
  COUNT(CASE WHEN g < 3600 THEN 1 END) AS smaller,
  MAX(CASE WHEN g > 3600 THEN g END) / {sg.d(3600)} AS max_gap_h,
  AVG(CASE WHEN g > 3600 THEN g END) / {sg.d(3600)} AS mean_gap_h
FROM d WHERE g IS NOT NULL GROUP BY city""")
def gaps(spark, sf):
    return qa.gaps(views.obs(spark, sf))


# A19 / A20 -------------------------------------------------------------------------
_CORR_F = ["temp", "humidity", "pressure", "wind_speed", "visibility", "pm10"]


@q("corr_target", f"WITH {sg.obs_cte()} " + _union(
    f"SELECT '{c}' AS feature, ROUND(CORR({c}, pm2_5), 6) AS corr FROM obs" for c in _CORR_F))
def corr_target(spark, sf):
    return qa.corr_with(views.obs(spark, sf), "pm2_5", _CORR_F)


_CM = ["unix_time", "n", "pm2_5", "pm10", "temp", "humidity", "wind_speed", "wind_deg", "pressure", "clouds", "visibility", "aqi"]


@q("corr_matrix", f"WITH {sg.obs_cte()} " + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) AS corr FROM obs" for a in _CM for b in _CM))
def corr_matrix(spark, sf):
    """Every numeric column of the frame."""
    return qa.corr_matrix(views.obs(spark, sf))


# A29 / A30 -------------------------------------------------------------------------
def _box_sql(c):
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column, ROUND(q1, 6) AS q1, ROUND(med, 6) AS median, ROUND(q3, 6) AS q3,
  ROUND((SELECT MIN({v}) FROM obs WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
  ROUND((SELECT MAX({v}) FROM obs WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  (SELECT COUNT(*) FROM obs WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS med, quantile_cont({v}, 0.75) AS q3 FROM obs)"""


@q("boxplot", f"WITH {sg.obs_cte()} " + _union(_box_sql(c) for c in _CM))
def boxplot(spark, sf):
    return qa.boxplot(views.obs(spark, sf), _CM)


@q("shape_stats", f"""WITH {sg.obs_cte()},
x AS (SELECT city, pm2_5 AS x, LAG(pm2_5) OVER (PARTITION BY city ORDER BY timestamp) AS l FROM obs)
SELECT city, ROUND(CORR(x, l), 6) AS autocorr_lag1, ROUND(skewness(x), 6) AS skew FROM x GROUP BY city""")
def shape_stats(spark, sf):
    return qa.shape_stats(views.obs(spark, sf), "pm2_5")


# S21 ------------------------------------------------------------------------------
@q("status_by_city", f"""WITH {sg.obs_cte('pe')},
c AS (SELECT DISTINCT event_type AS city FROM events),
g AS (SELECT city, COUNT(*) AS records, MIN(timestamp) AS first_ts, MAX(timestamp) AS last_ts FROM pe GROUP BY city)
SELECT c.city, COALESCE(g.records, 0) > 0 AS exists, COALESCE(g.records, 0) AS records, g.first_ts, g.last_ts
FROM g RIGHT JOIN c ON g.city = c.city""")
def status_by_city(spark, sf):
    cities = views.table(spark, sf, "events").select(F.col("event_type").alias("city")).distinct()
    return qa.status_by_city(views.obs(spark, sf), cities)


# P23 / P24 ------------------------------------------------------------------------
_GRID_SQL = f"""{sg.obs_cte()},
b AS (SELECT city, MIN(timestamp) AS lo, MAX(timestamp) AS hi FROM obs GROUP BY city),
grid AS (SELECT city, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM b),
gj AS (SELECT grid.city, grid.timestamp, CAST(epoch(grid.timestamp) AS BIGINT) AS pos, obs.pm2_5, obs.humidity
       FROM grid LEFT JOIN obs ON grid.city = obs.city AND grid.timestamp = obs.timestamp)"""


def _grid(spark, sf):
    g = cl.hourly_grid(views.obs(spark, sf).select("city", "timestamp", "pm2_5", "humidity"))
    return g.withColumn("pos", F.unix_seconds(F.col("timestamp").cast("timestamp")))


@q("gap_fill_ffill", f"""WITH {_GRID_SQL}
SELECT city, timestamp, {sg.pad('pm2_5', 'PARTITION BY city ORDER BY timestamp')} AS pm2_5,
  {sg.pad('humidity', 'PARTITION BY city ORDER BY timestamp')} AS humidity FROM gj""")
def gap_fill_ffill(spark, sf):
    return cl.forward_fill(_grid(spark, sf), ["pm2_5", "humidity"]).select("city", "timestamp", "pm2_5", "humidity")


def _lin_sql(c):
    w = "PARTITION BY city ORDER BY timestamp"
    pp = f"LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    pv = f"LAST_VALUE({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    np_ = f"FIRST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    nv = f"FIRST_VALUE({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (f"COALESCE({c}, {pv} + ({nv} - {pv}) * (CAST(pos - {pp} AS DOUBLE) / "
            f"NULLIF(CAST({np_} - {pp} AS DOUBLE), 0))) AS {c}")


@q("gap_fill_linear", f"WITH {_GRID_SQL} SELECT city, timestamp, {_lin_sql('pm2_5')}, {_lin_sql('humidity')} FROM gj")
def gap_fill_linear(spark, sf):
    return cl.linear_fill(_grid(spark, sf), ["pm2_5", "humidity"], pos="pos").select(
        "city", "timestamp", "pm2_5", "humidity")


# A21 / A22 / A24 ---------------------------------------------------------------------
_SC = ["pm2_5", "pm10", "humidity"]
_SPLIT_SQL = f"""{sg.obs_cte()},
s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, city) <= CAST(FLOOR(COUNT(*) OVER () * 0.8) AS BIGINT)
      THEN 'train' ELSE 'test' END AS split FROM obs)"""


def _std_stats_sql(c):
    v = f"CAST(ROUND({c} * 100) AS BIGINT)"
    n, s1, s2 = f"COUNT({v})", f"SUM({v})", f"SUM({v} * {v})"
    return (f"CAST({s1} AS DOUBLE) / ({sg.d(100)} * {n}) AS m_{c}, "
            f"CASE WHEN SQRT(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE)) / ({sg.d(100)} * {n}) = 0 THEN {sg.d(1)} "
            f"ELSE SQRT(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE)) / ({sg.d(100)} * {n}) END AS s_{c}")


@q("scale_standard", f"""WITH {_SPLIT_SQL},
st AS (SELECT {', '.join(_std_stats_sql(c) for c in _SC)} FROM s WHERE split = 'train')
SELECT city, timestamp, split, {', '.join(f'(s.{c} - st.m_{c}) / st.s_{c} AS {c}' for c in _SC)} FROM s, st""")
def scale_standard(spark, sf):
    s = sp.chrono_split(views.obs(spark, sf).select("city", "timestamp", *_SC))
    params = scl.fit_standard(s.where(F.col("split") == "train"), _SC, decimals=2)
    return scl.transform(s, params)


@q("scale_robust", f"""WITH {_SPLIT_SQL},
st AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0::DOUBLE ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in _SC)}
       FROM s WHERE split = 'train')
SELECT city, timestamp, split, {', '.join(f'ROUND((s.{c} - st.m_{c}) / st.s_{c}, 6) AS {c}' for c in _SC)} FROM s, st""")
def scale_robust(spark, sf):
    s = sp.chrono_split(views.obs(spark, sf).select("city", "timestamp", *_SC))
    params = scl.fit_robust(s.where(F.col("split") == "train"), _SC)
    t = scl.transform(s, params)
    return t.select("city", "timestamp", "split", *[F.round(c, 6).alias(c) for c in _SC])


@q("split_stats", f"""WITH {_SPLIT_SQL}
SELECT split, COUNT(*) AS n, ROUND(AVG(pm2_5), 6) AS mean, ROUND(STDDEV_POP(pm2_5), 6) AS std FROM s GROUP BY split""")
def split_stats(spark, sf):
    s = sp.chrono_split(views.obs(spark, sf).select("city", "timestamp", "pm2_5"))
    st = scl.split_stats(s, "pm2_5")
    return st.select("split", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
