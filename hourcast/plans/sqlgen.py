"""SQL text for the DuckDB oracle: the driver-table views and window idioms.

The oracle restates each operator independently in plain SQL; these helpers
only keep the long, repetitive feature lists readable.
"""

from __future__ import annotations

import math

OBS_INNER = """
SELECT city, timestamp, CAST(epoch(timestamp) AS BIGINT) AS unix_time, n,
       CAST(sc // n AS DOUBLE) / 100.0 AS pm2_5,
       pm10, temp,
       CAST(sk // n AS DOUBLE) AS humidity,
       CAST(n AS DOUBLE) AS wind_speed,
       CAST(mk AS DOUBLE) * CAST(3.6 AS DOUBLE) AS wind_deg,
       1000.0 + CAST(nk AS DOUBLE) AS pressure,
       CAST(mk AS DOUBLE) AS clouds,
       100.0 * CAST(100 - mk AS DOUBLE) AS visibility,
       CAST(CEIL(pm10) AS BIGINT) AS aqi
FROM (
  SELECT event_type AS city, date_trunc('hour', ts) AS timestamp,
         COUNT(*) AS n,
         SUM(CAST(ROUND(value * 100) AS BIGINT)) AS sc,
         MAX(value) AS pm10, MIN(value) AS temp,
         SUM(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS sk,
         MAX(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS mk,
         MIN(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS nk
  FROM events {where}
  GROUP BY 1, 2) g
"""


def obs_cte(name: str = "obs", where: str = "") -> str:
    return f"{name} AS ({OBS_INNER.format(where=where)})"


RAW_CTE = """raw AS (
  SELECT event_type AS city, ts AS timestamp, event_id,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS k
  FROM events)"""


def win(keys=("city",), order=("timestamp",)) -> str:
    p = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"{p}ORDER BY {', '.join(order)}"


def rows(w: str, size: int) -> str:
    return f"({w} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


def lag(col, k, w):
    return f"LAG({col}, {k}) OVER ({w})"


def lead(col, k, w):
    return f"LEAD({col}, {k}) OVER ({w})"


def cents(col, decimals=2):
    return f"CAST(ROUND({col} * {10 ** decimals}) AS BIGINT)"


def rolling(col, size, stat, w, min_periods=1, decimals=2, cents_col=None):
    """Rolling statistic; mean/std from exact scaled-integer sums."""
    f = rows(w, size)
    c = cents_col or cents(col, decimals)
    scale = float(10 ** decimals)
    if stat == "min":
        v = f"MIN({col}) OVER {f}"
    elif stat == "max":
        v = f"MAX({col}) OVER {f}"
    elif stat == "mean":
        v = (f"CASE WHEN COUNT({c}) OVER {f} > 0 THEN CAST(SUM({c}) OVER {f} AS DOUBLE)"
             f" / ({d(scale)} * COUNT({c}) OVER {f}) END")
    else:
        n = f"COUNT({c}) OVER {f}"
        s = f"SUM({c}) OVER {f}"
        ss = f"SUM({c} * {c}) OVER {f}"
        v = (f"CASE WHEN {n} > 1 THEN SQRT(CAST({n} * {ss} - {s} * {s} AS DOUBLE)"
             f" / ({d(scale * scale)} * {n} * ({n} - 1))) END")
    if min_periods > 1:
        v = f"CASE WHEN COUNT({col}) OVER {f} >= {min_periods} THEN {v} END"
    return v


def pad(col, w):
    return f"LAST_VALUE({col} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def pct(padcol, p, w):
    return f"{padcol} / NULLIF(LAG({padcol}, {p}) OVER ({w}), 0) - 1.0"


def r9(expr):
    # + 0.0 turns the -0.0 that DuckDB's ROUND keeps into 0.0, as Spark returns
    return f"(ROUND({expr}, 9) + CAST(0.0 AS DOUBLE))"


TWO_PI = repr(2.0 * math.pi)


def d(x) -> str:
    """A DOUBLE literal (plain decimal literals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def cyc(x, period, fn):
    return f"{fn}({d(2.0)} * {d(math.pi)} * {x} / {d(period)})"


def calendar_sql(ts="timestamp", preset="a", rnd=True):
    R = r9 if rnd else (lambda e: e)
    hour, dow, dom, month = f"CAST(hour({ts}) AS INTEGER)", f"CAST(isodow({ts}) - 1 AS INTEGER)", \
        f"CAST(day({ts}) AS INTEGER)", f"CAST(month({ts}) AS INTEGER)"
    if preset == "b":
        return [
            f"{hour} AS hour", f"{dom} AS day", f"{dow} AS day_of_week", f"{month} AS month",
            f"CAST(year({ts}) AS INTEGER) AS year",
            f"CAST({dow} >= 5 AS INTEGER) AS is_weekend",
            f"{R(cyc(hour, 24, 'SIN'))} AS hour_sin", f"{R(cyc(hour, 24, 'COS'))} AS hour_cos",
            f"{R(cyc(dow, 7, 'SIN'))} AS day_of_week_sin", f"{R(cyc(dow, 7, 'COS'))} AS day_of_week_cos",
            f"{R(cyc(month, 12, 'SIN'))} AS month_sin", f"{R(cyc(month, 12, 'COS'))} AS month_cos",
        ]
    woy = f"CAST(weekofyear({ts}) AS INTEGER)"
    return [
        f"{hour} AS hour", f"{R(cyc(hour, 24, 'SIN'))} AS hour_sin", f"{R(cyc(hour, 24, 'COS'))} AS hour_cos",
        f"{dow} AS day_of_week", f"{R(cyc(dow, 7, 'SIN'))} AS dow_sin", f"{R(cyc(dow, 7, 'COS'))} AS dow_cos",
        f"{dom} AS day_of_month", f"{R(cyc(dom, 31, 'SIN'))} AS dom_sin", f"{R(cyc(dom, 31, 'COS'))} AS dom_cos",
        f"{month} AS month", f"{R(cyc(month, 12, 'SIN'))} AS month_sin", f"{R(cyc(month, 12, 'COS'))} AS month_cos",
        f"{woy} AS week_of_year", f"{R(cyc(woy, 52, 'SIN'))} AS woy_sin", f"{R(cyc(woy, 52, 'COS'))} AS woy_cos",
        f"CAST({dow} >= 5 AS INTEGER) AS is_weekend",
        f"CAST({hour} >= 22 OR {hour} <= 5 AS INTEGER) AS is_night",
        f"CAST(({hour} >= 7 AND {hour} <= 9) OR ({hour} >= 17 AND {hour} <= 19) AS INTEGER) AS is_rush_hour",
        f"({month} > 0 AND {month} <= 3) AS season_winter",
        f"({month} > 3 AND {month} <= 6) AS season_spring",
        f"({month} > 6 AND {month} <= 9) AS season_summer",
        f"({month} > 9 AND {month} <= 12) AS season_fall",
    ]
