"""Row-based time-series features over one window spec.

A series is the rows of one key (``city``) ordered by time plus a
tie-breaker. Offsets are in *rows*, not hours: a 24-step lag is 24 rows back
whatever the gaps, as in the reference.

All features of a frame are produced by at most two projections over the
same ``Window`` spec, so Catalyst plans one exchange + one sort and
evaluates every lag, lead and rolling statistic in a single ``Window``
operator (the padded series needed by percent change is one more ``Window``
node on the already sorted data). For keys so large that one task cannot
hold them, see :mod:`hourcast.operators.halo`.

``decimals``: when the inputs are fixed-point (at most ``decimals`` decimal
places) rolling mean/std are computed from exact integer sums. That makes
them independent of evaluation order — identical across partitionings,
retries and engines — at no extra cost.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hourcast.functions.time import calendar_columns
from hourcast.functions.scalars import interaction_columns

STATS = ("mean", "std", "min", "max")


@dataclass(frozen=True)
class Series:
    keys: tuple = ("city",)
    order: tuple = ("timestamp",)

    def window(self) -> WindowSpec:
        w = Window.partitionBy(*self.keys).orderBy(*self.order) if self.keys else Window.orderBy(*self.order)
        # the same as text: a preset has some 190 window columns, and a column
        # written as one SQL expression is one call to the JVM instead of a dozen
        quote = lambda cs: ", ".join(f"`{c}`" for c in cs)
        w.sql = (f"PARTITION BY {quote(self.keys)} " if self.keys else "") + f"ORDER BY {quote(self.order)}"
        return w


def _frame(w: WindowSpec, size: int) -> WindowSpec:
    return w.rowsBetween(-(size - 1), 0)


def _named(sql: str, name: str) -> Column:
    return F.expr(f"{sql} AS `{name}`")


def _lag(w: WindowSpec, sql: str, k: int) -> str:
    return f"lag({sql}, {k}) OVER ({w.sql})"


# W1 -------------------------------------------------------------------------
def lag_columns(w: WindowSpec, cols: Iterable[str], lags: Iterable[int],
                name: str = "{col}_lag_{k}h") -> list[Column]:
    return [_named(_lag(w, f"`{c}`", k), name.format(col=c, k=k)) for c in cols for k in lags]


# W8 -------------------------------------------------------------------------
def lead_columns(w: WindowSpec, col: str, horizons: Iterable[int],
                 name: str = "target_{h}h") -> list[Column]:
    return [_named(f"lead(`{col}`, {h}) OVER ({w.sql})", name.format(col=col, h=h)) for h in horizons]


# W2-W5 ----------------------------------------------------------------------
# Fixed-point path: integer running sums per key, window sums as differences
# of running sums. Running frames are evaluated incrementally (O(1) per row)
# whereas a bounded ROWS frame is re-aggregated for every row (O(w)); with
# integers the subtraction is exact, so nothing is lost. min/max keep the
# sliding frame. Stage 1 (``rolling_stage1``) must be projected first; the
# stage-2 expressions reuse the same window spec, so no extra sort is planned.
C_, N_, S_, Q_ = "__c_{col}", "__n_{col}", "__s_{col}", "__q_{col}"
DEC = "decimal(19,0)"


def rolling_stage1(w: WindowSpec, cols: Iterable[str], decimals: int) -> list[Column]:
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    scale = float(10 ** decimals)
    out = []
    for c in cols:
        v = F.rint(F.col(c) * F.lit(scale)).cast("long")
        out += [v.alias(C_.format(col=c)),
                F.count(v).over(run).alias(N_.format(col=c)),
                F.coalesce(F.sum(v).over(run), F.lit(0).cast("long")).alias(S_.format(col=c)),
                # squares overflow a long on long series: keep them in decimal(38,0)
                F.coalesce(F.sum(v.cast(DEC) * v.cast(DEC)).over(run), F.lit(0).cast("decimal(38,0)"))
                .alias(Q_.format(col=c))]
    return out


def stage1_names(cols: Iterable[str]) -> list[str]:
    return [t.format(col=c) for c in cols for t in (C_, N_, S_, Q_)]


# Rolling min/max on the same path: a base-4 sparse table. Level s holds the
# min (max) of the last s rows; level 4s = least of four lagged level-s values.
# A window of w rows is then least(...) of at most four lagged values of the
# largest level <= w (ranges may overlap). Offset lookups are O(1) per row,
# whereas a bounded ROWS frame re-aggregates its whole buffer for every row.
# least/greatest skip NULLs like min/max; lags before the partition start are
# NULL, which truncates the frame exactly as ROWS n PRECEDING does.
MM_ = "__{op}{s}_{col}"
_MM_SQL = {"min": "least", "max": "greatest"}


def _levels(top: int) -> list[int]:
    lv = [1]
    while lv[-1] * 4 <= top:
        lv.append(lv[-1] * 4)
    return lv


def _level_col(op: str, s: int, col: str) -> str:
    return col if s == 1 else MM_.format(op=op, s=s, col=col)


def minmax_stages(w: WindowSpec, cols: Iterable[str], windows: Iterable[int],
                  stats: Sequence[str] = STATS) -> list[list[Column]]:
    """Level columns, one list per projection (each level lags the previous)."""
    ops = [o for o in ("min", "max") if o in stats]
    lv = _levels(max(windows, default=1))
    stages = []
    for prev, s in zip(lv, lv[1:]):
        stages.append([_named(f"{_MM_SQL[o]}({', '.join([q, *[_lag(w, q, j * prev) for j in (1, 2, 3)]])})", _level_col(o, s, c))
                       for c in cols for o in ops for q in [f"`{_level_col(o, prev, c)}`"]])
    return stages


def _minmax(w: WindowSpec, col: str, size: int, op: str) -> str:
    s = _levels(size)[-1]
    src = f"`{_level_col(op, s, col)}`"
    offs = sorted({j * s for j in range(-(-size // s) - 1)} | {size - s})
    terms = [src if o == 0 else _lag(w, src, o) for o in offs]
    return terms[0] if len(terms) == 1 else f"{_MM_SQL[op]}({', '.join(terms)})"


def rolling_prep(df: DataFrame, w: WindowSpec, cols: Sequence[str], windows: Sequence[int],
                 stats: Sequence[str] = STATS, decimals: int | None = None,
                 first: Sequence[Column] = ()) -> DataFrame:
    """The projections the fixed-point path needs before ``rolling_columns``
    (running sums and min/max levels), plus ``first`` extra columns. Every
    projection uses the same window spec: no extra exchange or sort."""
    if decimals is None:
        return df.select("*", *first) if first else df
    stages = minmax_stages(w, cols, windows, stats)
    out = df.select("*", *first, *rolling_stage1(w, cols, decimals), *(stages[0] if stages else []))
    for st in stages[1:]:
        out = out.select("*", *st)
    return out


def _windowed(w: WindowSpec, run_col: str, size: int) -> str:
    return f"(`{run_col}` - coalesce({_lag(w, f'`{run_col}`', size)}, 0))"


def _exact_stat(w: WindowSpec, col: str, size: int, stat: str, min_periods: int, decimals: int) -> str:
    """The fixed-point path: differences of running sums, as SQL."""
    n = _windowed(w, N_.format(col=col), size)
    scale = float(10 ** decimals)
    if stat in ("min", "max"):
        val = _minmax(w, col, size, stat)
    elif stat == "mean":
        val = f"CASE WHEN {n} > 0 THEN CAST({_windowed(w, S_.format(col=col), size)} AS DOUBLE) / ({scale!r}D * {n}) END"
    else:
        nd, sd = (f"CAST({x} AS {DEC})" for x in (n, _windowed(w, S_.format(col=col), size)))
        val = (f"CASE WHEN {n} > 1 THEN sqrt(CAST({nd} * {_windowed(w, Q_.format(col=col), size)} - {sd} * {sd} AS DOUBLE) "
               f"/ ({scale * scale!r}D * {n} * ({n} - 1))) END")
    return f"CASE WHEN {n} >= {min_periods} THEN {val} END" if min_periods > 1 else val


def rolling_stat(w: WindowSpec, col: str, size: int, stat: str,
                 min_periods: int = 1, decimals: int | None = None) -> Column:
    if decimals is not None:
        return F.expr(_exact_stat(w, col, size, stat, min_periods, decimals))
    f, x = _frame(w, size), F.col(col)
    val = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[stat](x).over(f)
    return F.when(F.count(x).over(f) >= min_periods, val) if min_periods > 1 else val


def rolling_columns(w: WindowSpec, cols: Iterable[str], windows: Iterable[int],
                    stats: Sequence[str] = STATS, min_periods: int | None = 1,
                    decimals: int | None = None,
                    name: str = "{col}_rolling_{stat}_{w}h") -> list[Column]:
    """``min_periods=None`` means "the window size" (pandas ``rolling(w)``).
    With ``decimals`` the frame must come from :func:`rolling_prep`."""
    out = []
    for c in cols:
        for size in windows:
            mp = size if min_periods is None else min_periods
            for st in stats:
                out.append(rolling_stat(w, c, size, st, mp, decimals).alias(name.format(col=c, stat=st, w=size)))
    return out


def with_rolling(df: DataFrame, series: "Series", cols: Sequence[str], windows: Sequence[int],
                 stats: Sequence[str] = STATS, min_periods: int | None = 1, decimals: int | None = None,
                 keep: Sequence[str] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Project ``keep`` columns, ``extra`` window expressions and the rolling
    statistics over one window spec (two projections when fixed-point)."""
    w = series.window()
    keep = list(keep if keep is not None else df.columns)
    src = rolling_prep(df, w, cols, windows, stats, decimals)
    return src.select(*keep, *extra, *rolling_columns(w, cols, windows, stats, min_periods, decimals))


# W6 / W9 ----------------------------------------------------------------------
def diff_columns(w: WindowSpec, cols: Iterable[str], periods: Iterable[int],
                 name: str = "{col}_diff_{p}h") -> list[Column]:
    return [_named(f"(`{c}` - {_lag(w, f'`{c}`', p)})", name.format(col=c, p=p)) for c in cols for p in periods]


# W7 -------------------------------------------------------------------------
PAD = "__pad_{col}"
CARRY = "__carry_{col}"


def pad_columns(w: WindowSpec, cols: Iterable[str], df: DataFrame | None = None) -> list[Column]:
    """Forward-filled copies (last non-NULL so far) used by percent change.

    When ``df`` carries a ``__carry_{col}`` column (set by the halo-blocked
    path, :mod:`hourcast.operators.halo`) it fills rows whose window
    partition holds no earlier non-NULL value: the series continues before
    the partition starts."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    have = set(df.columns) if df is not None else set()
    out = []
    for c in cols:
        v = F.last(c, ignorenulls=True).over(run)
        if CARRY.format(col=c) in have:
            v = F.coalesce(v, F.col(CARRY.format(col=c)))
        out.append(v.alias(PAD.format(col=c)))
    return out


def pct_change_columns(w: WindowSpec, cols: Iterable[str], periods: Iterable[int],
                       name: str = "{col}_pct_change_{p}h") -> list[Column]:
    """pad / lag(pad, p) - 1 over the forward-filled series; a zero base
    gives NULL (no infinities or NaN ever enter the frame)."""
    out = []
    for c in cols:
        pad = f"`{PAD.format(col=c)}`"
        for p in periods:
            out.append(_named(f"(try_divide({pad}, {_lag(w, pad, p)}) - 1.0D)", name.format(col=c, p=p)))
    return out


def with_pct_change(df: DataFrame, series: Series, cols: Sequence[str], periods: Sequence[int],
                    name: str = "{col}_pct_change_{p}h") -> DataFrame:
    w = series.window()
    padded = df.select("*", *pad_columns(w, cols, df))
    return padded.select(*[F.col(c) for c in df.columns], *pct_change_columns(w, cols, periods, name))


# Presets --------------------------------------------------------------------
@dataclass
class PresetA:
    """Full feature set (target defaults to pm2_5)."""
    target: str = "pm2_5"
    lag_hours: tuple = (1, 3, 6, 12, 24, 48, 72)
    rolling_windows: tuple = (6, 12, 24, 48)
    change_periods: tuple = (1, 6, 12, 24)
    horizons: tuple = (1, 6, 12, 24, 48, 72)
    lag_cols: tuple = field(default=None)
    rolling_cols: tuple = field(default=None)
    change_cols: tuple = field(default=None)

    def resolve(self, columns: Sequence[str]):
        have = set(columns)
        pick = lambda xs: [c for c in xs if c in have]
        lag = self.lag_cols or pick([self.target, "pm10", "temp", "humidity", "wind_speed"])
        roll = self.rolling_cols or pick([self.target, "pm10", "temp", "humidity"])
        chg = self.change_cols or pick([self.target, "pm10", "temp", "humidity", "pressure"])
        return lag, roll, chg


def features_a(df: DataFrame, preset: PresetA | None = None, series: Series = Series(),
               decimals: int | None = None, add_targets: bool = True,
               calendar: bool = True, interactions: bool = True) -> DataFrame:
    """Preset A: calendar + lags + rolling(min_periods=1) + diff/pct change +
    interactions + pressure gradient + ``target_{h}h`` leads."""
    p = preset or PresetA()
    lag, roll, chg = p.resolve(df.columns)
    w = series.window()
    padded = rolling_prep(df, w, roll, p.rolling_windows, STATS, decimals, first=pad_columns(w, chg, df))
    cols = [F.col(c) for c in df.columns]
    if calendar:
        cols += calendar_columns(F.col(series.order[0]), "a")
    cols += lag_columns(w, lag, p.lag_hours)
    cols += rolling_columns(w, roll, p.rolling_windows, STATS, 1, decimals)
    for c in chg:
        cols += diff_columns(w, [c], p.change_periods)
        cols += pct_change_columns(w, [c], p.change_periods)
    if interactions:
        cols += interaction_columns(set(df.columns))
        if "pressure" in df.columns:
            cols += diff_columns(w, ["pressure"], [3], name="pressure_gradient")
    if add_targets:
        cols += lead_columns(w, p.target, p.horizons)
    return padded.select(*cols)


@dataclass
class PresetB:
    """Single-target set (target defaults to aqi); rolling needs a full window."""
    target: str = "aqi"
    lags: tuple = (1, 2, 3, 6, 12, 24)
    windows: tuple = (3, 6, 12, 24)
    periods: tuple = (1, 3, 6, 12, 24)
    horizons: tuple = (1, 3, 6, 12, 24, 48, 72)


def features_b(df: DataFrame, preset: PresetB | None = None, series: Series = Series(),
               decimals: int | None = None, add_targets: bool = True,
               calendar: bool = True) -> DataFrame:
    p = preset or PresetB()
    t = p.target
    w = series.window()
    padded = rolling_prep(df, w, [t], p.windows, STATS, decimals, first=pad_columns(w, [t], df))
    cols = [F.col(c) for c in df.columns]
    if calendar:
        cols += calendar_columns(F.col(series.order[0]), "b")
    cols += lag_columns(w, [t], p.lags)
    cols += rolling_columns(w, [t], p.windows, STATS, None, decimals)
    for q in p.periods:
        cols += diff_columns(w, [t], [q], name="{col}_change_{p}h")
        cols += pct_change_columns(w, [t], [q])
    if add_targets:
        cols += lead_columns(w, t, p.horizons, name="{col}_target_{h}h")
    return padded.select(*cols)


# P10 ------------------------------------------------------------------------
KEY_COLS = ("timestamp", "city")
RAW_CALENDAR = ("hour", "day_of_week", "day_of_month", "month", "week_of_year")
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean")


def feature_columns(df: DataFrame, rule: str = "a", exclude: Sequence[str] = ()) -> list[str]:
    """Feature-column selection over the schema (no data is read).

    a: drop keys, unix_time, hour_ts, raw calendar ints, ``target_*`` and
       ``*_x``/``*_y``; b: drop timestamp, city and ``*_target_*``;
    c: drop keys and both target patterns; d: drop a fixed list;
    e: numeric columns only (minus ``exclude``).
    """
    names = df.columns
    if rule == "a":
        drop = set(KEY_COLS) | {"unix_time", "hour_ts"} | set(RAW_CALENDAR)
        return [c for c in names if c not in drop and not c.startswith("target_")
                and not c.endswith("_x") and not c.endswith("_y")]
    if rule == "b":
        return [c for c in names if c not in KEY_COLS and "_target_" not in c]
    if rule == "c":
        return [c for c in names if c not in set(KEY_COLS) | {"unix_time"}
                and not c.startswith("target_") and "_target_" not in c]
    if rule == "d":
        return [c for c in names if c not in set(exclude)]
    if rule == "e":
        types = dict(df.dtypes)
        return [c for c in names if types[c] in NUMERIC and c not in set(exclude)
                and not c.startswith("target_") and "_target_" not in c]
    raise ValueError(f"unknown feature rule {rule!r}")
